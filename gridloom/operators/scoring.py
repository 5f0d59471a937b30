"""Scoring of sampled answers: verdicts, votes, pass@2, ensembles, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import numbered

#: Rows that a running figure over a whole table takes in one go.
BLOCK = 1_000_000


def verdict_rollup(long: DataFrame) -> DataFrame:
    """long: (uid, sample_idx, kind train|test, ok). One row a sample: train_verdict, train_test_verdict and the share of correct pairs; an unknown verdict is false, none at all is true."""
    ok = F.coalesce("ok", F.lit(False))
    return long.groupBy("uid", "sample_idx").agg(
        F.coalesce(F.bool_and(F.when(F.col("kind") == "train", ok)), F.lit(True)).alias("train_verdict"),
        F.bool_and(ok).alias("train_test_verdict"),
        F.round(F.avg(ok.cast("int")), 6).alias("ratio"),
    )


def accepted(samples: DataFrame) -> DataFrame:
    """(uid, accepted, best, worst): whether any sample is right, and the extremes of the match ratio."""
    return samples.groupBy("uid").agg(F.bool_or("train_test_verdict").alias("accepted"), F.max("ratio").alias("best"), F.min("ratio").alias("worst"))


def vote(samples: DataFrame, top: int = 2, cumulative: bool = False) -> DataFrame:
    """samples: (uid, test_idx, sample_idx, answer) that pass all train pairs. The `top` most frequent answers of each test, the first seen of equals: (uid, test_idx, answer, votes, rank).

    cumulative: a later test of the same uid also counts the votes of the tests before it.
    """
    if cumulative:
        later = samples.select("uid", "test_idx").distinct().withColumnRenamed("test_idx", "_at")
        samples = samples.join(later, "uid").filter("test_idx <= _at").select("uid", F.col("_at").alias("test_idx"), "answer", (F.col("test_idx") * (1 << 40) + F.col("sample_idx")).alias("sample_idx"))
    counts = samples.groupBy("uid", "test_idx", "answer").agg(F.count("*").alias("votes"), F.min("sample_idx").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("uid", "test_idx").orderBy(F.desc("votes"), "seen"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top).select("uid", "test_idx", "answer", "votes", "rank")


def pass_at_2(top: DataFrame, truth: DataFrame) -> DataFrame:
    """truth: (uid, test_idx, answer). One row: the sum over uids of the share of tests whose top answers have the truth, and that over the number of uids."""
    right = top.select("uid", "test_idx", F.col("answer").alias("_a")).distinct()
    hits = truth.join(right, (truth.uid == right.uid) & (truth.test_idx == right.test_idx) & truth.answer.eqNullSafe(right["_a"]), "left_semi").select("uid", "test_idx").distinct().withColumn("hit", F.lit(1))
    share = truth.join(hits, ["uid", "test_idx"], "left").groupBy("uid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return share.agg(F.round(F.sum("share"), 6).alias("solved"), F.count("*").alias("problems"), F.round(F.sum("share") / F.count("*"), 6).alias("accuracy"))


def ensemble(first: DataFrame, second: DataFrame) -> DataFrame:
    """(uid, test_idx, answer, rank): the first method's answers for uids where it has one for test 0, else the second's."""
    able = first.filter("test_idx = 0").select("uid").distinct()
    return first.join(able, "uid", "left_semi").unionByName(second.join(able, "uid", "left_anti"))


def merge_lists(parts: DataFrame, most: int | None = None) -> DataFrame:
    """parts: (uid, ord, items). (uid, items): lists in order, one after the other, the first `most` of all.

    With a cap every task lets go of the parts that stand behind its own first `most` items
    of a uid before parts meet, so of a uid that all rows share a task gets no more than
    `most` items from each other task. Without one the list is as long as it is.
    """
    if most is not None:
        first = parts.select("uid", "ord", F.slice("items", 1, most).alias("items"), F.spark_partition_id().alias("_task"))
        ahead = Window.partitionBy("uid", "_task").orderBy("ord", "items").rowsBetween(Window.unboundedPreceding, -1)
        parts = first.withColumn("_ahead", F.coalesce(F.sum(F.size("items")).over(ahead), F.lit(0))).filter(F.col("_ahead") < most).select("uid", "ord", "items")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "items"))), lambda s: s["items"]))
    return parts.groupBy("uid").agg((whole if most is None else F.slice(whole, 1, most)).alias("items"))


def frequency_rerank(candidates: DataFrame) -> DataFrame:
    """candidates: (idx, ord, text, clean, score). (idx, clean, text, frequency, mean_score, rank): groups by cleaned text, most frequent first, then the higher mean, then the first seen."""
    groups = candidates.groupBy("idx", "clean").agg(F.count("*").alias("frequency"), F.round(F.avg("score"), 6).alias("mean_score"), F.min_by("text", "ord").alias("text"), F.min("ord").alias("_seen"))
    rank = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("frequency"), F.desc("mean_score"), "_seen"))
    return groups.withColumn("rank", rank).drop("_seen")


def running_accuracy(rows: DataFrame, by: str | None = None, idx: str = "idx", correct: str = "correct") -> DataFrame:
    """rows with `accuracy` so far by idx: in each group, or over the whole run, which no task has to hold."""
    right = F.col(correct).cast("int")
    if by is not None:
        w = Window.partitionBy(by).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("accuracy", F.round(F.sum(right).over(w) / F.row_number().over(Window.partitionBy(by).orderBy(idx)), 6))
    at = numbered(rows, idx, name="_rn").withColumn("_block", F.floor(F.col("_rn") / BLOCK))
    sums = at.groupBy("_block").agg(F.sum(right).alias("_sum"))
    before = sums.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))  # one row a block
    inside = F.sum(right).over(Window.partitionBy("_block").orderBy("_rn"))
    return at.withColumn("_right", inside).join(before, "_block").withColumn("accuracy", F.round((F.col("_before") + F.col("_right")) / F.col("_rn"), 6)).drop("_rn", "_block", "_right", "_before")


def grid_key_join(answers: DataFrame, tests: DataFrame) -> DataFrame:
    """answers joined to (uid, test_idx) by the grid itself."""
    return answers.join(tests.select("uid", "test_idx", F.col("input").alias("_g")), F.col("input") == F.col("_g")).drop("_g")


def leave_one_out(tasks: DataFrame) -> DataFrame:
    """For each train pair a task with it as the test and the pairs that differ from it as train; tasks of exactly two pairs give none."""
    one = tasks.filter(F.size("train") != 2).select("uid", "train", F.posexplode("train").alias("held", "pair"))
    return one.select("uid", "held", F.expr("filter(train, t -> t <> pair)").alias("train"), F.array("pair").alias("test"))


def test_pairs(tasks: DataFrame) -> DataFrame:
    """One task for each test pair, its number after the uid."""
    return tasks.select("uid", "train", F.posexplode("test").alias("k", "pair")).select(F.concat_ws("-", "uid", "k").alias("uid"), "train", F.array("pair").alias("test"))


def permutations(examples: list, most: int = 1) -> list[list]:
    """Orders of a task's examples, the given one first."""
    from itertools import islice
    from itertools import permutations as every

    return [list(p) for p in islice(every(examples), most)]


def permuted_tasks(tasks: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """tasks: (uid, train, ...). One row for each order of a task's train pairs, `perm` its number: the given order is 0; where there are more than `most`, the others are drawn by hash, none twice.

    Up to five pairs all orders (120) are listed and drawn from. Of more pairs orders are
    drawn by sorting the places by a hash of seed, uid, draw and place, twice as many as are
    wanted, less those that come up again.
    """
    n = F.size("train")
    place = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    place = place.cast("array<int>")
    longer = lambda orders, _: F.flatten(F.transform(orders, lambda o: F.transform(F.filter(place, lambda k: ~F.array_contains(o, k)), lambda k: F.concat(o, F.array(k)))))
    every = F.aggregate(place, F.array(F.array().cast("array<int>")), longer)
    mark = lambda *x: F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("uid").cast("string"), *x))
    by_mark = lambda items, h: F.transform(F.array_sort(F.transform(items, lambda x: F.struct(h(x).alias("h"), x.alias("x")))), lambda s: s["x"])
    others = F.filter(every, lambda o: o != place)
    chosen = F.when(F.size(others) < most, others).otherwise(by_mark(others, lambda o: mark(F.array_join(o, ","))))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(2 * most)), lambda d: by_mark(place, lambda k: mark(d.cast("string"), k.cast("string"))))
    orders = [F.slice(F.concat(F.array(place), chosen), 1, most), F.slice(F.array_distinct(F.concat(F.array(place), drawn)), 1, most)]
    out = tasks.filter(n <= 5).withColumn("_orders", orders[0]).unionByName(tasks.filter(n > 5).withColumn("_orders", orders[1]))
    out = out.select("*", F.posexplode("_orders").alias("perm", "_order"))
    return out.withColumn("train", F.transform("_order", lambda k: F.get("train", k))).drop("_orders", "_order")


def all_equal(long: DataFrame, *by: str) -> DataFrame:
    """long: (..., answer). Whether all answers of a group are the same, null being an answer."""
    return long.groupBy(*by).agg((F.count_distinct(F.coalesce(F.to_json(F.struct("answer")), F.lit("")))  == 1).alias("deterministic"))
