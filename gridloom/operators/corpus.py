"""Corpus engineering: order, splits, mixing, budgets, dedup, decontamination."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import let
from ..functions.text import normalized, word_count
from ..session import settled

#: A benchmark of up to so many bytes is broadcast; beyond it it is shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes of a table for each range that it is sorted in.
RANGE_BYTES = 64 << 20


def ranges_for(df: DataFrame) -> int:
    """Ranges that a sort of df is cut in: one for RANGE_BYTES of it, as far as its size is known, and one a core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark = df.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions")) if size > 1 << 50 else max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A small table dealt to all cores by a key, as it may lie in one row group, which is one task; a table of over RANGE_BYTES a core has enough of these and stays where it is."""
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *by) if size <= RANGE_BYTES * cores else df


def numbered(df: DataFrame, *order, name: str = "rn", groups: int | None = None) -> DataFrame:
    """df with a row number from 1 over the whole table, in the given order, without one task for all rows.

    Rows are sorted by range, numbered inside each range, and moved up by the sizes of the
    ranges before: a table of one row for each range. `groups`: the ranges, by default as
    many as the size of df asks for.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = df.repartitionByRange(groups or ranges_for(df), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    parts = parts.withColumn("_p", F.shiftrightunsigned(place, 33)).withColumn("_i", place.bitwiseAND((1 << 33) - 1))
    parts = settled(parts)  # sizes and rows must see the same ranges
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return parts.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_n", "_before")


def seeded_order(seed: int, key: str) -> list[Column]:
    """A shuffle that repeats: by md5 of seed and key, then the key."""
    return [F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), F.col(key)]


def ordered_split(df: DataFrame, key: str, fraction: float = 0.95, seed: int = 0) -> DataFrame:
    """df with `split`: exactly floor(fraction * rows) of the shuffled rows are train, the others test.

    Where to cut is found by the number of the row, so that no sort of all rows meets in one task.
    """
    total = df.agg(F.count("*").alias("_total"))
    rn = numbered(df, *seeded_order(seed, key), name="_rn").crossJoin(F.broadcast(total))  # one row
    return rn.withColumn("split", F.when(F.col("_rn") <= F.floor(F.lit(fraction) * F.col("_total")), "train").otherwise("test")).drop("_rn", "_total")


def mix(df: DataFrame, dataset: str, order: str, fractions: dict[str, float]) -> DataFrame:
    """Of each dataset its first floor(fraction * rows) rows; fractions are keyed by dataset, and none may be negative."""
    if any(f < 0 for f in fractions.values()):
        raise ValueError("fractions are not negative")
    share = F.create_map(*[x for k, v in fractions.items() for x in (F.lit(k), F.lit(float(v)))])
    counts = df.groupBy(dataset).agg(F.count("*").alias("_n")).filter(F.col(dataset).isin(*fractions))  # one row a dataset
    counts = counts.select(F.col(dataset).alias("_d"), "_n", (F.sum("_n").over(Window.orderBy(dataset)) - F.col("_n")).alias("_first"))
    rn = numbered(df.filter(F.col(dataset).isin(*fractions)), dataset, order, name="_rn")
    out = rn.join(F.broadcast(counts), F.col(dataset) == F.col("_d"))
    return out.filter(F.col("_rn") - F.col("_first") <= F.floor(F.element_at(share, F.col(dataset)) * F.col("_n"))).drop("_rn", "_n", "_d", "_first")


def first_of_each(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each file or group, in order. A group's rows are cut to n in every task before they meet."""
    salt = F.spark_partition_id()
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    some = df.withColumn("_salt", salt).withColumn("_rank", rank(by, "_salt")).filter(F.col("_rank") <= n)
    return some.withColumn("_rank", rank(by)).filter(F.col("_rank") <= n).drop("_salt", "_rank")


def batch_of(df: DataFrame, size: int, order: str) -> DataFrame:
    """df with `batch`: rows in order, `size` at a time."""
    return numbered(df, order, name="_rn").withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")


def page(df: DataFrame, order: str, start: int, size: int) -> DataFrame:
    return df.orderBy(order).offset(start).limit(size)


def length_bucket(tokens: Column, base: int = 4) -> Column:
    """How many prompts of a length are sent together."""
    return F.when(tokens < 4000, 4 * base).otherwise(base)


def within_budget(df: DataFrame, *texts: str, limit: int = 8000, count=word_count) -> DataFrame:
    """Rows whose texts together have fewer than `limit` words, or of what else `count` counts (functions.tokens)."""
    total = sum((count(F.col(t)) for t in texts[1:]), count(F.col(texts[0])))
    return df.filter(total < limit)


def within_both_budgets(df: DataFrame, *variants: list[str], limit: int = 8000, count=word_count) -> DataFrame:
    """Rows of which every variant, a list of text columns, is within the budget."""
    for texts in variants:
        df = within_budget(df, *texts, limit=limit, count=count)
    return df


def in_any(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key one of the other tables has."""
    keys = [o.select(key) for o in others]
    return df.join(reduce(DataFrame.unionByName, keys), key, "left_semi")


def without_index(df: DataFrame, column: str, skipped: list) -> DataFrame:
    return df.filter(~F.col(column).isin(skipped)) if skipped else df


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null, or empty text."""
    keep = [F.col(c).isNotNull() & ((F.col(c) != "") if t == "string" else F.lit(True)) for c, t in df.dtypes if c in columns]
    return df.filter(reduce(lambda a, b: a & b, keep, F.lit(True)))


def token_stats(df: DataFrame, text: str, *by: str) -> DataFrame:
    n = word_count(F.col(text))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(n).cast("long").alias("total"), F.round(F.avg(n), 6).alias("mean"), F.max(n).cast("long").alias("most"))


def filtered_report(df: DataFrame, keep: Column) -> DataFrame:
    """(before, after, removed, percent) in one pass."""
    out = df.agg(F.count("*").alias("before"), F.count_if(keep).alias("after"))
    return out.select("before", "after", (F.col("before") - F.col("after")).alias("removed"), F.round(100 * (F.col("before") - F.col("after")) / F.col("before"), 6).alias("percent"))


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """One row for each key, the first in order; the smallest order is found with partial sums, so a hot key is no burden."""
    first = df.groupBy(key.alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first.select("_first.*"), list(order), "left_semi")


def dedup_counts(df: DataFrame, key: Column) -> DataFrame:
    out = df.groupBy(key.alias("_key")).agg(F.count("*").alias("n"))
    return out.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("n") - 1).alias("rejected"))


#: Longest piece of a short string's first, last or only word that its key is made of.
PIECE, ONE_WORD = 4, 8


def _hashed_grams(hashes: Column, gram: int) -> Column:
    """Of an array of word hashes the hash of every `gram` neighbours."""
    return F.when(F.size(hashes) >= gram, F.transform(F.sequence(F.lit(0), F.size(hashes) - gram), lambda i: F.xxhash64(F.slice(hashes, i + 1, gram))))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _string_key(words: Column, gram: int) -> tuple[Column, Column]:
    """(length class, key) of a benchmark string, given its words.

    gram + 2 words or more: class 0, the hash of its second to (gram + 1)th word. Fewer, but
    two at least: the class tells how many there are, and how many letters of the first and
    of the last take part (up to PIECE; a text may go on there); the key is the hash of these
    letters and all words between. One word: its first 1, 2, 4 or 8 letters.
    """
    n, first, last = F.size(words), F.get(words, 0), F.element_at(words, -1)
    head, tail = F.least(F.length(first), F.lit(PIECE)), F.least(F.length(last), F.lit(PIECE))
    one = F.least(F.lit(ONE_WORD), F.pow(F.lit(2), F.floor(F.log2(F.length(first)))).cast("int"))
    kind = F.when(n >= gram + 2, 0).when(n == 1, one).otherwise(100 * n + 10 * head + tail)
    inner = F.slice(_word_hashes(words), 2, F.greatest(n - 2, F.lit(0)))
    several = F.xxhash64(kind, F.right(first, head), inner, F.left(last, tail))
    long = F.get(_hashed_grams(F.slice(_word_hashes(words), 2, gram), gram), 0)
    return kind, F.when(n >= gram + 2, long).when(n == 1, F.xxhash64(kind, F.left(first, one))).otherwise(several)


def _text_keys(words: Column, kinds: list[int], gram: int) -> Column:
    """All keys, of the given length classes, of the strings that a text of these words can contain."""
    def pieces(w: Column, q: int) -> Column:
        one = lambda x: F.when(F.length(x) >= q, F.transform(F.sequence(F.lit(1), F.length(x) - (q - 1)), lambda i: F.xxhash64(F.lit(q), F.substr(x, i, F.lit(q)))))
        return F.flatten(F.filter(F.transform(F.array_distinct(w), one), lambda x: x.isNotNull()))

    def windows(w: Column, h: Column, n: int, head: int, tail: int) -> Column:
        def one(i: Column) -> Column:
            first, last = F.get(w, i), F.get(w, i + (n - 1))
            key = F.xxhash64(F.lit(100 * n + 10 * head + tail), F.right(first, F.lit(head)), F.slice(h, i + 2, n - 2), F.left(last, F.lit(tail)))
            return F.when((F.length(first) >= head) & (F.length(last) >= tail), key)

        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), one))

    def keys(w: Column, h: Column) -> Column:
        lists = [_hashed_grams(h, gram) if k == 0 else pieces(w, k) if k < 100 else windows(w, h, k // 100, k // 10 % 10, k % 10) for k in kinds]
        return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<bigint>")) for x in lists]))

    return let(words, lambda w: let(_word_hashes(w), lambda h: keys(w, h)))


def contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = 8) -> DataFrame:
    """(doc_id, item_id): documents whose normalised text contains a benchmark string.

    Texts and strings meet by equal keys, one for each string: of its words that a text must
    have whole, and of a few letters of those that a text may go on with. A text has a key
    for each place where a string of one of the length classes in use could stand; classes
    are few, however many strings there are. What meets is verified. A benchmark of up to
    BROADCAST_BYTES is measured and broadcast, and texts do not move (but for a small table,
    see spread()); beyond it keys meet in a shuffle, and texts follow for candidates only. A text is normalised once: `explode`
    keeps the optimizer from repeating the expression.

    Null texts and strings, and strings of white space, contain and are contained in nothing.
    """
    norm = lambda c: F.explode_outer(F.array(normalized(F.col(c))))
    d = spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", norm("text").alias("t"))
    b = benchmark.select("item_id", norm("text").alias("b")).filter("b <> ''").withColumn("w", F.split("b", " "))
    kind, key = _string_key(F.col("w"), gram)
    b = b.select("item_id", "b", kind.cast("int").alias("kind"), key.alias("h"))
    size, kinds = b.agg(F.coalesce(F.sum(F.octet_length("b")), F.lit(0)), F.sort_array(F.collect_set("kind"))).first()  # kinds: 164 at most
    b = b.select("item_id", "b", "h")
    keys = F.explode_outer(_text_keys(F.split("t", " "), kinds, gram)).alias("h") if kinds else F.lit(None).cast("long").alias("h")
    if size <= BROADCAST_BYTES:
        return d.select("doc_id", "t", keys).join(F.broadcast(b), "h").filter(F.contains("t", "b")).select("doc_id", "item_id").distinct()
    hits = d.select("doc_id", keys).join(b.select("h", "item_id"), "h").select("doc_id", "item_id").distinct()
    return d.join(hits, "doc_id").join(b.select("item_id", "b"), "item_id").filter(F.contains("t", "b")).select("doc_id", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, gram: int = 8) -> DataFrame:
    return docs.join(contaminated(docs, benchmark, gram).select("doc_id").distinct(), "doc_id", "left_anti")


#: Of keyed permutations: a prime below 2^31, so that products fit a long, the rounds, and what a round adds to the key.
PRIME, ROUNDS, ROUND_STEP = 2_147_483_647, 6, 715_827_883
#: Steps after which a walk is over in every table: at most as many numbers are out of range, or one in sixty and more of them.
WALK = 64


def permuted(v: Column, m: int, key: Column) -> Column:
    """v, from 0 to m - 1, under the permutation of these numbers that the key names.

    A number is two digits, of bases near the root of m; each round adds to one digit a mix
    of the other and the key, which can be undone, so rounds permute all pairs. A pair
    beyond m is permuted again until it is below: there are fewer of those than the base.
    """
    a = max(1, math.isqrt(m - 1) + 1)
    b = -(-m // a)
    prime = F.lit(PRIME).cast("long")

    def rounds(x: Column) -> Column:
        digits = F.struct(F.floor(x / b).cast("long").alias("x"), F.pmod(x, F.lit(b)).cast("long").alias("y"))
        out = digits
        for i in range(ROUNDS):
            out = _round(out, i)
        return let(out, lambda s: s["x"] * b + s["y"])

    def _round(s: Column, i: int) -> Column:
        k = F.pmod(key + i * ROUND_STEP, prime)
        mixed = lambda o: F.pmod(F.pmod(o + k, prime) * F.pmod(o * 3 + k * 7 + 11, prime), prime)
        if i % 2 == 0:
            return let(s, lambda d: F.struct(F.pmod(d["x"] + mixed(d["y"]), F.lit(a)).cast("long").alias("x"), d["y"].alias("y")))
        return let(s, lambda d: F.struct(d["x"].alias("x"), F.pmod(d["y"] + mixed(d["x"]), F.lit(b)).cast("long").alias("y")))

    if m <= 1:
        return v
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(a * b - m, WALK))), rounds(v), lambda x, _: F.when(x < m, x).otherwise(rounds(x))) if a * b > m else rounds(v)
    return walk


def sample_others(df: DataFrame, key: str, count: int = 4, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """(key, other): `count` other keys for each, or all there are, without replacement; each row's draws are its own.

    Rows are numbered by key; a row's draws are the first numbers of a permutation of all
    others that seed and number name, so nothing is remembered and one join by number finds
    the keys. Ties of key are numbered in any order.
    """
    n = df.count()
    ring = numbered(df.select(key), key, name="_at", groups=buckets).withColumn("_at", (F.col("_at") - 1).cast("long"))
    if n < 2:
        return ring.select(key, F.col(key).alias("other")).limit(0)
    p = F.lit(PRIME).cast("long")
    own = F.pmod(F.pmod(F.col("_at"), p) * 48271 + F.floor(F.col("_at") / PRIME).cast("long") * 69621 + seed * 40692 + 1, p)
    draws = ring.select(key, "_at", own.alias("_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(count, n - 1) - 1).cast("long"))).alias("_d"))
    drawn = draws.select(key, "_at", permuted(F.col("_d"), n - 1, F.col("_key")).alias("_v"))
    wanted = drawn.select(key, F.when(F.col("_v") >= F.col("_at"), F.col("_v") + 1).otherwise(F.col("_v")).alias("_to"))
    return wanted.join(ring.select(F.col(key).alias("other"), F.col("_at").alias("_to")), "_to").select(key, "other")
