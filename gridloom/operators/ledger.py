"""Ledgers: lookups, lineage, resume, cost, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, stored


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(key), key, "left_anti")


def exists_or_missing(wanted: DataFrame, found: DataFrame, key: str, path: str, rank: str) -> DataFrame:
    """(key, found, path): the first hit by rank for every wanted key."""
    first = found.groupBy(key).agg(F.min_by(path, rank).alias(path))
    return wanted.select(key).distinct().join(first, key, "left").select(key, F.col(path).isNotNull().alias("found"), path)


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n, unique) by partial counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("is_unique", F.col("n") == 1)


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key is not unique."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key), key, "left_semi")


def lineage(rows: DataFrame, depth: int = 3) -> DataFrame:
    """(id, ancestor_1, ...): the chain of prev_step_id links up to a depth, null after its end."""
    out, link = rows.select("id", F.col("prev_step_id").alias("ancestor_1")), rows.select(F.col("id").alias("_id"), F.col("prev_step_id").alias("_prev"))
    for k in range(2, depth + 1):
        out = out.join(link, out[f"ancestor_{k - 1}"] == link["_id"], "left").drop("_id").withColumnRenamed("_prev", f"ancestor_{k}")
    return out


def lineage_roots(rows: DataFrame, key: str = "id", previous: str = "prev_step_id") -> DataFrame:
    """(key, root, depth, cyclic): where each row's chain of predecessors begins and how many steps back that is.

    Pointer doubling: a row points at an ancestor 1, 2, 4, ... steps back until that is a
    root, so a chain of a million steps takes twenty joins, each of the rows still on their
    way with all rows. A row without a predecessor, or whose predecessor is not in the table,
    is its own root at depth 0. As long as some chain still ends, each round ends some; when a
    round ends none, what is left leads into a cycle: root and depth null, cyclic true. Of
    rows with one key the smallest predecessor counts; null keys go.
    """
    links = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(previous).alias("prev"))
    known = links.select(F.col("id").alias("prev"), F.lit(True).alias("_there"))
    state = links.join(known, "prev", "left").select("id", F.when(F.col("_there"), F.col("prev")).otherwise(F.col("id")).alias("to"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("steps"), F.col("_there").isNull().alias("ended"))
    (state, path), before = stored(state, "lineage"), None
    while (left := state.filter("NOT ended").count()) and left != before:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("ended").alias("_ended"))
        moved = state.filter("NOT ended").join(ahead, "to").select("id", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_ended").alias("ended"))
        old, before = path, left
        state, path = stored(state.filter("ended").unionByName(moved), "lineage")
        dropped(rows.sparkSession, old)
    return state.select(F.col("id").alias(key), F.when(F.col("ended"), F.col("to")).alias("root"), F.when(F.col("ended"), F.col("steps")).alias("depth"), (~F.col("ended")).alias("cyclic"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): both, left or right."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("side"))


def usage_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage: (model, tokens_in, tokens_out); rates: (model, rate_in, rate_out) for a million tokens, a few rows."""
    sums = usage.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost = (F.col("tokens_in") * F.col("rate_in") + F.col("tokens_out") * F.col("rate_out")) / 1e6
    return sums.join(rates, "model", "left").select("model", "tokens_in", "tokens_out", F.round(cost, 6).alias("cost"))


def find_columns(df: DataFrame, values: list[str]) -> DataFrame:
    """(column, hits): text columns that hold one of the values, counted in one pass."""
    names = [n for n, t in df.dtypes if t == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, hits long")
    counts = df.agg(*[F.count_if(F.col(f"`{n}`").isin(values)).alias(n) for n in names])
    return counts.unpivot([], names, "column", "hits").filter("hits > 0")


def find_in_tables(tables: dict[str, DataFrame], values: list[str]) -> DataFrame:
    """(table, column, hits): text columns of all tables that hold one of the values."""
    parts = [find_columns(df, values).select(F.lit(name).alias("table"), "column", "hits") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def search(df: DataFrame, value, columns: list[str], order: str, low: int, high: int) -> DataFrame:
    """Rows with order in [low, high) where some column has the value, and whether there is just one."""
    hit = reduce(lambda a, b: a | b, [F.col(c).cast("string") == str(value) for c in columns])
    rows = df.filter(F.col(order).between(low, high - 1) & hit)
    return rows.crossJoin(F.broadcast(rows.agg((F.count("*") == 1).alias("is_unique"))))  # one row


def bulk_update(df: DataFrame, column: str, match: str, values: list, new) -> DataFrame:
    return df.withColumn(column, F.when(F.col(match).isin(values), F.lit(new)).otherwise(F.col(column)))


def merge_counts(long: DataFrame, reason: str = "reason", n: str = "n") -> DataFrame:
    """Counters added up by reason; nested counters have dotted reasons."""
    return long.groupBy(reason).agg(F.sum(n).alias(n))


def normalized_records(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their first name: the first alias that is not empty, else empty text."""
    have = set(df.columns)
    pick = lambda names: F.coalesce(*[F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in have], F.lit(""))
    return df.select(*[pick([k, *v]).alias(k) for k, v in aliases.items()])


def cached(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(requests with their cached values, requests without one)."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


#: Keys in a segment of a posting list.
SEGMENT = 1_000


def inverted_index(rows: DataFrame, key: str, items: str, segment: int = SEGMENT) -> DataFrame:
    """(item, segment, keys): distinct keys of every item in order, at most `segment` of them in a row, segments numbered from 0.

    An item that all rows share has many segments: distinct pairs are sorted by range and
    numbered by ranges inside each item, so neither a task nor a row holds all of an item's
    keys. Null items and keys are passed over.
    """
    from .corpus import numbered

    pairs = rows.select(F.col(key).alias("_key"), F.explode(items).alias("item")).filter("item IS NOT NULL AND _key IS NOT NULL").distinct()
    placed = numbered(pairs, "item", "_key", name="_at")
    first = placed.groupBy("item").agg(F.min("_at").alias("_first"))
    cut = placed.join(first, "item").select("item", "_key", F.floor((F.col("_at") - F.col("_first")) / segment).cast("long").alias("segment"))
    return cut.groupBy("item", "segment").agg(F.sort_array(F.collect_list("_key")).alias("keys"))
