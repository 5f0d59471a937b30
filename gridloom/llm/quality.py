"""Quality rules kept as a ledger: every rule is evaluated once, policies read bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

#: Rule -> its failing condition on the measurements; a rule's bit is its place here and never changes.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: Version -> the rules it enforces. Older versions stay, so that earlier decisions can be made again.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "short_words", "long_words"),
}


def policy_mask(version: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[version])


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def _repeat_words(docs: DataFrame, window: int = 5) -> DataFrame:
    """Adds n_repeat_words from `w`: words in windows found twice or more, the first included."""
    at = F.sequence(F.lit(0), F.size("w") - window)
    grams = F.when(F.size("w") >= window, F.transform(at, lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))
    docs = docs.withColumn("g", grams)
    # most texts repeat nothing and are done here
    pairs = F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    docs = docs.withColumn("p", pairs)
    same = lambda x, k: F.coalesce(F.get("p", k)["h"] == x["h"], F.lit(False))
    docs = docs.withColumn("r", F.sort_array(F.transform(F.filter("p", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    steps = F.transform("r", lambda x, k: F.least(F.lit(window), F.coalesce(F.get("r", k + 1) - x, F.lit(window))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("g", "p", "r")


def ledger(docs: DataFrame) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failures).

    failures has bit k set where rule k of RULES fails. Null text has no words and measures
    zero everywhere, so it fails few_words only; so does an empty text. Null ids, repeated
    rows and further columns pass through in `row`; an empty table gives an empty ledger.
    Texts of any length are measured whole, in memory for some fifty bytes a word. Everything is an expression on one row: nothing is shuffled.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("t", text)
    out = out.withColumn("w", words(F.col("t")))
    out = out.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    out = _repeat_words(out)
    out = out.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("t", "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    return out.withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def passes(version: str) -> Column:
    return F.col("failures").bitwiseAND(policy_mask(version)) == 0


def apply_policy(book: DataFrame, version: str = "v2") -> DataFrame:
    return book.filter(passes(version))


def ablations(book: DataFrame, version: str = "v2") -> DataFrame:
    """One row for each rule of the policy: how many rows fail it, fail it alone, and stay if it is left out.

    Rows are counted by failure mask first (at most 2 ** rules of them), then by bit.
    """
    mask = policy_mask(version)
    counts = book.groupBy(F.col("failures").bitwiseAND(mask).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("b")) for r in POLICIES[version]])).alias("x")
    long = counts.select("m", "n", rules)
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return long.groupBy(F.col("x.rule").alias("rule")).agg(
        n(F.col("m").bitwiseAND(F.col("x.b")) != 0).alias("failed"),
        n(F.col("m") == F.col("x.b")).alias("failed_alone"),
        n(F.col("m").bitwiseAND(F.lit(mask).cast("long").bitwiseXOR(F.col("x.b"))) == 0).alias("kept_without"),
    )
