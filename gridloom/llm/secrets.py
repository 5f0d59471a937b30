"""Secret scans through a trigram inverted index, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, keyed, tasks_for, written
from .trigrams import query


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `group` of a match must have `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds in the order of their spans. The first three are the base ones.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same runs as [0-9a-f]+ of 24 characters or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url_login", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%-]{3,}@"),
)
BASE = 3
#: Documents in one segment of a posting list, on average.
SEGMENT = 2048


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(block, postings): for each block of about SEGMENT documents a map from trigram to the keys of those that have it.

    docs: (key, text). Only trigrams that some rule asks for are indexed. A block bounds
    every list, so a trigram that all documents have is many segments, not one long list.
    """
    wanted = sorted({g for r in rules for clause in query(r.pattern) for a in clause for g in a})
    blocks = max(1, docs.count() // SEGMENT)
    lower = docs.select("key", F.pmod("key", F.lit(blocks)).alias("block"), F.lower("text").alias("t"))
    has = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in wanted]))
    postings = lower.select("block", "key", F.explode(has).alias("trigram"))
    segments = postings.groupBy("block", "trigram").agg(F.collect_set("key").alias("keys"))
    return segments.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))


def _with(bit: Column):
    return lambda x: F.struct(x.alias("key"), bit)


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): documents whose trigrams meet a rule's query, with a bit for each such rule."""
    none = F.array().cast("array<bigint>")
    of = lambda g: F.coalesce(F.col("postings")[g], none)
    found = []
    for k, rule in enumerate(rules):
        clauses = query(rule.pattern)
        if clauses:
            either = [reduce(F.array_union, [reduce(F.array_intersect, [of(g) for g in sorted(a)]) for a in sorted(c, key=sorted)]) for c in clauses]
            rule_bit = F.lit(1 << k).alias("bit")
            found.append(F.transform(reduce(F.array_intersect, either), _with(rule_bit)))
    hits = postings.select(F.explode(F.concat(*found)).alias("hit"))
    return hits.groupBy("hit.key").agg(F.bit_or("hit.bit").alias("rules"))


def _matches(text: Column, rule: Rule, k: int) -> Column:
    """Spans of a rule's leftmost matches that do not overlap, those that fail its length dropped: what stands between matches gives their places."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(F.split(text, rule.pattern).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["all"]), F.lit(0))
        good = x["all"].isNotNull() & (F.length(x["part"]) >= rule.least)
        span = F.struct(begin.alias("start"), F.lit(k).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(good, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda a: a["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, t: its text, spans: array of start, kind, end) for every row, by start and then kind; code points, end exclusive.

    A rule is matched only against documents that meet its trigram query; rules without
    mandatory trigrams against all. The index and the candidates hold keys only, and the
    texts meet them in one join. Two documents with one 64-bit key would only be matched
    against each other's candidates too. Null text: empty. Null ids and repeated rows are
    scanned like any other, and texts of any length whole; an empty table gives an empty result. `row` holds the input's
    columns, whatever their names.
    """
    tasks = tasks_for(docs)
    docs = keyed(docs).select("row", F.xxhash64("_id", "_fp").alias("key"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    postings = written(index(docs.select("key", text.alias("text")), rules), "trigrams", tasks)
    hits = written(candidates(postings, rules), "candidates", tasks)
    docs = docs.join(hits, "key", "left").select("row", F.coalesce("rules", F.lit(0)).alias("rules")).withColumn("t", text)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = []
    for k, rule in enumerate(rules):
        due = F.col("rules").bitwiseAND(1 << k) != 0 if query(rule.pattern) else F.lit(True)
        spans.append(F.when(due & F.rlike("t", F.lit(rule.pattern)), _matches(F.col("t"), rule, k)).otherwise(none))
    return few(docs.select("row", "t", F.array_sort(F.concat(*spans)).alias("spans")), tasks)


def written_spans(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by the mark."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        before = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        # spans that touch what is covered already extend it
        out = F.when((s["start"] < a["at"]) & (F.size(a["out"]) > 0), a["out"]).otherwise(F.array_append(a["out"], before))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, begin, step, lambda a: F.array_join(F.array_append(a["out"], F.substring(text, a["at"] + 1, F.length(text))), mark))
