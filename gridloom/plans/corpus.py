"""Corpus queries over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalized, squeeze, word_count
from ..operators import corpus as C
from .registry import query

NORM = r"trim(regexp_replace(lower({}),'\s+',' ','g'))"
SQUEEZE = r"trim(regexp_replace({},'\s+',' ','g'))"
WORDS = f"CASE WHEN {SQUEEZE.format('text')} = '' THEN 0 ELSE len(string_split({SQUEEZE.format('text')}, ' ')) END"
_DIRTY = f"SELECT DISTINCT d.doc_id, b.item_id FROM (SELECT doc_id, {NORM.format('text')} t FROM documents) d, (SELECT item_id, {NORM.format('text')} b FROM benchmark) b WHERE b.b <> '' AND contains(d.t, b.b)"


@query(f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_DIRTY}))")
def decontaminate_substring(t):
    return C.decontaminate(t("documents"), t("benchmark")).select("doc_id", "source")


@query(f"SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_DIRTY})) GROUP BY source")
def decontaminate_by_source(t):
    return C.decontaminate(t("documents"), t("benchmark")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT item_id, count(*) AS docs FROM ({_DIRTY}) GROUP BY item_id")
def contamination_report(t):
    return C.contaminated(t("documents"), t("benchmark")).groupBy("item_id").agg(F.count("*").alias("docs"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_exact_keep_first(t):
    return C.keep_first(t("documents"), F.col("text"), "doc_id").select("doc_id")


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {NORM.format('text')}")
def dedup_normalized(t):
    return C.keep_first(t("documents"), F.md5(normalized(F.col("text"))), "doc_id").select("doc_id")


@query("SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, sum(n-1)::BIGINT AS rejected FROM (SELECT count(*) n FROM documents GROUP BY text)")
def dedup_counts(t):
    return C.dedup_counts(t("documents"), F.md5("text"))


@query(f"SELECT doc_id, {WORDS} AS words FROM documents WHERE {WORDS} < 300")
def token_budget_filter(t):
    return C.within_budget(t("documents"), "text", limit=300).select("doc_id", word_count(F.col("text")).cast("long").alias("words"))


@query(f"SELECT source, count(*) AS rows, sum(w)::BIGINT AS total, round(avg(w), 6) AS mean, max(w)::BIGINT AS most FROM (SELECT source, {WORDS} AS w FROM documents) GROUP BY source")
def token_stats_by_source(t):
    return C.token_stats(t("documents"), "text", "source")


@query(f"SELECT doc_id, (CASE WHEN {WORDS} < 4000 THEN 16 ELSE 4 END)::INT AS batch FROM documents")
def length_bucket_batch(t):
    return t("documents").select("doc_id", C.length_bucket(word_count(F.col("text"))).cast("int").alias("batch"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('0-', doc_id)), doc_id) <= floor(0.95 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents")
def split_95_5(t):
    return C.ordered_split(t("documents").select("doc_id"), "doc_id")


_FRACTIONS = {"src0": 0.5, "src1": 0.3, "src2": 1.0, "src3": 0.0}


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) rn, count(*) OVER (PARTITION BY source) n FROM documents) WHERE rn <= floor(n * CASE source WHEN 'src0' THEN 0.5 WHEN 'src1' THEN 0.3 WHEN 'src2' THEN 1.0 ELSE 0.0 END)")
def mix_fractions(t):
    return C.mix(t("documents").select("source", "doc_id"), "source", "doc_id", _FRACTIONS)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7")
def first_of_each_source(t):
    return C.first_of_each(t("documents").select("source", "doc_id"), "source", "doc_id", 7)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 300)::BIGINT AS batch FROM documents")
def batch_ids(t):
    return C.batch_of(t("documents").select("doc_id"), 300, "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7-', doc_id)), doc_id) AS rn FROM documents QUALIFY rn <= 100")
def seeded_shuffle_topn(t):
    first = t("documents").select("doc_id").orderBy(*C.seeded_order(7, "doc_id")).limit(100)  # each task keeps 100
    return C.numbered(first, *C.seeded_order(7, "doc_id"), groups=1)


@query(f"SELECT doc_id, md5({SQUEEZE.format('text')}) AS digest FROM documents")
def whitespace_normalize(t):
    return t("documents").select("doc_id", F.md5(squeeze(F.col("text"))).alias("digest"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def page_of_rows(t):
    return C.page(t("documents").select("doc_id"), "doc_id", 40, 20)


@query("SELECT count(*) AS before, count(*) FILTER (n_chars < 1000) AS after, count(*) - count(*) FILTER (n_chars < 1000) AS removed, round(100.0 * (count(*) - count(*) FILTER (n_chars < 1000)) / count(*), 6) AS percent FROM documents")
def filtered_report(t):
    return C.filtered_report(t("documents"), F.col("n_chars") < 1000)


def _draw_sql(count: int, seed: int) -> str:
    """Each row's own permutation of the others, by the rounds of C.permuted(), walked on until it is in range."""
    p = C.PRIME
    steps, at = ["v // b AS x0, v % b AS y0"], {"x": 0, "y": 0}
    for i in range(C.ROUNDS):
        one, other, base = ("x", "y", "a") if i % 2 == 0 else ("y", "x", "b")
        k, o = f"((k + {i * C.ROUND_STEP}) % {p})", f"{other}{at[other]}"
        steps.append(f"({one}{at[one]} + (({o} + {k}) % {p}) * (({o} * 3 + {k} * 7 + 11) % {p}) % {p}) % {base} AS {one}{at[one] + 1}")
        at[one] += 1
    new = f"x{at['x']} * b + y{at['y']}"
    return f"""WITH RECURSIVE r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () - 1 AS m FROM documents),
s AS (SELECT *, (place % {p} * 48271 + place // {p} * 69621 + {seed} * 40692 + 1) % {p} AS k, CAST(ceil(sqrt(m)) AS BIGINT) AS a FROM r), t AS (SELECT *, (m + a - 1) // a AS b FROM s),
w AS (SELECT doc_id, place, m, k, a, b, d, d AS v, 0 AS step FROM t, generate_series(0, {count - 1}) g(d) WHERE d < m
  UNION ALL SELECT doc_id, place, m, k, a, b, d, new AS v, step + 1 FROM (SELECT *, {new} AS new FROM (SELECT *, {', '.join(steps)} FROM w WHERE step = 0 OR v >= m)))
SELECT w.doc_id, r.doc_id AS other FROM w JOIN r ON r.place = CASE WHEN w.v >= w.place THEN w.v + 1 ELSE w.v END WHERE step > 0 AND v < w.m"""


@query(_draw_sql(4, 3))
def distractors(t):
    return C.sample_others(t("documents"), "doc_id", 4, 3)


@query("SELECT item, array_to_string(list_sort(list_distinct(list(source))), ',') AS keys FROM (SELECT source, unnest(string_split(lang || ',' || source, ',')) item FROM documents) GROUP BY item")
def concept_index(t):
    from ..operators.ledger import inverted_index

    out = inverted_index(t("documents").select("source", F.array("lang", "source").alias("items")), "source", "items")
    return out.select("item", F.array_join("keys", ",").alias("keys"))  # a segment holds more keys than there are sources


@query("WITH p AS (SELECT DISTINCT p_brand AS item, p_partkey AS k FROM part UNION SELECT DISTINCT 'all', p_partkey FROM part), n AS (SELECT item, k, (row_number() OVER (PARTITION BY item ORDER BY k) - 1) // 100 AS segment FROM p) SELECT item, segment::BIGINT AS segment, count(*) AS n, md5(string_agg(k::VARCHAR, ',' ORDER BY k)) AS digest FROM n GROUP BY item, segment")
def concept_segments(t):
    from ..operators.ledger import inverted_index

    out = inverted_index(t("part").select("p_partkey", F.array("p_brand", F.lit("all")).alias("items")), "p_partkey", "items", 100)
    return out.select("item", "segment", F.size("keys").cast("long").alias("n"), F.md5(F.array_join(F.transform("keys", lambda k: k.cast("string")), ",")).alias("digest"))
