import brute
import corpus_pipeline
from brute import table
from pyspark.sql import functions as F

from gridloom.llm import queries


def test_stages_and_queries_are_complete():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "repeated_passages", "secret_scan", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_each_stage_by_brute_force(spark, corpus):
    token = "0123456789abcdef0123"
    rows = [*corpus, (60, f"my password = {token} stays here"), (61, "12 34 !!"), (60, f"my password = {token} stays here"), (None, "a text without an id")]
    docs = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted((r[0] for r in d.select("doc_id").collect()), key=repr)

    one = stage["language_id"](spark, docs, None).cache()
    assert one.columns == columns
    assert ids(one) == sorted((i for i, t in rows if any(c.isalpha() for c in t or "")), key=repr)

    two = stage["near_dedup"](spark, one, None).cache()
    left = sorted(((r.doc_id, r.text) for r in one.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    first = [left[i][0] for i in sorted(set(brute.similar_groups(left)))]
    assert two.columns == columns and ids(two) == sorted(first, key=repr)

    three = stage["repeated_passages"](spark, two, None).cache()
    inside = [(r.doc_id if r.doc_id is not None else 10**9, r.text) for r in two.collect()]
    cut = {i: n for i, _, n, _ in brute.repeated_words(inside)}
    assert three.columns == columns and three.count() == sum(1 for i, t in inside if cut[i] < len(brute.words(t)) or not cut[i])
    for r in three.collect():
        before = dict(inside)[r.doc_id if r.doc_id is not None else 10**9]
        assert len(brute.words(r.text)) == len(brute.words(before)) - cut[r.doc_id if r.doc_id is not None else 10**9]
        assert r.n_chars == len(r.text)

    four = stage["secret_scan"](spark, three, None).cache()
    assert four.columns == columns and four.count() == three.count()
    assert four.filter("doc_id = 60").first().text == "my [SECRET] stays here"
    assert not any(brute.base_spans(r.text) for r in four.collect())

    five = stage["packing"](spark, four, None)
    assert five.select("doc_id").distinct().count() == four.count()


def test_run_keeps_clean_documents(spark, tmp_path, corpus):
    docs = table(spark, [(i, t) for i, t in corpus if i >= 7])
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.select("doc_id").distinct().count() >= 20


def test_rows_that_share_an_id_or_have_none(spark):
    near = dict(corpus_pipeline.STAGES)["near_dedup"]
    rows = [(7, "one text of this id"), (7, "and quite another one"), (None, "twice without an id"), (None, "twice without an id"), (8, "twice without an id")]
    assert sorted((r.doc_id, r.text) for r in near(spark, table(spark, rows), None).collect()) == [(7, "and quite another one"), (7, "one text of this id"), (8, "twice without an id")]
    rows = rows[2:4]
    assert near(spark, table(spark, rows), None).count() == 1


def test_stages_on_an_empty_table_and_a_long_text(spark):
    long = " ".join(f"w{k % 9973}" for k in range(300_000))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), None).count() == 0
        assert stage(spark, table(spark, [(1, long), (2, "a short one")]), None).select("doc_id").distinct().count() == 2
