import brute
import numpy as np
import pytest
from brute import table
from pyspark.sql import functions as F

from gridloom.llm import windows as W
from gridloom.llm.common import keyed
from gridloom.llm.substring_dedup import FingerprintIndex, id_ranges, remove_repeated_words
from gridloom.llm.suffix_dedup import remove_repeated_bytes

def cut():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def words_out(out):
    return sorted(tuple(r) for r in out.select("row.doc_id", "n_words", cut(), F.sha2(F.col("kept_text").cast("binary"), 256)).collect())


def bytes_out(out):
    return sorted(tuple(r) for r in out.select("row.doc_id", "n_bytes", cut(), F.size("spans"), F.sha2("kept", 256)).collect())


def test_leftmost_min_is_the_first_of_the_least():
    v = np.array([5, 3, 9, 3, 8, 1, 1, 7], np.uint64) << np.uint64(30)
    assert W.leftmost_min(v, 3).tolist() == [int(v[i : i + 3].argmin()) + i for i in range(6)]


def test_equal_windows_own_equal_anchors_in_any_stretch():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 2**63, 3000).astype(np.uint64)
    t[2000:2200] = t[100:300]
    bounds = np.array([0, 1000, 3000])
    whole = W.records(lambda a, b: t[a:b], bounds, 50, 12)
    pieces = W.records(lambda a, b: t[a:b], bounds, 50, 12, size=90)
    count = lambda r: sum(((r[3] >> 8 & 255) + 1) * r[4])
    assert count(whole) == count(pieces) == 951 + 1951
    assert len(set(whole[1]) & set(pieces[1])) > 0.9 * len(set(whole[1]))


def test_words_match_the_pattern(corpus):
    import pyarrow as pa

    data, offsets = W.utf8(pa.array([t for _, t in corpus]))
    for size in (50, 1 << 20):
        s, e, _, bounds = W.words(data, offsets, size)
        raw = data.tobytes()
        for k, (_, t) in enumerate(corpus):
            assert [raw[a:b].decode() for a, b in zip(s[bounds[k] : bounds[k + 1]], e[bounds[k] : bounds[k + 1]])] == brute.words(t)


@pytest.mark.parametrize("together", [1, 4096])
def test_repeated_words(spark, corpus, together):
    out = remove_repeated_words(table(spark, corpus), together=together)
    assert words_out(out) == sorted(brute.repeated_words(corpus))


@pytest.mark.parametrize("together", [1, 4096])
@pytest.mark.parametrize("batches", [1, 3])
def test_every_place_of_a_run_that_is_partly_repeated(spark, together, batches):
    w = [f"w{k}" for k in range(400)]
    a, p, b, x = (" ".join(w[i:j]) for i, j in ((0, 60), (60, 140), (140, 200), (200, 260)))
    rows = [(1, f"{x} {p} {a}"), (2, f"{a} {p} {b} {x} {p} {b} {a}"), (2, f"{b} {p} {b} {p} {b}"), (3, f"{p} {b} {p} {b}"), (4, f"{p} {a} {p} {b} {p}")]
    out = remove_repeated_words(table(spark, rows), together=together, batches=batches)
    assert words_out(out) == sorted(brute.repeated_words(rows))


@pytest.mark.parametrize("together", [1, 4096])
def test_repeated_bytes(spark, corpus, together):
    out = remove_repeated_bytes(table(spark, corpus), together=together)
    assert bytes_out(out) == sorted(brute.repeated_bytes(corpus))


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(f"w{k}" for k in range(120))
    docs = table(spark, [(5, text), (5, text), (None, text), (9, "x " + text)])
    assert [(r[0], r[2]) for r in words_out(remove_repeated_words(docs).filter("row.doc_id IS NOT NULL"))] == [(5, 0), (5, 0), (9, 120)]
    assert words_out(remove_repeated_words(docs).filter("row.doc_id IS NULL").withColumn("row", F.struct(F.lit(0).alias("doc_id"))))[0][2] == 120
    assert {r[2] for r in bytes_out(remove_repeated_bytes(docs.filter("doc_id = 5")))} == {len(text)}


def test_empty_table(spark):
    docs = table(spark, [])
    assert remove_repeated_words(docs).count() == remove_repeated_bytes(docs).count() == 0


def test_runs_are_compacted_and_keep_the_smallest_id(spark, corpus):
    index = FingerprintIndex(spark, buckets=4, tasks=4)
    docs = keyed(table(spark, corpus))
    for low, high in id_ranges(docs, 4):
        seen = docs if high is None else docs.filter(F.col("_id") < high)
        index.ingest(seen.filter(F.col("_id") >= low), seen)
    assert 1 <= len(index.runs) <= 3
    sizes = [n for _, n in index.runs]
    assert all(a > index.ratio * b for a, b in zip(sizes, sizes[1:]))


def test_texts_that_linear_digests_confuse(spark):
    bits = [k.bit_count() % 2 for k in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rows = [(1, " ".join(["x"] * 49 + [one])), (2, " ".join(["x"] * 49 + [other])), (3, one), (4, other)]
    assert words_out(remove_repeated_words(table(spark, rows))) == sorted(brute.repeated_words(rows))
    assert bytes_out(remove_repeated_bytes(table(spark, rows))) == sorted(brute.repeated_bytes(rows))
    t = np.frombuffer((one + other).encode(), np.uint8)
    for family in range(4):
        d = W.Digests(t, family)
        at = np.arange(0, 1024)
        for width in (8, 9, 64, 512, 1024):
            assert len(set(zip(d.of(at, at + width).tolist()))) == len({bytes(t[i : i + width]) for i in at})
            assert d.of(at, at + width).tolist() == [int(W.Digests(t[i : i + width + 3], family).of(at[:1], at[:1] + width)[0]) for i in range(1024)]


@pytest.mark.parametrize("together", [1, 4096])
def test_periodic_texts(spark, together):
    rows = [(1, "a" * 900), (2, "ab" * 300 + "c" + "ab" * 200), (3, "xyz " * 120), (4, "a " * 90 + "b " * 90), (5, "q " * 40 + "xyz " * 70 + "q a " * 60), (6, "b " * 51 + "a " * 51 + "x")]
    assert bytes_out(remove_repeated_bytes(table(spark, rows), together=together)) == sorted(brute.repeated_bytes(rows))
    assert words_out(remove_repeated_words(table(spark, rows), together=together)) == sorted(brute.repeated_words(rows))


def test_a_long_text_of_one_letter(spark, tmp_path):
    n = 20 << 20
    spark.createDataFrame([(0, "a" * n), (1, "a " * (n // 2) + "end")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert {r[0]: r[1:4] for r in bytes_out(remove_repeated_bytes(docs))} == {0: (n, n, 1), 1: (n + 3, n, 1)}
    docs = docs.filter("doc_id = 1").unionByName(docs.filter("doc_id = 1").selectExpr("doc_id + 1 AS doc_id", "text"))
    assert [r[:3] for r in words_out(remove_repeated_words(docs))] == [(1, n // 2 + 1, 0), (2, n // 2 + 1, n // 2 + 1)]


def test_no_more_buckets_than_tables_may_have(spark):
    assert FingerprintIndex(spark, buckets=200_000).buckets == int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))


def test_runs_are_joined_as_they_lie(spark, corpus):
    """No shuffle; no sort of a whole run, only of what a run has of the new hashes."""
    from gridloom.llm.common import settings
    from gridloom.llm.substring_dedup import MERGE, _merged

    docs = keyed(table(spark, corpus))
    index = FingerprintIndex(spark, buckets=3, tasks=2, ratio=0.0)
    for low, high in id_ranges(docs, 2):
        seen = docs if high is None else docs.filter(F.col("_id") < high)
        index.ingest(seen.filter(F.col("_id") >= low), seen).count()
    with settings(spark, **MERGE):
        whole = _merged(*[spark.table(n) for n, _ in index.runs])
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        distinct = len({tuple(r) for n, _ in index.runs for r in spark.table(n).select("h", "c").collect()})
        assert whole.count() == distinct
        new = index.runs[1][0]
        index.runs, runs = index.runs[:1], index.runs
        plan = index.known(new)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Sort [") == 1
        index.runs = runs
    before = spark.table(index.runs[0][0]).groupBy().sum("n").first()[0] + spark.table(index.runs[1][0]).groupBy().sum("n").first()[0]
    index.ratio = 1e9
    index.compact()
    assert len(index.runs) == 1 and spark.table(index.runs[0][0]).count() == distinct and spark.table(index.runs[0][0]).groupBy().sum("n").first()[0] == before
    index.close()
