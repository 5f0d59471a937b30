"""Exact search in an inverted file; streaming with keyed state."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import retrieval
from gridloom.streaming import ingest


def clustered(seed, n, size=12, groups=20):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, size))
    group = np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))  # a third lie in one
    return (centre[group] + 0.05 * rng.normal(size=(n, size))).astype(np.float32)


def full(v, queries, k):
    u = v.astype(float)
    out = []
    for q in queries:
        scored = sorted((-float(u[q] @ u[i] / np.sqrt(u[q] @ u[q]) / np.sqrt(u[i] @ u[i])), i) for i in range(len(u)))
        out += [(q, i, round(-s, 9), r) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_cells_give_what_the_full_product_gives(spark):
    v = clustered(1, 3000)
    v[10] = v[11] = v[12]  # ties, by item
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, [0.0] * 12), (9002, None)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    queries = items.filter("vec_id % 20 = 0 OR vec_id = 12").select(F.col("vec_id").alias("query_id"), "embedding")
    index = retrieval.CellIndex(items, cells=25, sample=500)
    scored = spark.sparkContext.accumulator(0)
    got = index.top_k(queries, 5, scored=scored).select("query_id", "vec_id", "score", "rank")
    n = queries.count()
    assert sorted((r[0], r[1], round(r[2], 9), r[3]) for r in got.collect()) == full(v, [*range(0, 3000, 20), 12], 5)
    assert 0 < scored.value < 0.4 * n * 3000
    want = retrieval.top_k(queries, items, 5).select("query_id", "vec_id", "rank")
    assert sorted(map(tuple, got.select("query_id", "vec_id", "rank").collect())) == sorted(map(tuple, want.collect()))
    assert index.top_k(queries.limit(0), 5).count() == 0
    index.drop()


def test_cells_without_clusters_or_with_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)  # queries in blocks
    v = np.random.default_rng(2).normal(size=(200, 30)).astype(np.float32)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    queries = items.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = retrieval.CellIndex(items, cells=9).top_k(queries, 4).select("query_id", "vec_id", "score", "rank").collect()
    assert sorted((r[0], r[1], round(r[2], 9), r[3]) for r in got) == full(v, range(0, 200, 20), 4)
    three = items.filter("vec_id < 3")
    got = retrieval.CellIndex(three, cells=9).top_k(queries.filter("query_id = 0"), 4)
    assert sorted((r.vec_id, r["rank"]) for r in got.collect()) and got.count() == 3
    assert retrieval.CellIndex(items.limit(0)).top_k(queries, 4).count() == 0


def test_each_key_once_over_landings_and_restarts(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i % 40 if i % 10 else None, at + dt.timedelta(hours=i), f"v{i}") for i in range(120)]
    schema = "id long, ts timestamp, v string"
    for k, part in enumerate([rows[60:90], rows[:60] + rows[60:70], rows[90:] + rows[:5]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/land/{k}")
        source = ingest.landing(spark, f"{tmp_path}/land/*", spark.createDataFrame([], schema).schema)
        for _ in range(2):  # the second finds nothing new
            ingest.resumed(source, "id", f"{tmp_path}/out", f"{tmp_path}/state")
    got = [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=str) == sorted({r[0] for r in rows}, key=str)
    assert "RocksDB" not in str(spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""))


def test_distinct_within_a_delay(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    hour = lambda h: at + dt.timedelta(hours=h)
    schema = "id long, ts timestamp"
    landings = [[(1, hour(0)), (1, hour(1)), (2, hour(5)), (3, hour(100))], [(3, hour(101)), (2, hour(99)), (4, hour(98)), (5, hour(50)), (1, hour(120))]]
    for k, part in enumerate(landings):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/land/{k}")
        ingest.resumed(ingest.landing(spark, f"{tmp_path}/land/*", spark.createDataFrame([], schema).schema), "id", f"{tmp_path}/out", f"{tmp_path}/state", "ts", "10 hours")
    got = sorted((r.id, (r.ts - at).total_seconds() // 3600) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [i for i, _ in got] == [1, 1, 2, 2, 3, 4]  # 5 is later than ten hours; 1 and 2 come again long after, 3 at once
