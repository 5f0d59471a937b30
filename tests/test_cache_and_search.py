"""Cached answers, value search over tables, exports."""

import base64
import json

from pyspark.sql import functions as F

from gridloom.operators import ledger, models, problems


def test_cached_answers_and_what_is_lacking(spark):
    cache = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2990, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"), F.col("id").alias("ordinal"), F.concat(F.lit("a"), F.col("id")).alias("response")).repartition(6)
    requests = spark.createDataFrame([("hot", "p"), ("hot", "p"), ("k1", "q"), ("new", "r")], "key string, prompt string")
    got = models.cached_answers(requests, cache, 100).collect()
    assert sum(r.key == "hot" for r in got) == 100 and sum(r.key == "k1" for r in got) == 70 and len(got) == 170 == len({(r.key, r.ordinal) for r in got})
    assert {r.ordinal for r in got} == {r.ordinal for r in models.cached_answers(requests, cache.repartition(3), 100).collect()}
    assert {r.ordinal for r in got if r.key == "hot"} != {r.ordinal for r in models.cached_answers(requests, cache, 100, seed=1).collect() if r.key == "hot"}
    assert sorted((r.key, r.prompt, r.remaining) for r in models.lacking(requests, cache, 100).collect()) == [("k1", "q", 30), ("new", "r", 100)]
    assert models.lacking(requests, cache.limit(0), 2).count() == 3 and models.cached_answers(requests, cache.limit(0), 2).count() == 0


def test_values_in_all_tables(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", 2, "x")], "a string, n int, `c d` string")
    b = spark.createDataFrame([(1,)], "n int")
    got = sorted(map(tuple, ledger.find_in_tables({"a": a, "b": b}, ["x"]).collect()))
    assert got == [("a", "a", 1), ("a", "c d", 1)]
    assert [r.is_unique for r in ledger.search(a, "x", ["a", "c d"][:1], "n", 0, 9).collect()] == [True]
    assert ledger.search(a, "x", ["a"], "n", 2, 9).count() == 0


def test_an_export_is_one_line(spark):
    rows = spark.createDataFrame([("code" * 60, [([[1, 2]], [[2, 1]])])], "code string, examples array<struct<input:array<array<int>>,output:array<array<int>>>>")
    out = problems.annotated(rows, spark.createDataFrame([("none", "x")], "uid string, annotations string")).first()
    assert "\n" not in out.export and "\r" not in out.export and json.loads(base64.b64decode(out.export, validate=True))["code"] == "code" * 60
