"""Benchmark strings of every length, against a search of every text for every string."""

import random
import re

import pytest

from gridloom.operators import corpus


def plain(docs, bench):
    norm = lambda t: re.sub(r"\A | \Z", "", re.sub(r"\s+", " ", (t or "").lower()))
    texts = {i: norm(t) for i, t in docs}
    return sorted((i, k) for k, s in bench if norm(s) for i, t in texts.items() if norm(s) in t)


def strings(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "ab", "cat", "concatenate", "é", "語語", "tea", "eat", "x" * 9, "the", "theatre"])
    docs = [(i, rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randint(0, 40)))) for i in range(80)]
    whole = [t.split() for _, t in docs if len(t.split()) > 13]
    bench = []
    for k in range(150):
        w = rng.choice(whole)
        n = rng.randint(1, 13)
        at = rng.randrange(len(w) - n + 1)
        s = " ".join(w[at : at + n])
        if rng.random() < 0.7:  # cut inside the first and the last word
            s = s[rng.randrange(len(w[at])) :]
            s = s[: len(s) - rng.randrange(len(s.split()[-1]))]
        if rng.random() < 0.2:
            s += rng.choice(["q", " q", "z z"])
        bench.append((k, rng.choice([s, s.upper(), s.replace(" ", " \t ")])))
    return [*docs, (1000, None), (1001, ""), (1002, " \n")], [*bench, (900, None), (901, "  "), (902, bench[0][1])]


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_strings_of_every_length(spark, monkeypatch, broadcast):
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", broadcast)
    docs, bench = strings(1)
    want = plain(docs, bench)
    assert len({k for _, k in want}) > 90
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(map(tuple, corpus.contaminated(d, b).collect())) == want
    assert sorted(r.doc_id for r in corpus.decontaminate(d, b).collect()) == sorted({i for i, _ in docs} - {i for i, _ in want})


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_no_plan_compares_every_text_with_every_string(spark, monkeypatch, broadcast):
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", broadcast)
    docs, bench = strings(2)
    out = corpus.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_replace") <= 2 * (2 if broadcast else 4)  # two for each table, each time that it is read


def test_a_benchmark_of_forty_megabytes(spark):
    """Strings of a million words beside short ones; beyond the broadcast, so keys meet in a shuffle."""
    from pyspark.sql import functions as F

    bench = spark.range(4_000).select(F.col("id").alias("item_id"), F.concat(F.lit("start "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1_400)), lambda i: F.concat(F.lit("w"), (F.col("id") * 1_401 + i).cast("string"))), " ")).alias("text"))
    short = spark.createDataFrame([(10_000, "needle"), (10_001, "two words"), (10_002, "nobody has this")], "item_id long, text string")
    docs = bench.filter("item_id % 1000 = 7").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("re"), "text", F.lit(" end")).alias("text")).union(spark.createDataFrame([(-1, "a needlework of two wordsmiths"), (-2, "start w1")], "doc_id long, text string"))
    assert bench.agg(F.sum(F.octet_length("text"))).first()[0] > 40_000_000
    want = [(-1, 10_000), (-1, 10_001), *((k, k) for k in range(7, 4_000, 1000))]
    assert sorted(map(tuple, corpus.contaminated(docs, bench.union(short)).collect())) == want
