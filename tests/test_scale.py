"""Chains of any depth, keyed permutations, long posting lists, capped lists."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.operators import corpus, ledger, scoring


def plain_roots(rows):
    prev = {}
    for i, p in rows:
        if i is not None:
            prev[i] = p if prev.get(i) is None else prev[i] if p is None else min(p, prev[i])
    out = []
    for i in prev:
        seen, at = [i], i
        while prev[at] in prev:
            at = prev[at]
            if at in seen:
                out.append((i, None, None, True))
                break
            seen.append(at)
        else:
            out.append((i, at, len(seen) - 1, False))
    return sorted(out)


def test_lineage_of_any_depth(spark):
    rows = [(i, i - 1 if i % 100 else None) for i in range(1, 300)]  # chains of a hundred
    rows += [(i, 7) for i in range(1000, 1050)]  # a predecessor that many share
    rows += [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (2004, 2003), (2005, 2005)]  # cycles and what leads into one
    rows += [(3000, 9999), (3001, 3000), (3000, None), (None, 5), (5, 4), (4, 1)]  # missing, repeated and null
    frame = spark.createDataFrame(rows, "id long, prev_step_id long")
    out = ledger.lineage_roots(frame)
    assert sorted(map(tuple, out.collect())) == plain_roots(rows)
    assert ledger.lineage_roots(frame.limit(0)).collect() == []
    names = frame.select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("uid"), F.concat(F.lit("s"), F.lpad(F.col("prev_step_id").cast("string"), 5, "0")).alias("after"))
    by_name = ledger.lineage_roots(names.filter("uid IS NOT NULL"), "uid", "after")
    assert {(r.uid, r.depth) for r in by_name.collect()} == {(f"s{i:05}", d) for i, _, d, _ in plain_roots(rows)}


@pytest.mark.parametrize("m", [1, 2, 3, 5, 16, 17, 90, 1000])
def test_a_key_names_a_permutation(spark, m):
    out = spark.range(m).crossJoin(spark.range(4).select((F.col("id") * 1_000_003).alias("key"))).select("key", "id", corpus.permuted(F.col("id"), m, F.col("key")).alias("v")).collect()
    for key in {r.key for r in out}:
        assert sorted(r.v for r in out if r.key == key) == list(range(m))


def test_draws_are_even_and_each_rows_own(spark):
    n, count = 40, 3
    pairs = Counter()
    for seed in range(60):
        got = corpus.sample_others(spark.range(n), "id", count, seed, 2).collect()
        assert len(got) == n * count == len({tuple(r) for r in got}) and all(r.id != r.other for r in got)
        pairs.update(tuple(r) for r in got)
    want = 60 * count / (n - 1)
    chi = sum((pairs[a, b] - want) ** 2 / want for a in range(n) for b in range(n) if a != b)
    assert 0.8 < chi / (n * (n - 1)) < 1.2
    both = sum(pairs[a, b] * pairs[b, a] for a in range(n) for b in range(a)) / (n * (n - 1) / 2)
    assert abs(both / want**2 - 1) < 0.15  # that a draws b says nothing on whether b draws a
    assert corpus.sample_others(spark.range(3), "id", 9).count() == 6 and corpus.sample_others(spark.range(1), "id").count() == 0


def test_an_item_that_all_rows_share_is_many_segments(spark):
    rows = spark.range(950).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("hot"), F.lit("even"))).otherwise(F.array(F.lit("hot"), F.lit(None))).alias("items"))
    out = ledger.inverted_index(rows.union(rows), "id", "items", 100).collect()
    hot = sorted((r.segment, r["keys"]) for r in out if r.item == "hot")
    assert [s for s, _ in hot] == list(range(10)) and sum((k for _, k in hot), []) == list(range(950)) and max(len(r["keys"]) for r in out) == 100
    assert sum((k for _, k in sorted((r.segment, r["keys"]) for r in out if r.item == "even")), []) == list(range(0, 950, 2)) and {r.item for r in out} == {"hot", "even"}


def test_lists_are_cut_before_they_meet(spark):
    parts = spark.range(200).select(F.lit("u").alias("uid"), F.col("id").alias("ord"), F.array((F.col("id") * 2).cast("int"), (F.col("id") * 2 + 1).cast("int")).alias("items")).repartition(8)
    parts = parts.union(spark.createDataFrame([("v", 1, []), ("v", 2, [5]), ("v", 3, None), ("v", 4, [6, 7, 8])], "uid string, ord long, items array<int>"))
    got = {r.uid: r["items"] for r in scoring.merge_lists(parts.filter("items IS NOT NULL"), 3).collect()}
    assert got == {"u": [0, 1, 2], "v": [5, 6, 7]}
    assert len(scoring.merge_lists(parts.filter("items IS NOT NULL")).filter("uid = 'u'").first()["items"]) == 400
