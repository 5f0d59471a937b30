"""Collocations, whitening and line dedup against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import table
from pyspark.sql import functions as F

from gridloom.llm import collocations as C
from gridloom.llm import whitening
from gridloom.llm.common import keyed
from gridloom.llm.cuckoo import Chain, Cuckoo
from gridloom.llm.line_dedup import LineIndex, keys, remove_repeated_lines


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_collocations(rows, enough=10, share=50, top=2000, longest=3):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= enough}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    inside[p[s : s + m]] = max(inside[p[s : s + m]], a)
        best = []
        for p, a in candidates.items():
            score, _, left, right = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < share * a or not inside[p]:
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def spoken(seed, docs, words=40):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["é", "ß", "a", "Be", "x9", "語", "..", "q"]) + str(k % 7) for k in range(words)]
    draw = lambda: rng.choice(vocabulary[: rng.choice([5, 12, words])])
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(draw() + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ",", "\v"]) for _ in range(rng.randint(0, 120)))) for _ in range(docs)]
    return [*rows, ("en", None), ("en", ""), (None, " \n\t. "), ("fr", "A b a B a b a b a b a b a b a b a b a b a b a b"), ("en", "one two three " * 30_000)]


COLLOCATION = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("width", [None, 16])
def test_collocations_by_a_plain_version(spark, width):
    rows = spoken(3, 90)
    docs = spark.createDataFrame([(v, t, 1, 2, "x", 5) for v, t in rows], "lang string, text string, size int, n int, phrase string, rank int").repartition(5)
    out = C.collocations(docs, width=width)
    assert out.columns == COLLOCATION
    assert sorted(map(tuple, out.collect())) == plain_collocations(rows)


def test_collocations_with_other_lengths_and_limits(spark):
    rows = spoken(4, 60, words=9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    out = C.collocations(docs, enough=4, share=80, top=25, longest=5)
    assert sorted(map(tuple, out.collect())) == plain_collocations(rows, 4, 80, 25, 5)
    assert C.collocations(docs.limit(0)).collect() == []


def test_collocation_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of three thousand million: the products have some 25 digits."""
    big = 3_000_000_019
    found = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 2), ("en", 2, "a b", big - 1)], "lang string, size int, phrase string, n long")
    monkeypatch.setattr(C, "frequent", lambda *_: (found, spark.createDataFrame([("en", 2 * big + 2)], "lang string, n long")))
    (row,) = C.collocations(found).collect()
    assert row.score == 1000000 * (big - 1) ** 2 // (big * (big + 2)) and row.n == 2 * big + 2


def test_sketches_never_count_too_little(spark):
    rows = spoken(5, 50)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    cells = C.sketch(docs, 1 << 10, 10, 3)
    import pyarrow as pa

    exact, hashes = Counter(), {}
    found = C.Phrases(pa.table({"text": pa.array([t for _, t in rows]), "lang": pa.array([v for v, _ in rows], pa.string())}))
    for k in range(3):
        if k:
            found.extend()
        for h, n in zip(found.hash.tolist(), found.count.tolist()):
            exact[h] += n
    h = np.array(list(exact), np.uint64)
    estimate = np.minimum.reduce([row[at] for row, at in zip(cells, C.cells(h, 1 << 10))])
    assert len(hashes) == 0 and (estimate >= np.minimum([exact[int(x)] for x in h], 10)).all()


def plain_whitening(rows, most=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: [int(np.floor(64.0 * float(np.float32(c)))) + 1000000 for c in v] for i, v in good}
    fitted = [list(v) for v in {tuple(x[i]) for i, _ in good}]
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    centred = lambda v: np.array([(n * c - s) / n for c, s in zip(v, sums)])  # noqa: E731  one correct division of integers
    m = np.stack([centred(v) for v in fitted])
    values, vectors = np.linalg.eigh(m.T @ m / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = {}
    for i, _ in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x[i], sums))
        w = centred(x[i]) @ vectors / np.sqrt(values)
        out[i] = (n, deviation, w, values / np.trace(m.T @ m / n))
    return out


def vectors(seed, n, size=20):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(size, size)) * np.linspace(3, 0.2, size)
    rows = [(i, (rng.normal(size=size) @ mix + 5).astype(np.float32).tolist()) for i in range(n)]
    bad = [(1001, None), (1002, [None] + [0.5] * (size - 1)), (1003, [float("nan")] * size), (1004, [float("inf")] + [1.0] * (size - 1)), (1005, [])]
    return rows + [(i + 2000, rows[0][1]) for i in range(n // 2)] + bad  # a third are copies of one


KIND = "vec_id long, embedding array<float>, label int, x int, row string, n int, component int"


def test_whitening_by_a_plain_version(spark):
    rows = vectors(1, 300)
    docs = spark.createDataFrame([(i, v, 1, 2, "r", 3, 4) for i, v in rows], KIND).repartition(5)
    want = plain_whitening(rows)
    got = defaultdict(dict)
    for r in whitening.whiten(docs).select("row.vec_id", "row.label", "component", "n", "deviation", "whitened", "explained", "identity_error").collect():
        got[r.vec_id][r.component] = r
    assert set(got) == set(want)
    sign = None
    for i, (n, deviation, w, explained) in want.items():
        assert sorted(got[i]) == list(range(1, 17))
        own = np.array([got[i][k].whitened for k in range(1, 17)])
        sign = np.sign(own * w) if sign is None else sign
        assert np.allclose(own, sign * w, atol=1e-8)
        for k, r in got[i].items():
            assert (r.n, r.deviation, r.label) == (n, deviation, 1) and abs(r.explained / explained[k - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_takes_pairs_in_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TOGETHER", 50)
    docs = spark.createDataFrame(vectors(2, 60), "vec_id long, embedding array<float>")
    out = whitening.whiten(docs, keep=["vec_id"], most=3)
    want = plain_whitening(vectors(2, 60), 3)
    assert {(r.row.vec_id, r.component) for r in out.collect()} == {(i, k) for i in want for k in (1, 2, 3)}
    assert out.first().identity_error < 1e-9


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no direction
    line = whitening.whiten(make([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [3.0, 6.0]), (4, [9.0])])).collect()
    assert {(r.row.vec_id, r.component) for r in line} == {(1, 1), (2, 1), (None, 1)} and abs(line[0].explained - 1) < 1e-12
    huge = whitening.whiten(make([(1, [1e15, 2.0]), (2, [-1e15, 4.0]), (3, [1e300, 0.0])])).collect()
    assert {r.row.vec_id for r in huge} == {1, 2} and all(r.deviation is None for r in huge)


def plain_lines(rows):
    key = lambda x: lowered(x.strip(" \t\n\v\f\r"))
    least = {}
    for i, t in rows:
        i = float("inf") if i is None else i
        for x in (t or "").split("\n"):
            least[key(x)] = min(least.get(key(x), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or least[key(x)] >= (float("inf") if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def lines_of(out):
    return sorted(map(tuple, out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()), key=repr)


def lined(seed, n):
    rng = random.Random(seed)
    pool = ["All rights reserved.", "  ALL rights Reserved.\t", "ééééééééé", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "short", "", "\x0b", "123456789\x0c", "1234567890 ", *(f"line number {k} of many" for k in range(40))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(n)]
    rows += [(5, rows[5][1]), (5, "line number 1 of many\nanother text"), (None, "\n".join(pool)), (None, "line number 3 of many"), (990, None), (991, ""), (992, "\n"), (993, "\n".join(pool * 3000)), (994, "All rights reserved.\r\n" * 5)]
    return rows


def test_lines_by_a_plain_version(spark):
    rows = lined(2, 60)
    out = remove_repeated_lines(table(spark, rows).repartition(6))
    assert lines_of(out) == plain_lines(rows)
    assert out.select("row.*").columns == table(spark, []).columns
    assert remove_repeated_lines(table(spark, [])).collect() == []
    assert lines_of(remove_repeated_lines(table(spark, rows), batches=1)) == plain_lines(rows)


def test_lines_come_back_when_documents_go(spark):
    rng = random.Random(7)
    rows = lined(3, 40)
    rng.shuffle(rows)
    index = LineIndex(spark, shards=3, buckets=2, tasks=2)
    here = []
    for step in range(3):  # in any order of ids
        new = rows[step::3]
        index.insert(keyed(table(spark, new)))
        here += new
        gone = [r for r in here if rng.random() < 0.3]
        for r in gone:
            here.remove(r)
        index.delete(keyed(table(spark, [*gone, (7777, "was never here: line number 1 of many")])))
        if step == 1:
            index.compact()
            index = LineIndex.open(spark, index.path)
        assert {(r._id, r.n): 1 for r in index.references().collect()} == {(r._id, r.n): 1 for r in keys(keyed(table(spark, here))).groupBy("k1", "k2", "_id").agg(F.count("*").alias("n")).collect()}
        assert index.references().filter("n < 1").count() == 0
        assert lines_of(index.clean(keyed(table(spark, here)))) == plain_lines(here)
    shards = index._chains().collect()
    held = sum(int(np.count_nonzero(Cuckoo(1 << 14, f).slots)) for s in shards for f in s.filters)
    texts = {lowered(x.strip(" \t\n\v\f\r")) for _, t in here for x in (t or "").split("\n")}
    assert held == sum(len(k) >= 10 for k in texts)  # one fingerprint for each key that a document still has
    index.delete(keyed(table(spark, here)))
    assert index._shared().count() == 0 and not any(np.frombuffer(f, np.uint16).any() for s in index._chains().collect() for f in s.filters)
    index.close()


def test_cuckoo_filters_forget_no_member():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    chain = Chain(256)
    for part in np.array_split(h, 7):
        chain.add(part)
    assert chain.has(h).all() and 4 < len(chain.filters) < 8
    chain.remove(h[::2])
    assert chain.has(h[1::2]).all() and chain.has(h[::2]).mean() < 0.02
    again = Chain(256, chain.tolist())
    again.add(h[::2])
    assert again.has(h).all() and sum(np.count_nonzero(f.slots) for f in again.filters) == len(h)
    one = Cuckoo(2)
    assert one.add(h[:8]).sum() >= 6 and one.has(h[:8][one.has(h[:8])]).all()
