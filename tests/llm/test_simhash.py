import brute
import numpy as np
import pytest
from brute import table

from gridloom.llm import similar, windows
from gridloom.llm import simhash as S
from gridloom.llm.common import LAST
from gridloom.llm.components import components


def test_the_code_is_perfect():
    errors = S.golay()
    assert (S.remainder(errors) == np.arange(2048)).all()
    assert np.bincount(np.bitwise_count(errors)).tolist() == [1, 23, 253, 1771]
    code, weight = S.nearest(np.arange(1 << 16))
    assert weight.max() == 3 and code.max() < 1 << 12


def test_fingerprints_within_three_bits_share_a_key():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 500).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    sets = []
    for v in (x, y):
        r, k = S.keys_of(v.view(np.int64))
        sets.append([set(k[r == i]) for i in range(len(v))])
    assert all(a & b for a, b in zip(*sets))


def test_fingerprint(corpus):
    assert [S.fingerprint((t or "").encode()) for _, t in corpus] == [brute.fingerprint(t) for _, t in corpus]


@pytest.mark.parametrize("together", [2, 4096])
def test_components_of_near_copies(spark, corpus, together):
    rows = [*corpus, (40, None), (None, "short"), (3, "short")]
    out = S.near_duplicates(table(spark, rows), together=together)
    got = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out.collect()), key=repr)
    assert got == sorted(brute.near_components(rows), key=repr)


def test_empty_table(spark):
    assert S.near_duplicates(table(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(components(edges).collect())
    assert {got[i] for i in range(61)} == {0} and got[101] == 100


def test_votes_of_long_hashes():
    rng = np.random.default_rng(0)
    h, owner = rng.integers(0, 2**63, 20_000).astype(np.uint64), np.sort(rng.integers(0, 3, 20_000))
    got = similar._votes(h, owner, 4, 8)
    for k in range(4):
        long = windows.mix(h[owner == k][:, None] + (np.arange(8, dtype=np.uint64) * np.uint64(similar._STEP))[None, :])
        bits = np.unpackbits(np.ascontiguousarray(long).view(np.uint8), axis=1)
        assert (np.packbits(2 * bits.sum(axis=0) > len(long)) == got[k]).all()


def copies(seed, sizes, edits, word=lambda rng: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))):
    """Pairs of a text and a copy with a share of its words replaced."""
    import random

    rng = random.Random(seed)
    out = []
    for n in sizes:
        for share in edits:
            a = [word(rng) for _ in range(n)]
            b = [word(rng) if rng.random() < share else w for w in a]
            out.append((" ".join(a), " ".join(b)))
    return out


def test_similarity_is_near_the_truth():
    import pyarrow as pa

    pairs = copies(1, [6, 12, 40, 150, 600] * 12, [0.0, 0.005, 0.01, 0.02, 0.04])
    out = [list(similar.sketches(*windows.utf8(pa.array(side)), 5)) for side in zip(*pairs)]
    (a, n), (b, m) = (([k for _, k, *_ in o], np.array([s for s, *_ in o])) for o in out)
    true = np.array([brute.jaccard(brute.shingles(x), brute.shingles(y)) for x, y in pairs])
    assert n.tolist() == [len(brute.shingles(x)) for x, _ in pairs]
    error = similar.similarity(a, n, b, m) - true
    assert error.std() < 0.025 and np.abs(error).max() < 0.1
    short = (n <= similar.WIDE) & (m <= similar.WIDE)
    assert short.any() and np.abs(error[short]).max() < 1e-12


def test_groups_of_similar_documents(spark, corpus):
    rows = [*corpus, (40, None), (None, "short"), (3, "short"), (3, "another text of the same id"), (None, "an odd one"), (None, "an odd one"), (99, dict(corpus)[14].upper())]
    got = similar.similar_documents(table(spark, rows)).select("row.doc_id", "row.text", "root_id", "root_fp").collect()
    assert len(got) == len(rows)
    name = {}
    for r in got:
        name.setdefault((r.doc_id, r.text), (r.root_id, r.root_fp))
    root = brute.similar_groups(rows)
    want, have = {}, {}
    for k, key in enumerate(rows):
        want.setdefault(root[k], set()).add(key)
        have.setdefault(name[key], set()).add(key)
    assert sorted(map(sorted, ([str(x) for x in g] for g in want.values()))) == sorted(map(sorted, ([str(x) for x in g] for g in have.values())))
    assert all(i == min(d if d is not None else LAST for d, _ in g) for (i, _), g in have.items())
    assert similar.similar_documents(table(spark, [])).count() == 0


def test_near_copies_are_found(spark):
    pairs = copies(2, [30, 80, 200, 500], np.linspace(0.002, 0.024, 60))
    true = [brute.jaccard(brute.shingles(x), brute.shingles(y)) for x, y in pairs]
    rows = [(2 * k + s, t) for k, p in enumerate(pairs) for s, t in enumerate(p)]
    roots = {r.doc_id: r.root_id for r in similar.similar_documents(table(spark, rows)).select("row.doc_id", "root_id").collect()}
    linked = [roots[2 * k] == roots[2 * k + 1] for k in range(len(pairs))]
    near = [x for x, t in zip(linked, true) if t >= 0.8]
    assert len(near) > 100 and sum(near) >= 0.9 * len(near)
    assert not any(x for x, t in zip(linked, true) if t < 0.7)


def test_a_large_family_of_copies(spark):
    """One text with five hundred edited copies, and a passage that every other text has too."""
    (base, _), (passage, _), *others = copies(3, [300, 40] + [120] * 200, [0.0])
    w, rng = base.split(), np.random.default_rng(4)
    rows = [(0, base)]
    for k in range(500):
        v = list(w)
        for i in rng.integers(0, len(v), 3):
            v[i] = f"edit{k}x{i}"
        rows.append((k + 1, " ".join(v)))
    rows += [(1000 + k, f"{t} {passage}") for k, (t, _) in enumerate(others)]
    out = similar.similar_documents(table(spark, rows), together=64).select("row.doc_id", "root_id").collect()
    roots = {r.doc_id: r.root_id for r in out}
    assert sum(roots[k] == 0 for k in range(501)) >= 495
    assert all(roots[i] == i for i in roots if i >= 1000)
