"""Hand-made cases of what each function means where the survey's source decides it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import grid as G
from gridloom.functions import kernels as K
from gridloom.functions import text as X
from gridloom.operators import corpus, scoring


def cells(g):
    return [tuple(map(int, p)) for p in np.argwhere(g == 4)]


def test_lines_step_by_sign():
    g = np.zeros((4, 4), int)
    assert cells(K.draw_line(g, 0, 0, 4, end=(3, 1))[0]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert cells(K.draw_line(g, 0, 0, 4, direction=(2, 0))[0]) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert cells(K.draw_line(g, -1, 1, 4, direction=(1, 0))[0]) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert cells(K.draw_line(g, 2, 3, 4, end=(2, 0), length=None)[0]) == [(2, 0), (2, 1), (2, 2), (2, 3)]
    g[0, 0] = 9
    out, last = K.draw_line(g, 0, 0, 4, direction=(1, 1), stop_at=(9,))
    assert (out == g).all() and last == (0, 0)
    g[0, 0], g[2, 2] = 0, 9
    assert K.draw_line(g, 0, 0, 4, direction=(1, 1), stop_at=(9,))[1] == (1, 1)


def test_a_cell_with_only_a_corner_outside_is_no_boundary():
    g = np.zeros((7, 7), int)
    g[1:6, 1:6] = 3
    g[1, 1] = 0
    assert not K.boundary(g)[2, 2] and K.boundary(g)[1, 2] and K.boundary(g)[2, 1]
    assert K.boundary(np.full((3, 3), 1)).sum() == 8


def test_stacks_are_as_single_grids():
    rng = np.random.default_rng(0)
    stack = rng.integers(0, 3, (40, 5, 6))
    for f in (K.exterior, K.interior, K.boundary, K.neighbors, K.is_contiguous, lambda g: K.labels(g, one_color=False), lambda g: K.count_components(g, connectivity=8), lambda g: K.flood_fill(g, 1, 2, 7)):
        assert all((np.asarray(f(g)) == got).all() for g, got in zip(stack, f(stack)))
    for g in stack[:10]:
        assert len(K.components(g)) == K.count_components(g)


def test_symmetries_ignore_black():
    g = np.zeros((3, 4), int)
    g[0] = [1, 2, 0, 1]
    mirrored = lambda x, y: (x, 3 - y)
    assert K.score_symmetry(g, mirrored) == (2, 0, 0)  # black opposite the 2 is no conflict
    assert K.score_symmetry(g, mirrored, 0, ()) == (2, 0, 1)
    assert K.mirror_symmetries(g) == [(0.0, None)]
    centres = [a for a in K.mirror_symmetries(np.ones((3, 4), int)) if None not in a]
    assert all(float(a).is_integer() == float(b).is_integer() for a, b in centres)
    assert K.rotational_symmetry(np.array([[1, 2], [2, 1]])) is None
    assert K.rotational_symmetry(np.ones((2, 2), int)) == (0.5, 0.5)


@pytest.mark.parametrize("word, cell", [("Grey", 5), ("GRAY", 5), ("black", 0), ("Teal", None), ("Maroon", None), ("Purple", 8)])
def test_names_of_colours(spark, word, cell):
    got = spark.range(1).select(G.at(G.from_text(F.lit(word)), 0, 0)).first()[0]
    assert got == cell


def test_equal_candidates_keep_their_order(spark):
    rows = [(0, 0, "b", "b", 1.0), (0, 1, "a", "a", 1.0), (0, 2, "c", "c", 2.0), (0, 3, "a ", "a", 1.0)]
    out = scoring.frequency_rerank(spark.createDataFrame(rows, "idx int, ord int, text string, clean string, score double"))
    assert [(r.clean, r.text) for r in out.orderBy("rank").collect()] == [("a", "a"), ("c", "c"), ("b", "b")]


def test_running_accuracy_of_a_whole_run(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 3)
    rows = spark.createDataFrame([(k, k % 3 == 0) for k in range(11)], "idx int, correct boolean")
    got = [r.accuracy for r in scoring.running_accuracy(rows).orderBy("idx").collect()]
    assert got == [round(sum(j % 3 == 0 for j in range(k + 1)) / (k + 1), 6) for k in range(11)]


def test_orders_of_pairs(spark):
    tasks = spark.createDataFrame([("a", [1, 2, 3]), ("b", [1]), ("c", []), ("d", [1, 2, 3, 4, 5, 6, 7])], "uid string, train array<int>")
    for most in (1, 4, 6, 50):
        rows = scoring.permuted_tasks(tasks, most).collect()
        by = {u: [tuple(r.train) for r in sorted(rows, key=lambda r: r.perm) if r.uid == u] for u in "abcd"}
        assert by["a"][0] == (1, 2, 3) and len(by["a"]) == len(set(by["a"])) == min(most, 6)
        assert by["b"] == [(1,)] and by["c"] == [()]
        assert by["d"][0] == (1, 2, 3, 4, 5, 6, 7) and len(by["d"]) == len(set(by["d"])) == most


def test_decontamination_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"start {k} " + ("one two three four five six seven eight nine ten eleven" if k % 3 == 0 else "nothing here") + " end") for k in range(12)] + [(99, "tiny one here"), (100, None), (101, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "One two  three four five six seven eight nine ten eleven"), (1, "tiny ONE"), (2, ""), (3, None)], "item_id long, text string")
    want = sorted([(k, 0) for k in range(0, 12, 3)] + [(99, 1)])
    assert sorted(map(tuple, corpus.contaminated(docs, bench).collect())) == want
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, corpus.contaminated(docs, bench).collect())) == want
    assert corpus.contaminated(docs.limit(0), bench).count() == corpus.contaminated(docs, bench.limit(0)).count() == 0


def test_nothing_stays_cached(spark):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert corpus.numbered(spark.range(100), "id").count() == 100
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_times_as_text(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02T03:04:05Z",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(X.utc_text(F.col("t"), F.lit("never"))).collect()] == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z", "soon", "never"]


def test_augmented_tasks_by_a_plain_version(spark):
    """Transforms drawn again from the same md5s, in numpy."""
    import hashlib

    from gridloom.operators.problems import augmented_tasks

    rng = np.random.default_rng(3)
    pairs = lambda n, m, k: [(rng.integers(0, 10, (n, m)).tolist(), rng.integers(0, 10, (m, n)).tolist()) for _ in range(k)]
    rows = [(f"t{i}", pairs(1 + i % 5, 1 + i % 7, 1 + i % 4), pairs(2, 3, 2)) for i in range(24)]
    rows += [("wide", [([[0] * 31], [[1]])], pairs(1, 1, 1)), ("bad", [([[10]], [[1]])], pairs(1, 1, 1)), ("none", pairs(1, 1, 1), [])]
    kind = "array<struct<input:array<array<int>>,output:array<array<int>>>>"
    got = {(r.uid, r.round): r for r in augmented_tasks(spark.createDataFrame(rows, f"uid string, train {kind}, test {kind}"), 3).collect()}
    assert set(got) == {(f"t{i}", k) for i in range(24) for k in range(3)}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for (uid, k), r in got.items():
        key = f"{uid}-{k}"
        draw = lambda what, n: int(md5(f"{what}-{key}")[:7], 16) % n
        _, train, test = next(x for x in rows if x[0] == uid)
        side = max(max(len(g), len(g[0])) for p in train + test for g in p)
        columns, lines = draw("columns", 1000) < 500, draw("rows", 1000) < 500
        quarters = draw("quarters", 3) + 1 if draw("turn", 1000) < 500 else 0
        scale = draw("k", 30 // side) + 1 if draw("scale", 1000) < 500 else 1
        of, colors = draw("colors", 10), np.arange(10)
        if of <= 5:
            low = 1 if of < 5 else 0
            colors = np.array([*range(low), *sorted(range(low, 10), key=lambda c: md5(f"{key}-{c}"))])

        def under(g, other=False):
            a = np.array(g)
            a = a[:, ::-1] if columns != other else a
            a = a[::-1] if lines != other else a
            return colors[np.kron(np.rot90(a, -(quarters + other)), np.ones((scale, scale), int))].tolist()

        both = [(under(a), under(b)) for a, b in train]
        order = sorted(range(len(train)), key=lambda j: (md5(f"{key}-{j}"), j))
        both += [(under(train[j][0], True), under(train[j][1], True)) for j in order]
        assert [(p.input, p.output) for p in r.train] == both[:3]
        assert [(p.input, p.output) for p in r.test] == [(under(a), under(b)) for a, b in test[:1]]


def test_sprites_of_every_symmetry():
    for kind in ("horizontal", "vertical", "diagonal", "radial", "mirror", "not_symmetric"):
        s = K.random_sprite(5, 5, 3, symmetry=kind)
        assert (s != 0).any()
        if kind == "mirror":
            assert ((s != 0) == (s[::-1] != 0)).all() and ((s != 0) == (s[:, ::-1] != 0)).all()
