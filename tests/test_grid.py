import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import grid as G
from gridloom.functions import kernels as K

GRIDS = [[[1]], [[1, 2, 3]], [[0, 0], [0, 0]], [[0, 5, 0], [5, 0, 5]], [[1, 2], [3, 4], [5, 6]], [[0, 0, 0, 0], [0, 7, 7, 0], [0, 7, 0, 0]]]


@pytest.fixture(scope="module")
def grids(spark):
    return spark.createDataFrame([(i, g) for i, g in enumerate(GRIDS)], "id int, g array<array<int>>").cache()


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_shapes_match_numpy(grids):
    for f, g in ((G.rot90, lambda a: np.rot90(a, -1)), (G.rot180, lambda a: np.rot90(a, 2)), (G.rot270, np.rot90), (G.transpose, np.transpose), (G.flip_rows, np.flipud), (G.flip_columns, np.fliplr), (lambda c: G.scale(c, 3), lambda a: np.kron(a, np.ones((3, 3), int)))):
        assert values(grids, f(F.col("g"))) == [g(np.array(a)).tolist() for a in GRIDS]


def test_laws(grids):
    g, p = F.col("g"), G.seeded_permutation(F.col("id"))
    for law in (G.transpose(G.transpose(g)), G.rot90(G.rot90(G.rot180(g))), G.permute_colors(G.permute_colors(g, p), G.inverse_permutation(p)), G.from_text(G.to_text(g))):
        assert values(grids, law) == GRIDS
    assert values(grids, G.crop(G.crop(g))) == values(grids, G.crop(g))
    assert set(values(grids, G.edit_similarity(g, g))) == {1.0}


def test_validity(spark):
    bad = [[], [[]], [[1], [1, 2]], [[10]], [[-1]], [[None]], None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate([*bad, [[0] * 31], [[0] * 30]])], "id int, g array<array<int>>")
    assert values(df, G.is_grid(F.col("g"))) == [False] * 7 + [True, True]
    assert values(df, G.is_small_grid(F.col("g")))[-2:] == [False, True]


def test_boxes_and_blits(grids):
    g = F.col("g")
    assert [tuple(b) for b in values(grids, G.bounding_box(g))] == [(0, 0, 1, 1), (0, 0, 1, 3), (2, 2, -2, -2), (0, 0, 2, 3), (0, 0, 3, 2), (1, 1, 2, 2)]
    assert values(grids, G.crop(g))[-1] == [[7, 7], [7, 0]]
    assert values(grids, G.blit(g, F.lit([[8, 0], [0, 9]]).cast("array<array<int>>"), 0, 1))[4] == [[1, 8], [3, 4], [5, 6]]
    assert values(grids, G.blit(g, F.lit([[0]]).cast("array<array<int>>"), 1, 1, None))[4] == [[1, 2], [3, 0], [5, 6]]
    assert values(grids, G.translate(g, 1, 0))[4] == [[0, 0], [1, 2], [3, 4]]
    assert values(grids, G.object_colors(g)) == [[1], [1, 2, 3], [], [5], [1, 2, 3, 4, 5, 6], [7]]
    assert values(grids, G.collision(g, g, 1, 0)) == [False, False, False, False, True, True]
    assert [tuple(p) for p in values(grids, G.object_position(g, "bottom right"))][5] == (2.0, 2.0)


def test_compare(spark):
    rows = [(0, [[1, 2]], [[1, 2]]), (1, [[1, 3]], [[1, 2]]), (2, [[1]], [[1, 2]]), (3, None, [[1, 2]]), (4, [[1], [1, 2]], [[1, 2]])]
    df = spark.createDataFrame(rows, "id int, a array<array<int>>, b array<array<int>>")
    assert [tuple(v) for v in values(df, G.compare(F.col("a"), F.col("b")))] == [("EQUAL", 1.0), ("CONTENT", 0.5), ("SHAPE", 0.0), ("ERROR", 0.0), ("NON_2D", 0.0)]


def test_lenient_and_strict_reading(spark):
    df = spark.createDataFrame([(0, "Black Blue\nred Nothing"), (1, "Black Blue\nUnknown Unknown\n")], "id int, t string")
    assert values(df, G.from_text(F.col("t"))) == [None, None]
    assert values(df, G.from_text(F.col("t"), False)) == [[[0, 1], [2, -1]], [[0, 1]]]


def test_augmentation_is_one_transform_for_a_key(grids):
    same = grids.select("id", G.augment(F.col("g"), F.lit("k")).alias("a"), G.augment(F.col("g"), F.lit("k")).alias("b"))
    assert same.filter("a <> b").count() == 0 and same.filter(~G.is_small_grid(F.col("a"))).count() == 0


RING = np.array([[0, 0, 0, 0, 0], [0, 3, 3, 3, 0], [0, 3, 0, 3, 0], [0, 3, 3, 3, 0], [0, 0, 0, 0, 0]])
DIAGONAL = np.array([[1, 0], [0, 1]])


def test_components():
    assert len(K.components(DIAGONAL)) == 2 and len(K.components(DIAGONAL, connectivity=8)) == 1
    two = np.array([[1, 2], [1, 2]])
    assert len(K.components(two)) == 2 and len(K.components(two, one_color=False)) == 1
    assert K.is_contiguous(RING) and not K.is_contiguous(DIAGONAL)
    with pytest.raises(ValueError):
        K.components(two, connectivity=5)


def test_inside_and_outside():
    assert K.interior(RING).sum() == 9 and K.boundary(RING).sum() == 8
    assert K.neighbors(RING).sum() == 13 and K.neighbors(RING, connectivity=8).sum() == 17
    assert (K.flood_fill(RING, 2, 2, 5) == 5).sum() == 1 and (K.flood_fill(RING, 0, 0, 5) == 5).sum() == 16
    assert (K.flood_fill(RING, 0, 0, 0) == RING).all()


def test_lines():
    g = np.zeros((4, 4), int)
    assert K.draw_line(g, 0, 0, 2, end=(3, 3))[0].trace() == 8
    assert K.draw_line(g, 0, 1, 2, direction=(1, 0))[1] == (3, 1)
    g[2, 1] = 9
    assert K.draw_line(g, 0, 1, 2, direction=(1, 0), stop_at=[9])[1] == (1, 1)
    assert K.draw_line(g, 0, 0, 2, length=2, direction=(0, 1))[0].sum() == 4 + 9


def test_contact_and_places():
    a = np.array([[1, 0, 0], [0, 0, 0]])
    b = np.array([[0, 0, 1], [0, 0, 0]])
    assert not K.contact(a, b) and K.contact(a, b, 0, -1) and K.contact(a, b, 1, -2) and K.contact(a, b, 1, -1, connectivity=8) and not K.contact(a, b, 1, -1)
    assert K.free_places(a, np.ones((1, 1), int)) == [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert K.free_places(a, np.ones((1, 1), int), padding=1) == [(0, 2), (1, 2)]


def test_symmetries():
    even = np.array([[1, 2, 2, 1]])
    assert (None, 1.5) in K.mirror_symmetries(even)
    assert (0, 2) in K.translational_symmetries(np.array([[1, 2, 1, 2, 1, 2]]))
    assert K.rotational_symmetry(RING) == (2.0, 2.0)
    assert K.score_symmetry(even, lambda x, y: (x, y + 1)) == (1, 1, 2)
    assert K.orbit(np.zeros((3, 3)), 0, 0, [(lambda x, y, k: (x, 2 - y if k % 2 else y), range(2)), (lambda x, y, k: (2 - x if k % 2 else x, y), range(2))]) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert (K.apply_symmetry(np.array([[1, 0], [0, 0]]), "radial") == 1).all()
    with pytest.raises(ValueError):
        K.apply_symmetry(np.array([[1, 0]]), "diagonal")


def test_objects():
    g = np.array([[1, 1, 0], [0, 0, 0], [0, 2, 2]])
    assert len(K.detect_objects(g)) == 2
    assert len(K.detect_objects(g, allowed=[(1, 2)], overlap=False)) == 2
    assert len(K.detect_objects(g, predicate=lambda o: (o == 2).any())) == 1


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(3, 7), st.integers(3, 7), st.integers(0, 10**6))
def test_generated_sprites(n, m, seed):
    s = K.random_sprite(n, m, seed)
    assert s.shape == (n, m) and K.is_contiguous(s, connectivity=8) and all(e.any() for e in (s[0], s[-1], s[:, 0], s[:, -1]))
    picked = K.spaced_indices(9, 4, seed)
    assert len(picked) == 4 and all(b - a > 1 for a, b in zip(picked, picked[1:]))
    assert (K.scatter(np.zeros((n, m), int), 3, 0.3, seed) == 3).sum() == int(np.ceil(0.3 * n * m))


def test_kernels_over_rows(grids):
    out = K.over_rows(grids, "g", "parts", "array<array<array<int>>>", lambda g: K.components(g, one_color=False))
    assert [len(p) for p in values(out, "parts")] == [1, 1, 0, 3, 1, 1]
