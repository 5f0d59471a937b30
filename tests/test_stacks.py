"""Stacks of grids: symmetries by correlation, random grids that don't depend on batches, the greatest cover."""

from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom.functions import kernels as K
from gridloom.functions import random_grids as R
from gridloom.functions import symmetry as Y

QUIET = {"max_examples": 40, "deadline": None, "suppress_health_check": list(HealthCheck)}


def stack(seed):
    """Grids of one shape, some mirrored, some of a period, some turned."""
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 7, 2)
    if seed % 4 == 3:
        m = n
    g = rng.integers(0, rng.integers(2, 5), (6, n, m))
    if seed % 4 == 0:
        g = np.concatenate([g, g[:, ::-1]], axis=1)
    if seed % 4 == 1:
        g = np.tile(g, (1, 1, 2))
    if seed % 4 == 3:
        g = np.max([np.rot90(g, k, (1, 2)) for k in range(4)], axis=0)
    return g


@settings(**QUIET)
@given(st.integers(0, 10**6), st.sampled_from([(None, (0,)), (0, ()), (1, (0,)), (None, (0, 2))]))
def test_symmetries_of_a_stack_are_those_of_its_grids(seed, colors):
    g = stack(seed)
    assert Y.mirror_symmetries(g, *colors) == [K.mirror_symmetries(x, *colors) for x in g]
    assert Y.translational_symmetries(g, *colors) == [K.translational_symmetries(x, *colors) for x in g]
    assert Y.rotational_symmetry(g, *colors) == [K.rotational_symmetry(x, *colors) for x in g]
    for d in ((0, 2), (1, 0), (-1, 1), (9, 9)):
        assert Y.shift_scores(g, *d, *colors).tolist() == [list(K.score_symmetry(x, lambda u, v, d=d: (u + d[0], v + d[1]), *colors)) for x in g]


@settings(**QUIET)
@given(st.integers(0, 10**6))
def test_lines_contact_and_places_of_a_stack(seed):
    g = stack(seed)
    lines = K.draw_lines(g, 0, 0, 9, direction=(1, 1), stop_at=(2,))
    other = np.roll(g, 1, axis=0)
    touch, free = K.contact(g, other, 1, -1), K.free_places(g, other[:, :1, :1], padding=1)
    for k, x in enumerate(g):
        assert (lines[k] == K.draw_line(x, 0, 0, 9, direction=(1, 1), stop_at=(2,))[0]).all()
        near = any(x[a, b] and other[k][c, d] and abs(c + 1 - a) + abs(d - 1 - b) <= 1 for a in range(x.shape[0]) for b in range(x.shape[1]) for c in range(x.shape[0]) for d in range(x.shape[1]))
        assert touch[k] == near and free[k] == K.free_places(x, other[k][:1, :1], padding=1)


@pytest.mark.parametrize("kind", [None, *R.KINDS])
@pytest.mark.parametrize("shape", [(1, 4), (2, 2), (3, 4), (5, 5), (6, 6), (7, 4)])
def test_sprites_keep_what_they_promise(kind, shape):
    n, m = shape
    if kind in R.SQUARE and n != m:
        with pytest.raises(ValueError):
            R.sprites(np.arange(2), n, m, symmetry=kind)
        return
    s = R.sprites(np.arange(40), n, m, symmetry=kind)
    assert s.shape == (40, n, m) and K.is_contiguous(s).all()
    full = s != 0
    assert full[:, 0].any(1).all() and full[:, -1].any(1).all() and full[:, :, 0].any(1).all() and full[:, :, -1].any(1).all()
    images = {"horizontal": [full[:, ::-1]], "vertical": [full[:, :, ::-1]], "mirror": [full[:, ::-1], full[:, :, ::-1]], "radial": [np.rot90(full, 1, (1, 2))]}.get(kind, [])
    assert all((full == i).all() for i in images)
    if kind == "diagonal":
        assert ((full == full.swapaxes(1, 2)).all((1, 2)) | (full[:, ::-1] == full[:, ::-1].swapaxes(1, 2)).all((1, 2))).all()
    assert (R.sprites(np.array([7]), n, m, symmetry=kind)[0] == s[7]).all()  # alone as in the stack
    assert len({x.tobytes() for x in s}) > 5


def test_palettes_background_and_connectivity():
    s = R.sprites(np.arange(200), 6, 6, palette=[4, 7], background=3, connectivity=8)
    assert set(np.unique(s)) == {3, 4, 7} and K.is_contiguous(s, 3, 8).all()
    drawn = R.sprites(np.arange(400), 7, 7)
    number = np.array([len(np.unique(x[x != 0])) for x in drawn])
    assert 0.6 < (number == 1).mean() < 0.8 and number.max() >= 4  # one more colour with odds of three in ten


def test_scatter_and_spaced_indices():
    g = np.zeros((50, 4, 5), int)
    g[:, 0] = 2
    s = R.scatter(g, np.arange(50), 3, 0.4)
    assert ((s == 3).sum((1, 2)) == 8).all() and (s[:, 0] == 2).all() and (R.scatter(g[:1], np.array([9]), 3, 0.4)[0] == s[9]).all()
    assert (R.scatter(g, np.arange(50), 3, 1.0)[:, 1:] == 3).all()  # no more than there are
    hits = (R.scatter(np.zeros((4000, 2, 2), int), np.arange(4000), 1, 0.25) == 1).sum(0)
    assert abs(hits - 1000).max() < 130
    p = R.spaced_indices(np.arange(3000), 14, 3, border=2, padding=2)
    assert p.min() == 2 and p.max() == 11 and (np.diff(p, axis=1) > 2).all()
    seen = {tuple(x) for x in p.tolist()}
    every = {(a, b, c) for a in range(2, 12) for b in range(a + 3, 12) for c in range(b + 3, 12)}
    assert seen == every
    assert R.spaced_indices(np.arange(2), 6, 3, 1, 1) is None and R.spaced_indices(np.arange(2), 5, 3, 0, 1).tolist() == [[0, 2, 4]] * 2


@settings(**QUIET)
@given(st.integers(0, 10**6))
def test_the_greatest_cover_is_that_of_a_full_search(seed):
    rng = np.random.default_rng(seed)
    masks = [x for x in (rng.random((rng.integers(0, 10), 12)) < 0.3) if x.any()]
    best = (0, ())
    for k in range(1, len(masks) + 1):
        for pick in combinations(range(len(masks)), k):
            total = sum(masks[i].astype(int) for i in pick)
            if total.max() == 1 and total.sum() > best[0]:
                best = int(total.sum()), pick
    assert tuple(K.greatest_cover(masks)) == best[1]


def test_objects_without_overlap_beyond_a_full_search():
    """Thirty windows that meet their neighbours: every second one is taken, from the first."""
    g = np.ones((1, 31), int)
    found = K.detect_objects(g, allowed=[(1, 2)], overlap=False)
    assert len(found) == 15 and sum((o != 0).sum() for o in found) == 30
    assert sum(o != 0 for o in found).max() == 1


def test_orbits_end_where_a_map_leaves_the_canvas():
    g = np.zeros((3, 4), int)
    shift = lambda x, y, k: (x + k, y)
    assert K.orbit(g, 1, 1, [(shift, range(-2, 3))]) == [(0, 1), (1, 1), (2, 1)]
    assert K.orbit(g, 0, 1, [(shift, range(-1, 2)), (shift, range(0, 2))]) == [(0, 1), (1, 1), (2, 1)]
