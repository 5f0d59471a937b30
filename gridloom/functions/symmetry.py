"""Symmetries of stacks of grids: all shifts and centres at once, by correlations.

A map that turns, mirrors or shifts a grid sends point p to R p + t. For one R, how many
cells agree under every t is a correlation of the grid with itself under R, colour by colour;
so are the numbers of cells that stay on the canvas and that meet a cell that counts. Sums of
zeros and ones come out of the transform exactly once they are rounded.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(..., n + p - 1, m + q - 1): at [t + p - 1, u + q - 1] the sum over points of a[x, y] * b[x + t, y + u]; a is p x q, b n x m."""
    (p, q), (n, m) = a.shape[-2:], b.shape[-2:]
    size = n + p - 1, m + q - 1
    full = np.fft.irfft2(np.fft.rfft2(a[..., ::-1, ::-1], size) * np.fft.rfft2(b, size), size)
    return np.rint(full).astype(int)


class Scores:
    """(kept, off, conflict) of every grid of a stack for every t of one R: 'shift', 'x', 'y', 'xy' (mirrored along these axes) or 'turn' (a quarter)."""

    def __init__(self, g: np.ndarray, kind: str, background: int | None = None, ignore: Iterable[int] = (0,)):
        counts = ~np.isin(g, list(ignore))
        moves = counts & (g != background if background is not None else True)
        image = {"shift": lambda v: v, "x": lambda v: v[..., ::-1, :], "y": lambda v: v[..., ::-1], "xy": lambda v: v[..., ::-1, ::-1], "turn": lambda v: np.swapaxes(v, -1, -2)[..., ::-1]}[kind]
        colors = np.unique(g[moves]) if moves.any() else np.zeros(0, int)
        own = np.stack([moves & (g == c) for c in colors] + [moves, moves], axis=1).astype(float)
        other = np.stack([g == c for c in colors] + [np.ones(g.shape, bool), counts], axis=1).astype(float)
        both = correlation(image(own), other)
        kept, inside, met = both[:, :-2].sum(axis=1), both[:, -2], both[:, -1]
        self.moving = moves.sum(axis=(-2, -1))
        self.kept, self.off, self.conflict = kept, self.moving[:, None, None] - inside, met - kept
        p, q = image(own).shape[-2:]
        self.zero = p - 1, q - 1

    def at(self, t: int, u: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Under one shift after R; of shifts that leave the canvas, all is off it."""
        x, y = t + self.zero[0], u + self.zero[1]
        if 0 <= x < self.kept.shape[-2] and 0 <= y < self.kept.shape[-1]:
            return self.kept[:, x, y], self.off[:, x, y], self.conflict[:, x, y]
        return np.zeros(len(self.moving), int), self.moving, np.zeros(len(self.moving), int)


def shift_scores(g: np.ndarray, dx: int, dy: int, background: int | None = None, ignore: Iterable[int] = (0,)) -> np.ndarray:
    """(grids, 3): cells kept, off the canvas and in conflict under one shift."""
    return np.stack(Scores(g, "shift", background, tuple(ignore)).at(dx, dy), axis=1)


def _picked(scores: list[tuple[object, np.ndarray]], n: int) -> list[list]:
    """For each grid the keys whose value is finite and the largest, in their order."""
    if not scores:
        return [[] for _ in range(n)]
    values = np.stack([v for _, v in scores])
    best = values.max(axis=0)
    return [[scores[i][0] for i in np.flatnonzero((values[:, k] == best[k]) & np.isfinite(values[:, k]))] for k in range(n)]


def mirror_symmetries(g: np.ndarray, background: int | None = None, ignore: Iterable[int] = (0,)) -> list[list[tuple[float | None, float | None]]]:
    """For each grid (mx, my) of the best axes without a conflict; all ties, x axes first, then y, then both."""
    ignore = tuple(ignore)
    _, n, m = g.shape

    def value(kept, off, conflict):
        worth = kept - 0.01 * off
        return np.where((conflict == 0) & (kept > 0) & (worth > 0), worth, -np.inf)

    of = {k: Scores(g, k, background, ignore) for k in ("x", "y", "xy")}
    scored = [((c / 2, None), value(*of["x"].at(c - n + 1, 0))) for c in range(2 * n - 1)]
    scored += [((None, c / 2), value(*of["y"].at(0, c - m + 1))) for c in range(2 * m - 1)]
    scored += [((x + z / 2, y + z / 2), value(*of["xy"].at(2 * x + z - n + 1, 2 * y + z - m + 1))) for x in range(n) for y in range(m) for z in (0, 1) if 2 * x + z < 2 * n - 1 and 2 * y + z < 2 * m - 1]
    return _picked(scored, len(g))


def translational_symmetries(g: np.ndarray, background: int | None = None, ignore: Iterable[int] = (0,)) -> list[list[tuple[int, int]]]:
    """For each grid the best shift along x, the best along y, and where there is neither the best along both, forwards; of equals the smaller shift, forwards before backwards."""
    scores = Scores(g, "shift", background, tuple(ignore))
    _, n, m = g.shape

    def best(shifts: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        order = sorted(shifts, key=lambda s: (abs(s[0]) + abs(s[1]), -s[0] - s[1], s))
        scored = []
        for s in order:
            kept, off, conflict = scores.at(*s)
            worth = kept - 0.01 * off - 1e5 * conflict
            scored.append((s, np.where(worth > 0, worth, -np.inf)))
        return [x[:1] for x in _picked(scored, len(g))]

    ways = lambda k: [d for d in range(1 - k, k) if d]
    along = [a + b for a, b in zip(best([(d, 0) for d in ways(n)]), best([(0, d) for d in ways(m)]), strict=True)]
    both = best([(dx, dy) for dx in range(1, n) for dy in range(1, m)])
    return [a or b for a, b in zip(along, both, strict=True)]


def rotational_symmetry(g: np.ndarray, background: int | None = None, ignore: Iterable[int] = (0,)) -> list[tuple[float, float] | None]:
    """For each grid the first of the best centres of quarter turns, or none."""
    scores = Scores(g, "turn", background, tuple(ignore))
    _, n, m = g.shape
    scored = []
    for x in range(n):
        for y in range(m):
            for z in (0, 1):  # in the middle of a cell, or where four cells meet
                kept, off, conflict = scores.at(x - y, x + y + z - n + 1)
                worth = kept - 5 * off - 1000 * conflict
                scored.append(((x + z / 2, y + z / 2), np.where(worth > 0, worth, -np.inf)))
    return [p[0] if p else None for p in _picked(scored, len(g))]
