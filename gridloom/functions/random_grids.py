"""Random grids on stacks, by a generator that counts: what is drawn for a row depends on its
key and the step alone, never on the batch that it is in.
"""

from __future__ import annotations

import numpy as np

from .kernels import STEPS4, STEPS8, apply_symmetry, is_contiguous

#: Draws are numbers below this prime; fifth powers permute them, and products fit a long.
PRIME = 2_147_483_647
KINDS = ("horizontal", "vertical", "not_symmetric", "mirror", "diagonal", "radial")
#: Kinds that need a square.
SQUARE = ("diagonal", "radial")


def _fifth(x: np.ndarray) -> np.ndarray:
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def draws(keys: np.ndarray, step) -> np.ndarray:
    """A number below PRIME for each key and step; both are whole and not negative. Shapes broadcast."""
    keys, step = np.asarray(keys, np.int64), np.asarray(step, np.int64)
    x = _fifth((keys % PRIME * 48_271 + step % PRIME * 69_621 + keys // PRIME + 1) % PRIME)
    return _fifth((x * 16_807 + keys % PRIME + step % PRIME * 7_919) % PRIME)


def scatter(g: np.ndarray, keys: np.ndarray, color: int, density: float, background: int = 0) -> np.ndarray:
    """Background cells recoloured, those of the smallest draws, until their number is `density` of all cells, or none is left."""
    flat = g.reshape(len(g), -1)
    mark = draws(keys[:, None], np.arange(flat.shape[1])).astype(float)
    order = np.argsort(np.where(flat == background, mark, np.inf), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(flat.shape[1]), flat.shape), axis=1)
    hit = (flat == background) & (rank < np.ceil(density * flat.shape[1]))
    return np.where(hit, color, flat).reshape(g.shape)


def spaced_indices(keys: np.ndarray, size: int, count: int, border: int = 1, padding: int = 1) -> np.ndarray | None:
    """(keys, count) numbers below size, in order, with at least `padding` others between two, and with a border `border` others before the first and two after the last; none where there is no room. All choices are as likely."""
    room = size - (border + 2 if border > 0 else 0) - (count - 1) * padding
    if count < 1 or room < count:
        return None
    mark = draws(keys[:, None], np.arange(room))
    picked = np.sort(np.argsort(mark, axis=1, kind="stable")[:, :count], axis=1)
    return picked + np.arange(count) * padding + border


def palettes(keys: np.ndarray, background: int = 0, most: int = 9, colors: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(colours in an order of their own for each key, how many of them count): one more with odds of three in ten each time."""
    number = np.ones(len(keys), int)
    going = np.ones(len(keys), bool)
    for k in range(most - 1):
        going &= draws(keys, 1_000 + k) < 0.3 * PRIME
        number += going
    mark = draws(keys[:, None], 2_000 + np.arange(colors)).astype(float)
    mark[:, background] = np.inf
    return np.argsort(mark, axis=1, kind="stable"), number


def sprites(keys: np.ndarray, n: int, m: int, density: float = 0.5, symmetry: str | None = None, palette=None, connectivity: int = 4, background: int = 0) -> np.ndarray:
    """A stack of sprites, one for each key: connected, touching all four borders, with the symmetry (None: drawn, where the shape allows it) and colours of the palette (None: drawn).

    A walk colours cells until the share is reached, changing its colour one time in three;
    the symmetry is laid over what it leaves. The share varies about `density` for larger
    sprites, and small ones have a higher one, so that they can reach all sides. What is not
    connected or misses a border is drawn anew, by later steps of the generator and with a
    share that is larger each time: a few cells of a quarter can never meet their images.
    """
    keys = np.asarray(keys, np.int64)
    if symmetry is None:
        open_ = [k for k in KINDS if n == m or k not in SQUARE]
        kind = draws(keys, 3_000) % len(open_)
    else:
        open_, kind = [symmetry], np.zeros(len(keys), int)
    out = np.full((len(keys), n, m), background)
    for k, name in enumerate(open_):
        todo = np.flatnonzero(kind == k)
        attempt = 0
        while len(todo):
            made = _drawn(keys[todo], attempt, n, m, density, name, palette, connectivity, background)
            full = made != background
            good = full[:, 0].any(1) & full[:, -1].any(1) & full[:, :, 0].any(1) & full[:, :, -1].any(1) & is_contiguous(made, background, connectivity)
            out[todo[good]] = made[good]
            todo, attempt = todo[~good], attempt + 1
    return out


def _share(keys: np.ndarray, base: int, n: int, m: int, density: float) -> np.ndarray:
    least = min(n, m)
    if least <= 3 or density >= 1:
        return np.full(len(keys), 1.0 if least == 1 else max(density, {2: 0.6, 3: 0.5}.get(least, density)))
    bell = sum(draws(keys, base + k) for k in range(12)) / PRIME - 6
    return np.clip(density + 0.1 * bell, 0.4, 0.95)


def _drawn(keys: np.ndarray, attempt: int, n: int, m: int, density: float, kind: str, palette, connectivity: int, background: int) -> np.ndarray:
    if kind not in KINDS or kind in SQUARE and n != m:
        raise ValueError(f"no sprite of {n} x {m} is {kind}")
    base = 10_000 + attempt * 1_000_003
    share = np.minimum(1.0, _share(keys, base, n, m, density) + 0.02 * attempt)
    order, number = palettes(keys, background) if palette is None else (np.tile(np.array(palette), (len(keys), 1)), np.full(len(keys), len(palette)))
    h, w = ((n + 1) // 2, (m + 1) // 2) if kind in ("mirror", "radial") else (n, m)
    x, y = draws(keys, base + 20) % h, draws(keys, base + 21) % w
    slant = draws(keys, base + 22) % 2 == 0
    if kind == "horizontal":
        y = np.full(len(keys), m // 2)
    elif kind == "vertical":
        x = np.full(len(keys), n // 2)
    elif kind == "diagonal":
        y = np.where(slant, n - 1 - x, x)
    elif kind == "radial":  # from the corner that becomes the middle, so that all four parts meet
        x, y = np.full(len(keys), h - 1), np.full(len(keys), w - 1)
    g = np.full((len(keys), h, w), background)
    steps = np.array(STEPS4 if connectivity == 4 else STEPS8)
    color = np.zeros(len(keys), int)
    going, step = np.arange(len(keys)), 100
    while len(going):
        own = keys[going]
        g[going, x[going], y[going]] = order[going, color[going]]
        change = draws(own, base + step) < 0.33 * PRIME
        color[going] = np.where(change, draws(own, base + step + 1) % number[going], color[going])
        d = steps[draws(own, base + step + 2) % len(steps)]
        a, b = x[going] + d[:, 0], y[going] + d[:, 1]
        inside = (a >= 0) & (a < h) & (b >= 0) & (b < w)
        x[going], y[going] = np.where(inside, a, x[going]), np.where(inside, b, y[going])
        step += 3
        going = going[(g[going] != background).sum(axis=(1, 2)) < share[going] * h * w]
    if kind == "mirror":
        half = np.concatenate((g, g[:, ::-1][:, n % 2 :]), axis=1)
        return np.concatenate((half, half[:, :, ::-1][:, :, m % 2 :]), axis=2)
    if kind == "radial":
        whole = np.full((len(keys), n, n), background)
        whole[:, :h, :w] = g
        return apply_symmetry(whole, "radial", background)
    if kind == "diagonal":
        return np.where(slant[:, None, None], apply_symmetry(g[:, ::-1], "diagonal", background)[:, ::-1], apply_symmetry(g, "diagonal", background))
    return apply_symmetry(g, kind, background)
