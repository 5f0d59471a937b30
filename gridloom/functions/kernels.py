"""Grid functions that iterate: numpy kernels, and Arrow-batched Spark functions made of them.

`x` is the first index. Kernels take and give numpy arrays; `over_rows` lifts one to a
DataFrame, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

STEPS4 = ((0, 1), (0, -1), (1, 0), (-1, 0))
STEPS8 = (*STEPS4, (1, 1), (1, -1), (-1, 1), (-1, -1))


def steps(connectivity: int):
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    return STEPS4 if connectivity == 4 else STEPS8


def dilate(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Masks, one or a stack of them, with the cells next to theirs."""
    out = mask.copy()
    n, m = mask.shape[-2:]
    for dx, dy in steps(connectivity):
        out[..., max(0, dx) : n + min(0, dx), max(0, dy) : m + min(0, dy)] |= mask[..., max(0, -dx) : n + min(0, -dx), max(0, -dy) : m + min(0, -dy)]
    return out


def region(mask: np.ndarray, seen: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """The cells of mask that can be reached from those of `seen` inside it; also of a stack of masks."""
    seen = seen & mask
    while True:
        more = dilate(seen, connectivity) & mask
        if (more == seen).all():
            return seen
        seen = more


def flood_fill(g: np.ndarray, x: int, y: int, color: int, connectivity: int = 4) -> np.ndarray:
    """Recolours the region of (x, y)'s colour."""
    start = np.zeros(g.shape, bool)
    start[..., x, y] = True
    return np.where(region(g == g[..., x, y][..., None, None], start, connectivity), color, g)


def draw_line(g: np.ndarray, x: int, y: int, color: int, end=None, length=None, direction=None, stop_at=()) -> tuple[np.ndarray, tuple[int, int]]:
    """A line of steps by the sign of the direction, or of the way to `end` (as many steps as the longer side of that way). Cells off the canvas are passed over; a stop colour ends the line before it, at its start too. Returns (grid, last point drawn, or the start)."""
    out, n, a, b = _lines(g[None], x, y, color, end, length, direction, stop_at)
    return out[0], (int(a[n[0] - 1]), int(b[n[0] - 1])) if n[0] else (x, y)


def draw_lines(g: np.ndarray, x: int, y: int, color: int, end=None, length=None, direction=None, stop_at=()) -> np.ndarray:
    """The same line on every grid of a stack, each with its own stops."""
    return _lines(g, x, y, color, end, length, direction, stop_at)[0]


def _lines(g, x, y, color, end, length, direction, stop_at):
    if end is not None:
        direction = end[0] - x, end[1] - y
        length = max(map(abs, direction)) + 1
    length = 2 * max(g.shape[-2:]) if length is None else length
    k = np.arange(length)
    a, b = x + k * np.sign(direction[0]), y + k * np.sign(direction[1])
    inside = (a >= 0) & (a < g.shape[-2]) & (b >= 0) & (b < g.shape[-1])
    a, b = a[inside], b[inside]
    open_ = np.cumsum(np.isin(g[:, a, b], list(stop_at)), axis=1) == 0
    out = g.copy()
    out[:, a, b] = np.where(open_, color, out[:, a, b])
    return out, open_.sum(axis=1), a, b


def labels(g: np.ndarray, background: int = 0, connectivity: int = 4, one_color: bool = True) -> np.ndarray:
    """For each cell the number of the first cell of its object, cells counted row by row; background: -1. Of one grid or a stack."""
    n, m = g.shape[-2:]
    full = g != background
    out = np.where(full, np.arange(n * m).reshape(n, m), n * m)
    while True:
        new = out.copy()
        for dx, dy in steps(connectivity):
            to = (..., slice(max(0, dx), n + min(0, dx)), slice(max(0, dy), m + min(0, dy)))
            of = (..., slice(max(0, -dx), n + min(0, -dx)), slice(max(0, -dy), m + min(0, -dy)))
            joined = full[to] & full[of] & ((g[to] == g[of]) | (not one_color))
            np.minimum(new[to], np.where(joined, out[of], n * m), out=new[to])
        if (new == out).all():
            return np.where(full, out, -1)
        out = new


def count_components(g: np.ndarray, background: int = 0, connectivity: int = 4, one_color: bool = True) -> np.ndarray:
    n, m = g.shape[-2:]
    return (labels(g, background, connectivity, one_color) == np.arange(n * m).reshape(n, m)).sum(axis=(-2, -1))


def components(g: np.ndarray, background: int = 0, connectivity: int = 4, one_color: bool = True) -> list[np.ndarray]:
    """Each object on a full canvas, by colour (where objects have one) and then by its first cell."""
    label = labels(g, background, connectivity, one_color)
    first = [k for k in np.unique(label) if k >= 0]
    if one_color:
        first.sort(key=lambda k: (g.flat[k], k))
    return [np.where(label == k, g, background) for k in first]


def is_contiguous(g: np.ndarray, background: int = 0, connectivity: int = 4):
    """Whether there is one object; for a stack an array."""
    return count_components(g, background, connectivity, False) == 1


def exterior(g: np.ndarray, background: int = 0) -> np.ndarray:
    """Background cells that reach the border through background."""
    edge = np.ones(g.shape, bool)
    edge[..., 1:-1, 1:-1] = False
    return region(g == background, edge, 4)


def interior(g: np.ndarray, background: int = 0) -> np.ndarray:
    """Mask of what cannot be reached from the border, the object itself included."""
    return ~exterior(g, background)


def boundary(g: np.ndarray, background: int = 0) -> np.ndarray:
    """Mask of object cells at whose side (not corner) the outside lies, or the canvas edge."""
    outside = np.pad(exterior(g, background), [(0, 0)] * (g.ndim - 2) + [(1, 1)] * 2, constant_values=True)
    return dilate(outside, 4)[..., 1:-1, 1:-1] & (g != background)


def neighbors(g: np.ndarray, background: int = 0, connectivity: int = 4) -> np.ndarray:
    """Mask of cells next to the object."""
    return dilate(boundary(g, background), connectivity) & (g == background)


def contact(a: np.ndarray, b: np.ndarray, dx: int = 0, dy: int = 0, background: int = 0, connectivity: int = 4):
    """Whether b, moved by (dx, dy), overlaps or touches a; for stacks an array."""
    (n, m), (h, w) = a.shape[-2:], b.shape[-2:]
    mask = np.zeros((*a.shape[:-2], n + 2, m + 2), bool)
    x, y = max(0, -1 - dx), max(0, -1 - dy)
    to_x, to_y = min(h, n + 1 - dx), min(w, m + 1 - dy)
    if x < to_x and y < to_y:
        mask[..., x + dx + 1 : to_x + dx + 1, y + dy + 1 : to_y + dy + 1] = b[..., x:to_x, y:to_y] != background
    touched = (dilate(mask, connectivity)[..., 1:-1, 1:-1] & (a != background)).any(axis=(-2, -1))
    return bool(touched) if a.ndim == 2 else touched


def free_places(canvas: np.ndarray, sprite: np.ndarray, background: int = 0, border: int = 0, padding: int = 0, connectivity: int = 8):
    """Every (x, y) at which the sprite collides with nothing, padding and border kept free; for stacks a list for each."""
    full = canvas != background
    for _ in range(padding):
        full = dilate(full, connectivity)
    (n, m), (h, w), own = canvas.shape[-2:], sprite.shape[-2:], sprite != background
    places = [(x, y) for x in range(border, n - h - border + 1) for y in range(border, m - w - border + 1)]
    free = [~(full[..., x : x + h, y : y + w] & own).any(axis=(-2, -1)) for x, y in places]
    if canvas.ndim == 2:
        return [p for p, ok in zip(places, free, strict=True) if ok]
    return [[p for p, ok in zip(places, free, strict=True) if ok[k]] for k in range(len(canvas))]


def score_symmetry(g: np.ndarray, move: Callable[[int, int], tuple[float, float]], background: int | None = None, ignore=(0,)) -> tuple[int, int, int]:
    """(cells kept, cells moved off the canvas, cells in conflict) under a map of points. Ignored colours neither move nor conflict; the background (None: no colour) does not move."""
    x, y = np.nonzero(~np.isin(g, list(ignore)) & (True if background is None else g != background))
    a, b = (np.asarray(v).astype(int) for v in move(x, y))
    inside = (a >= 0) & (a < g.shape[0]) & (b >= 0) & (b < g.shape[1])
    own, other = g[x, y][inside], g[a[inside], b[inside]]
    return int((own == other).sum()), int((~inside).sum()), int(((own != other) & ~np.isin(other, list(ignore))).sum())


def centres(n: int) -> list[float]:
    """Whole and half places, from each cell to half a cell beyond it."""
    return [c / 2 for c in range(2 * n)]


def _both(n: int, m: int) -> list[tuple[float, float]]:
    """Centres that lie in the middle of a cell, or where four cells meet."""
    return [(x + z, y + z) for x in range(n) for y in range(m) for z in (0, 0.5)]


def mirror_symmetries(g: np.ndarray, background: int | None = None, ignore=(0,)) -> list[tuple[float | None, float | None]]:
    """(mx, my) of the best axes without a conflict; all ties, x axes first, then y, then both."""
    n, m = g.shape
    scored = []
    for mx, my in [(c, None) for c in centres(n)] + [(None, c) for c in centres(m)] + _both(n, m):
        kept, off, conflict = score_symmetry(g, lambda x, y, mx=mx, my=my: (x if mx is None else 2 * mx - x, y if my is None else 2 * my - y), background, ignore)
        if not conflict and kept and kept - 0.01 * off > 0:
            scored.append((kept - 0.01 * off, (mx, my)))
    best = max((s for s, _ in scored), default=None)
    return [a for s, a in scored if s == best]


def translational_symmetries(g: np.ndarray, background: int | None = None, ignore=(0,)) -> list[tuple[int, int]]:
    """The best shift along x, the best along y, both ways tried, and where there is neither the best along both, forwards; of equals the smaller shift, forwards before backwards. (The shift backwards has the same orbits.)"""
    n, m = g.shape

    def best(shifts):
        scored = []
        for dx, dy in shifts:
            kept, off, conflict = score_symmetry(g, lambda x, y, dx=dx, dy=dy: (x + dx, y + dy), background, ignore)
            value = kept - 0.01 * off - 1e5 * conflict
            if value > 0:
                scored.append((-value, abs(dx) + abs(dy), -dx - dy, (dx, dy)))
        return [min(scored)[-1]] if scored else []

    ways = lambda k: [d for d in range(1 - k, k) if d]
    out = best([(dx, 0) for dx in ways(n)]) + best([(0, dy) for dy in ways(m)])
    return out or best([(dx, dy) for dx in range(1, n) for dy in range(1, m)])


def rotational_symmetry(g: np.ndarray, background: int | None = None, ignore=(0,)) -> tuple[float, float] | None:
    """The first of the best centres of quarter turns, or none."""
    best = None
    for cx, cy in _both(*g.shape):
        kept, off, conflict = score_symmetry(g, lambda x, y, cx=cx, cy=cy: (cx + (y - cy), cy - (x - cx)), background, ignore)
        value = kept - 5 * off - 1000 * conflict
        if value > 0 and (best is None or value > best[0]):
            best = value, (cx, cy)
    return best and best[1]


def orbit(g: np.ndarray, x: int, y: int, maps: list[tuple[Callable, range]]) -> list[tuple[int, int]]:
    """Distinct points that (x, y) goes to under every combination of repeats, as long as each map leaves it inside the canvas."""
    inside = lambda p: 0 <= p[0] < g.shape[-2] and 0 <= p[1] < g.shape[-1]
    points = {(x, y)}
    for move, times in maps:
        points = {p for a, b in points for k in times if inside(p := move(a, b, k))}
    return sorted((int(a), int(b)) for a, b in points if float(a).is_integer() and float(b).is_integer())


def apply_symmetry(sprite: np.ndarray, kind: str, background: int = 0) -> np.ndarray:
    """The sprite, or each of a stack, with the symmetry enforced: empty cells take the colour of their images."""
    x, y = sprite[..., ::-1, :], sprite[..., ::-1]
    turns = [np.rot90(sprite, k, (-2, -1)) for k in (1, 2, 3)] if kind == "radial" else []
    images = {"horizontal": [x], "vertical": [y], "diagonal": [np.swapaxes(sprite, -1, -2)], "mirror": [x, y, x[..., ::-1]], "not_symmetric": [], "radial": turns}[kind]
    out = sprite.copy()
    for other in images:
        if other.shape != sprite.shape:
            raise ValueError("this symmetry needs a square sprite")
        out = np.where(out == background, other, out)
    return out


def detect_objects(g: np.ndarray, background: int = 0, connectivity: int = 4, one_color: bool = False, allowed: list[tuple[int, int]] | None = None, predicate=None, overlap: bool = True) -> list[np.ndarray]:
    """Objects that are components or, where sizes are allowed, windows of those sizes; largest box and mass first. Without overlap: the choice that covers most cells, of equal ones that of fewest objects, then of the first ones."""
    found = components(g, background, connectivity, one_color)
    for h, w in allowed or []:
        for x in range(g.shape[0] - h + 1):
            for y in range(g.shape[1] - w + 1):
                part = np.full_like(g, background)
                part[x : x + h, y : y + w] = g[x : x + h, y : y + w]
                found.append(part)

    def extent(o):
        p = np.argwhere(o != background)
        return tuple(p.max(0) - p.min(0) + 1) if len(p) else (0, 0)

    keep: dict[bytes, np.ndarray] = {}
    sizes = {tuple(a) for a in allowed or []}
    for o in found:
        e = extent(o)
        if e != (0, 0) and (not allowed or e in sizes) and (predicate is None or predicate(o)):
            keep.setdefault(o.tobytes(), o)
    out = sorted(keep.values(), key=lambda o: (-int(np.prod(extent(o))), -int((o != background).sum())))
    return out if overlap else [out[i] for i in greatest_cover([(o != background).ravel() for o in out])]


def greatest_cover(masks: list[np.ndarray]) -> list[int]:
    """Numbers of masks of which no two meet and that cover most cells; of equal choices the one of fewest masks, then the first.

    Masks that meet, directly or through others, are searched together and apart from the
    rest: one mask after the other is taken or left, and a branch is cut when all cells that
    its open masks could add do not make it better. Sets of cells and masks are bit fields.
    """
    bits = [int.from_bytes(np.packbits(m, bitorder="little").tobytes(), "little") for m in masks]
    meets = [sum(1 << j for j, b in enumerate(bits) if i != j and a & b) for i, a in enumerate(bits)]
    chosen: list[int] = []
    left = (1 << len(bits)) - 1
    while left:
        group, new = 0, left & -left
        while new:
            group |= new
            reached = 0
            for i in _ones(new):
                reached |= meets[i]
            new = reached & ~group
        left &= ~group
        chosen += _best_of(list(_ones(group)), bits, meets)
    return sorted(chosen)


def _ones(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _best_of(group: list[int], bits: list[int], meets: list[int]) -> list[int]:
    best: tuple[int, int, list[int]] = (0, 0, [])
    stack: list[tuple[int, int, list[int]]] = [(sum(1 << i for i in group), 0, [])]  # masks still open, cells covered, masks taken
    while stack:
        open_, covered, taken = stack.pop()
        if (covered, -len(taken)) > best[:2]:  # branches come in order, so of equals the first stays
            best = covered, -len(taken), taken
        reach = 0
        for i in _ones(open_):
            reach |= bits[i]
        bound = covered + reach.bit_count()  # open masks meet none that is taken
        if not open_ or (bound, -len(taken) - 1) <= best[:2]:
            continue
        i = (open_ & -open_).bit_length() - 1
        open_ &= ~(1 << i)
        stack.append((open_, covered, taken))
        stack.append((open_ & ~meets[i], covered + bits[i].bit_count(), [*taken, i]))
    return best[2]


def scatter(g: np.ndarray, color: int, density: float, seed: int, background: int = 0) -> np.ndarray:
    """random_grids.scatter for one grid."""
    from . import random_grids

    return random_grids.scatter(g[None], np.array([seed]), color, density, background)[0]


def spaced_indices(n: int, count: int, seed: int, border: int = 0, padding: int = 1) -> list[int]:
    """random_grids.spaced_indices for one key."""
    from . import random_grids

    picked = random_grids.spaced_indices(np.array([seed]), n, count, border, padding)
    if picked is None:
        raise ValueError("too many indices")
    return picked[0].tolist()


def random_sprite(n: int, m: int, seed: int, density: float = 0.5, symmetry: str | None = None, colors=None, background: int = 0, connectivity: int = 4) -> np.ndarray:
    """random_grids.sprites for one key."""
    from . import random_grids

    return random_grids.sprites(np.array([seed]), n, m, density, symmetry, colors, connectivity, background)[0]


def over_rows(df: DataFrame, grid: str, name: str, kind: str, kernel: Callable[..., object], stacked: bool = False, key: str | None = None) -> DataFrame:
    """df with a column `name` of type `kind`: the kernel's value for each row's grid; null for null. Batches go through Arrow; a stacked kernel takes all grids of one shape in a batch at once, and where `key` names a whole number their keys (null: 0)."""
    out = T.StructType([*df.schema.fields, T.StructField(name, T.DataType.fromDDL(kind))])

    def plain(v):
        if isinstance(v, np.ndarray):
            return v.astype(bool if v.dtype == bool else int).tolist()
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v.item() if isinstance(v, np.generic) else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(out.fields[-1].dataType)
        for b in batches:
            grids = b.column(grid).to_pylist()
            values: list = [None] * len(grids)
            if stacked:
                keys = np.array([k or 0 for k in b.column(key).to_pylist()], np.int64) if key else None
                shapes: dict[tuple[int, int], list[int]] = {}
                for k, g in enumerate(grids):
                    if g is not None:
                        shapes.setdefault((len(g), len(g[0]) if g else 0), []).append(k)
                for own in shapes.values():
                    for k, v in zip(own, kernel(np.array([grids[k] for k in own], int), *([keys[own]] if key else [])), strict=True):
                        values[k] = plain(v)
            else:
                values = [None if g is None else plain(kernel(np.array(g, int))) for g in grids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, arrow)], names=[*b.schema.names, name])

    return df.mapInArrow(run, out)


def moved(grids: pa.ListArray, columns: np.ndarray, rows: np.ndarray, quarters: np.ndarray, k: np.ndarray, colors: np.ndarray) -> pa.ListArray:
    """Rectangular grids of colours 0 to 9, each with columns and rows reversed, turned clockwise by quarters, recoloured by its row of `colors` and scaled by k."""
    lines = grids.flatten()
    n = grids.value_lengths().to_numpy().astype(np.int64)
    m = lines.value_lengths().to_numpy().astype(np.int64)[np.cumsum(n) - n]
    cells = lines.flatten().to_numpy()
    # cell (i, j) of the turned grid comes from row x + xi * i + xj * j, column y + yi * i + yj * j
    x, xi, xj = np.where((quarters == 1) | (quarters == 2), n - 1, 0), np.array([1, 0, -1, 0])[quarters], np.array([0, -1, 0, 1])[quarters]
    y, yi, yj = np.where(quarters >= 2, m - 1, 0), np.array([0, 1, 0, -1])[quarters], np.array([1, 0, -1, 0])[quarters]
    x, xi, xj = np.where(rows, n - 1 - x, x), np.where(rows, -xi, xi), np.where(rows, -xj, xj)
    y, yi, yj = np.where(columns, m - 1 - y, y), np.where(columns, -yi, yi), np.where(columns, -yj, yj)
    start = np.cumsum(n * m) - n * m
    high, wide = np.where(quarters % 2 == 1, m, n), np.where(quarters % 2 == 1, n, m)
    own = np.repeat(np.arange(len(n)), n * m)
    i, j = np.divmod(np.arange(len(own)) - start[own], wide[own])
    turned = cells[(start + x * m + y)[own] + (xi * m + yi)[own] * i + (xj * m + yj)[own] * j]
    long = np.repeat(colors[own, turned].astype(cells.dtype), k[own])
    once = pa.ListArray.from_arrays(_offsets(np.repeat(wide * k, high)), pa.array(long))
    return pa.ListArray.from_arrays(_offsets(high * k), once.take(pa.array(np.repeat(np.arange(len(once)), np.repeat(k, high)))))


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def moved_pairs(df: DataFrame, lists: tuple[str, ...], transform: str, rows: int = 1024) -> DataFrame:
    """df without `transform`, a struct as of grid.drawn_transform(), and with the pairs in the columns `lists`, ARRAY<STRUCT<input, output, other>>, under it; where `other`, under its complement, which reverses what it does not and turns a quarter further. `rows` go through numpy at a time."""
    whole = lambda g: T.ArrayType(T.ArrayType(g.elementType.elementType, False), False)  # noqa: E731  (no cell is null, so none is asked)
    bare = lambda kind: T.ArrayType(T.StructType([T.StructField(f, whole(kind.elementType[f].dataType), False) for f in ("input", "output")]), False)
    out = T.StructType([T.StructField(f.name, bare(f.dataType) if f.name in lists else f.dataType) for f in df.schema.fields if f.name != transform])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (all_.slice(at, rows) for all_ in batches for at in range(0, all_.num_rows, rows)):
            t = b.column(transform)
            columns, lines, quarters, k = (t.field(f).to_numpy(zero_copy_only=False) for f in ("columns", "rows", "quarters", "k"))
            drawn, colors = t.field("colors"), np.tile(np.arange(10), (b.num_rows, 1))
            colors[drawn.is_valid().to_numpy(zero_copy_only=False)] = drawn.flatten().to_numpy().reshape(-1, 10)
            done = []
            for f in out.names:
                v = b.column(f)
                if f in lists:
                    sizes, pairs = v.value_lengths().to_numpy(), v.flatten()
                    own, other = np.repeat(np.arange(b.num_rows), sizes), pairs.field("other").to_numpy(zero_copy_only=False).astype(bool)
                    sides = [moved(pairs.field(s), columns[own] ^ other, lines[own] ^ other, (quarters[own] + other) % 4, k[own].astype(np.int64), colors[own]) for s in ("input", "output")]
                    v = pa.ListArray.from_arrays(_offsets(sizes), pa.StructArray.from_arrays(sides, ["input", "output"]))
                done.append(v)
            yield pa.RecordBatch.from_arrays(done, out.names)

    return df.mapInArrow(run, out)
