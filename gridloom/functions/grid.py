"""Grid algebra as Column expressions: everything here stays in Catalyst.

A grid is ARRAY<ARRAY<INT>> stored [row][column]; x is the first index, y the second.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ALIASES, LARGEST, MODEL_COLORS


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def height(g: Column) -> Column:
    return F.size(g)


def width(g: Column) -> Column:
    return F.size(F.get(g, 0))


def span(n) -> Column:
    """0 to n - 1; empty for n <= 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(_c(n), F.lit(1)) - 1), lambda i: i < _c(n))


def build(n, m, cell) -> Column:
    """An n x m grid of cell(i, j)."""
    return F.transform(span(n), lambda i: F.transform(span(m), lambda j: cell(i, j)))


def at(g: Column, i, j) -> Column:
    """A cell; null outside the grid."""
    return F.get(F.get(g, _c(i)), _c(j))


def map_cells(g: Column, f) -> Column:
    return F.transform(g, lambda r: F.transform(r, f))


def is_grid(g: Column) -> Column:
    """Not empty, rectangular, and all cells 0 to 9."""
    rows = F.forall(g, lambda r: (F.size(r) == width(g)) & F.forall(r, lambda c: F.coalesce(c.between(0, 9), F.lit(False))))
    return F.coalesce((F.size(g) > 0) & (width(g) > 0) & rows, F.lit(False))


def is_small_grid(g: Column, largest: int = LARGEST) -> Column:
    return is_grid(g) & (F.greatest(height(g), width(g)) <= largest)


def pair_fits(p: Column, largest: int = LARGEST) -> Column:
    return F.greatest(height(p["input"]), width(p["input"]), height(p["output"]), width(p["output"])) <= largest


def all_color(g: Column, color: int = 0) -> Column:
    return F.forall(F.flatten(g), lambda c: c == color)


def scale(g: Column, k) -> Column:
    """Every cell becomes a k x k block."""
    return F.flatten(F.transform(g, lambda r: F.array_repeat(F.flatten(F.transform(r, lambda c: F.array_repeat(c, _c(k)))), _c(k))))


def blit(canvas: Column, sprite: Column, x=0, y=0, background: int | None = 0) -> Column:
    """The sprite laid over the canvas at (x, y), clipped; background cells are see-through (None: none are)."""

    def cell(r, i):
        def one(c, j):
            s = at(sprite, i - _c(x), j - _c(y))
            inside = (i >= _c(x)) & (j >= _c(y)) & s.isNotNull()
            return F.when(inside if background is None else inside & (s != background), s).otherwise(c)

        return F.transform(r, one)

    return F.transform(canvas, cell)


def cells(g: Column) -> Column:
    """ARRAY<STRUCT<x, y, c>> of all cells, row by row."""
    return F.flatten(F.transform(g, lambda r, i: F.transform(r, lambda c, j: F.struct(i.alias("x"), j.alias("y"), c.alias("c")))))


def bounding_box(g: Column, background: int = 0) -> Column:
    """STRUCT<x, y, w, h> of the cells that are not background; none: (n, m, -n, -m)."""

    def box(g, full):
        low = lambda k, n: F.coalesce(F.array_min(full[k]), n)
        high = lambda k: F.coalesce(F.array_max(full[k]), F.lit(-1))
        x, y = low("x", height(g)), low("y", width(g))
        return F.struct(x.alias("x"), y.alias("y"), (high("x") - x + 1).alias("w"), (high("y") - y + 1).alias("h"))

    return let(g, lambda x: let(F.filter(cells(x), lambda p: p["c"] != background), lambda full: box(x, full)))


def bounding_box_mask(g: Column, background: int = 0) -> Column:
    def mask(g, b):
        return F.transform(g, lambda r, i: F.transform(r, lambda c, j: i.between(b["x"], b["x"] + b["w"] - 1) & j.between(b["y"], b["y"] + b["h"] - 1)))

    return let(g, lambda x: let(bounding_box(x, background), lambda b: mask(x, b)))


def object_position(g: Column, anchor: str = "upper left", background: int = 0) -> Column:
    """STRUCT<x, y> of one of nine anchors of the bounding box; top and bottom, or upper and lower."""
    b = bounding_box(g, background)
    words = anchor.lower().replace("-", " ").split()
    low, high = ("top", "upper", "left"), ("bottom", "lower", "right")

    def place(start, size, names):
        k = 0.0 if any(w in low and w in names for w in words) else 1.0 if any(w in high and w in names for w in words) else 0.5
        return start + (size - 1) * F.lit(k)

    return F.struct(place(b["x"], b["w"], ("left", "right")).alias("x"), place(b["y"], b["h"], ("top", "upper", "bottom", "lower")).alias("y"))


def object_colors(g: Column, background: int = 0) -> Column:
    """Distinct colours other than the background, in order."""
    return F.array_sort(F.filter(F.array_distinct(F.flatten(g)), lambda c: c != background))


def crop(g: Column, background: int = 0) -> Column:
    """The part of the grid inside its bounding box; an empty object has none."""
    b = bounding_box(g, background)
    return F.transform(F.slice(g, b["x"] + 1, F.greatest(b["w"], F.lit(0))), lambda r: F.slice(r, b["y"] + 1, F.greatest(b["h"], F.lit(0))))


def translate(g: Column, dx=0, dy=0, background: int = 0) -> Column:
    """Shifted by (dx, dy); cells pushed out are lost."""
    return build(height(g), width(g), lambda i, j: F.when((i >= _c(dx)) & (j >= _c(dy)), F.coalesce(at(g, i - _c(dx), j - _c(dy)), F.lit(background))).otherwise(background))


def collision(a: Column, b: Column, dx=0, dy=0, background: int = 0) -> Column:
    """Whether a and b, laid dx and dy further, share a cell that is not background."""
    hit = lambda p: (p["c"] != background) & (p["x"] >= _c(dx)) & (p["y"] >= _c(dy)) & F.coalesce(at(b, p["x"] - _c(dx), p["y"] - _c(dy)) != background, F.lit(False))
    return F.exists(cells(a), hit)


def flip_rows(g: Column) -> Column:
    return F.reverse(g)


def flip_columns(g: Column) -> Column:
    return F.transform(g, lambda r: F.reverse(r))


def transpose(g: Column) -> Column:
    return F.transform(span(width(g)), lambda j: F.transform(g, lambda r: F.get(r, j)))


def rot90(g: Column) -> Column:
    """A quarter turn clockwise."""
    return F.transform(transpose(g), lambda r: F.reverse(r))


def rot180(g: Column) -> Column:
    return flip_rows(flip_columns(g))


def rot270(g: Column) -> Column:
    return F.reverse(transpose(g))


def permute_colors(g: Column, mapping: Column) -> Column:
    """mapping: ARRAY<INT> whose k-th entry replaces colour k; null leaves it."""
    return let(mapping, lambda to: map_cells(g, lambda c: F.coalesce(F.get(to, c), c)))


def inverse_permutation(mapping: Column) -> Column:
    return F.transform(span(F.size(mapping)), lambda k: (F.array_position(mapping, k) - 1).cast("int"))


def seeded_permutation(key: Column, first: int = 1, last: int = 9) -> Column:
    """A permutation of colours first to last, drawn by hash of the key; others stay."""
    drawn = F.transform(F.array_sort(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda c: F.struct(F.md5(F.concat_ws("-", key.cast("string"), c.cast("string"))).alias("h"), c.alias("c")))), lambda s: s["c"])
    before, after = F.array(*[F.lit(c) for c in range(first)]), F.array(*[F.lit(c) for c in range(last + 1, 10)])
    return F.concat(before.cast("array<int>"), drawn, after.cast("array<int>"))


def augment(g: Column, key: Column, largest: int = LARGEST) -> Column:
    """One transform for all grids with the same key, drawn by md5 of it: colours (half: 1 to 9 permuted, a tenth: 0 to 9), columns and rows reversed, a quarter turn, and a scale that keeps within `largest`."""
    color, tosses = draw(key, "color", 10), lambda what: draw(key, what, 2) == 0
    g = let(g, lambda x: F.when(color < 5, permute_colors(x, seeded_permutation(key))).when(color == 5, permute_colors(x, seeded_permutation(key, 0, 9))).otherwise(x))
    g = let(g, lambda x: F.when(tosses("columns"), flip_columns(x)).otherwise(x))
    g = let(g, lambda x: F.when(tosses("rows"), flip_rows(x)).otherwise(x))
    g = let(g, lambda x: F.when(tosses("turn"), rot90(x)).otherwise(x))
    most = lambda x: F.greatest(F.floor(F.lit(largest) / F.greatest(height(x), width(x))).cast("int"), F.lit(1))
    return let(g, lambda x: F.when(tosses("scale"), scale(x, F.least(most(x), draw(key, "k", 3) + 1))).otherwise(x))


def draw(key: Column, what: str, n) -> Column:
    """A number from 0 to n - 1 that the key and the purpose decide: the first seven hex digits of an md5."""
    digits = F.substring(F.md5(F.concat_ws("-", F.lit(what), key.cast("string"))), 1, 7)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), _c(n).cast("long")).cast("int")


def drawn_transform(key: Column, side: Column, odds: float = 0.5, recolor: bool = True, largest: int = LARGEST) -> Column:
    """STRUCT<columns, rows, quarters, k, colors>: reversed columns and rows, a turn of one to three quarters and a scale of up to `largest` over the longest side, each with the same odds; colours 1 to 9 permuted for half of all keys, 0 to 9 for a tenth."""
    chance = lambda what: draw(key, what, 1000) < F.lit(int(1000 * odds))
    most = F.greatest(F.floor(F.lit(largest) / side).cast("int"), F.lit(1))
    colors = lambda of: F.when(of < 5, seeded_permutation(key)).when(of == 5, seeded_permutation(key, 0, 9)) if recolor else F.lit(None).cast("array<int>")
    # a struct in a `let`, as Spark would put a plain one's fields, hashes and all, wherever they are named
    return let(draw(key, "colors", 10), lambda of: F.struct(
        chance("columns").alias("columns"), chance("rows").alias("rows"), F.when(chance("turn"), draw(key, "quarters", 3) + 1).otherwise(0).alias("quarters"),
        F.when(chance("scale"), draw(key, "k", most) + 1).otherwise(1).alias("k"), colors(of).alias("colors"),
    ))


def translate_point(x, y, dx, dy, times=1) -> Column:
    """STRUCT<x, y> shifted a number of times, backwards too."""
    return F.struct((_c(x) + _c(dx) * _c(times)).alias("x"), (_c(y) + _c(dy) * _c(times)).alias("y"))


def compare(a: Column, b: Column) -> Column:
    """STRUCT<verdict, ratio>: EQUAL, SHAPE, CONTENT with the share of equal cells, or ERROR where a is missing and NON_2D where it is no grid."""
    same = F.aggregate(F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    ragged = ~F.forall(a, lambda r: F.size(r) == width(a)) | (F.size(a) == 0)
    shape = (height(a) != height(b)) | (width(a) != width(b))
    verdict = F.when(a.isNull(), "ERROR").when(ragged, "NON_2D").when(shape, "SHAPE").when(a == b, "EQUAL").otherwise("CONTENT")
    ratio = F.when(verdict == "EQUAL", 1.0).when(verdict == "CONTENT", same / (height(b) * width(b))).otherwise(0.0)
    return F.struct(verdict.alias("verdict"), ratio.alias("ratio"))


def digits(g: Column) -> Column:
    """All cells as one string of digits."""
    return F.array_join(F.flatten(g), "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of the flattened grids; two empty ones: 1."""
    longest = F.greatest(F.length(digits(a)), F.length(digits(b)))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(digits(a), digits(b)) / longest)


def to_text(g: Column, names: list[str] | None = None, cell: str = " ", row: str = "\n") -> Column:
    """Colour words (or with names=[] digits) by row."""
    names = MODEL_COLORS if names is None else names
    spell = (lambda c: F.get(F.array(*[F.lit(n) for n in names]), c)) if names else (lambda c: c.cast("string"))
    return F.array_join(F.transform(g, lambda r: F.array_join(F.transform(r, spell), cell)), row)


def from_text(text: Column, strict: bool = True, names: list[str] | None = None) -> Column:
    """A grid from colour words in any case, other spellings of the models' names too; a word that is none gives null in strict reading; else -1, and a last row of -1 only goes."""
    spelled = {n.lower(): k for k, n in enumerate(MODEL_COLORS if names is None else names)}
    if names is None:
        spelled = {n.lower(): k for n, k in ALIASES.items()} | spelled
    known = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    rows = F.split(F.regexp_replace(text, r"\A\s+|\s+\z", ""), "\n")
    word = lambda w: F.try_element_at(known, F.lower(w))
    grid = F.transform(rows, lambda r: F.transform(F.filter(F.split(r, r"\s+"), lambda w: w != ""), lambda w: F.coalesce(word(w), F.lit(-1))))
    if strict:
        return let(grid, lambda g: F.when(~F.exists(F.flatten(g), lambda c: c == -1), g))
    return let(grid, lambda g: F.when(F.forall(F.element_at(g, -1), lambda c: c == -1), F.slice(g, 1, F.size(g) - 1)).otherwise(g))


def between_boxes(a: Column, b: Column, x, y, padding: int = 0) -> Column:
    """Whether (x, y) lies in the gap between two bounding boxes along either axis, across it at least `padding` cells inside what both boxes have in common."""

    def gap(k, size, p, other, other_size, q):
        low, high = F.least(a[k] + a[size], b[k] + b[size]), F.greatest(a[k], b[k])
        over = F.greatest(a[other], b[other]) + padding
        under = F.least(a[other] + a[other_size], b[other] + b[other_size]) - padding
        return (p >= low) & (p < high) & (q >= over) & (q < under)

    return gap("x", "w", _c(x), "y", "h", _c(y)) | gap("y", "h", _c(y), "x", "w", _c(x))


def mirror_point(x, mx, odd=True) -> Column:
    """x reflected about mx; an even number of times leaves it."""
    return F.when(F.lit(odd), 2 * _c(mx) - _c(x)).otherwise(_c(x))


def rotate_point(x, y, cx, cy, turns: int = 1) -> Column:
    """STRUCT<x, y> turned about a centre by quarter turns; none for turns <= 0."""
    x, y = _c(x), _c(y)
    for _ in range(max(0, turns)):
        x, y = _c(cx) + (y - _c(cy)), _c(cy) - (x - _c(cx))
    return F.struct(x.alias("x"), y.alias("y"))
