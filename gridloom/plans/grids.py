"""Grid queries. Grids are derived from part: 3 + p_size % 4 rows, 3 + p_partkey % 3 columns, cells (p_partkey * 7 + 3 i + 5 j + i j) % 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import kernels as K
from ..functions import random_grids as R
from ..functions import symmetry as Y
from ..functions import text as X
from ..session import dealt
from .registry import query

_CELL = "((p_partkey * 7 + i * 3 + j * 5 + i * j) % 10)::INT"
_N, _M = "(3 + p_size % 4)", "(3 + p_partkey % 3)"
BASE = f"WITH p AS (SELECT p_partkey, {_N} n, {_M} m, list_transform(range({_N}), lambda i: list_transform(range({_M}), lambda j: {_CELL})) g FROM part) "


def derived(part):
    n, m = 3 + F.col("p_size") % 4, 3 + F.col("p_partkey") % 3
    return part.select("p_partkey", G.build(n, m.cast("int"), lambda i, j: ((F.col("p_partkey") * 7 + i * 3 + j * 5 + i * j) % 10).cast("int")).alias("g"))


def cells(cell: str, n: str = "n", m: str = "m") -> str:
    """SQL of a derived grid as JSON; cell in i and j from 0, g[i+1][j+1]."""
    return BASE + f"SELECT p_partkey, to_json(list_transform(range({n}), lambda i: list_transform(range({m}), lambda j: {cell})))::VARCHAR AS grid FROM p"


def shape_query(name: str, sql: str, f):
    @query(sql, name=name)
    def one(t):
        return derived(t("part")).select("p_partkey", F.to_json(f(F.col("g"))).alias("grid"))


shape_query("grid_flip", cells("g[n-i][j+1]"), G.flip_rows)
shape_query("grid_mirror", cells("g[i+1][m-j]"), G.flip_columns)
shape_query("grid_rot90", cells("g[n-j][i+1]", "m", "n"), G.rot90)
shape_query("grid_rot180", cells("g[n-i][m-j]"), G.rot180)
shape_query("grid_rot270", cells("g[j+1][m-i]", "m", "n"), G.rot270)
shape_query("grid_transpose", cells("g[j+1][i+1]", "m", "n"), G.transpose)
shape_query("grid_scale", cells("g[i//2+1][j//2+1]", "2*n", "2*m"), lambda g: G.scale(g, 2))
shape_query("grid_translate", cells("CASE WHEN i >= 1 AND j >= 2 THEN g[i][j-1] ELSE 0 END"), lambda g: G.translate(g, 1, 2))
shape_query("grid_blit", cells("CASE WHEN i >= 1 AND j >= 1 AND g[i][j] <> 0 THEN g[i][j] ELSE g[i+1][j+1] END"), lambda g: G.blit(g, g, 1, 1))
shape_query("grid_color_permute", cells("[0,2,3,4,5,6,7,8,9,1][g[i+1][j+1]+1]"), lambda g: G.permute_colors(g, F.array(*[F.lit(c) for c in (0, 2, 3, 4, 5, 6, 7, 8, 9, 1)])))
shape_query("grid_color_inverse", cells("[0,9,1,2,3,4,5,6,7,8][g[i+1][j+1]+1]"), lambda g: G.permute_colors(g, G.inverse_permutation(F.array(*[F.lit(c) for c in (0, 2, 3, 4, 5, 6, 7, 8, 9, 1)]))))
shape_query("grid_text_round_trip", cells("g[i+1][j+1]"), lambda g: G.from_text(G.to_text(g)))

_LONG = BASE + ", c AS (SELECT p_partkey, n, m, i, j, g[i+1][j+1] v FROM p, range(6) a(i), range(5) b(j) WHERE i < n AND j < m) "
_BOX = _LONG + ", b AS (SELECT p.p_partkey, coalesce(min(i) FILTER (v >= 7), any_value(p.n)) x, coalesce(min(j) FILTER (v >= 7), any_value(p.m)) y, coalesce(max(i) FILTER (v >= 7), -1) x2, coalesce(max(j) FILTER (v >= 7), -1) y2 FROM p JOIN c USING (p_partkey) GROUP BY p.p_partkey) "


def _objects(t):
    """Cells under 7 as background 0."""
    return derived(t("part")).select("p_partkey", G.map_cells(F.col("g"), lambda c: F.when(c >= 7, c).otherwise(0)).alias("g"))


@query(_BOX + "SELECT p_partkey, x::INT AS x, y::INT AS y, (x2 - x + 1)::INT AS w, (y2 - y + 1)::INT AS h FROM b")
def grid_bbox(t):
    return _objects(t).select("p_partkey", G.bounding_box(F.col("g")).alias("b")).select("p_partkey", "b.*")


@query(_BOX + "SELECT p_partkey, to_json(list_transform(range(x2 - x + 1), lambda i: list_transform(range(y2 - y + 1), lambda j: CASE WHEN g[i + x + 1][j + y + 1] >= 7 THEN g[i + x + 1][j + y + 1] ELSE 0 END)))::VARCHAR AS grid FROM b JOIN p USING (p_partkey) WHERE x2 >= 0")
def grid_crop(t):
    o = _objects(t).filter(~G.all_color(F.col("g")))
    return o.select("p_partkey", F.to_json(G.crop(F.col("g"))).alias("grid"))


_ANCHORS = {f"{a} {b}".strip() or "center": (h / 2, v / 2) for v, a in enumerate(("upper", "", "lower")) for h, b in enumerate(("left", "", "right"))}


@query(_BOX + "SELECT p_partkey, anchor, (x + (x2 - x) * h)::DOUBLE AS x, (y + (y2 - y) * v)::DOUBLE AS y FROM b, (VALUES " + ", ".join(f"('{k}', {h}, {v})" for k, (h, v) in _ANCHORS.items()) + ") t(anchor, h, v) WHERE x2 >= 0")
def grid_position(t):
    """All nine anchors of each object."""
    o = _objects(t).filter(~G.all_color(F.col("g")))
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("anchor"), G.object_position(F.col("g"), k).alias("q")) for k in _ANCHORS])).alias("p")
    return o.select("p_partkey", places).select("p_partkey", "p.anchor", F.col("p.q.x").cast("double").alias("x"), F.col("p.q.y").cast("double").alias("y"))


@query(_LONG + "SELECT p_partkey, string_agg(v::VARCHAR, ',' ORDER BY v) AS colors FROM (SELECT DISTINCT p_partkey, v FROM c WHERE v <> 0) GROUP BY p_partkey")
def grid_colors(t):
    return derived(t("part")).select("p_partkey", F.array_join(G.object_colors(F.col("g")), ",").alias("colors"))


@query(_LONG + "SELECT v::INT AS color, count(*) AS n FROM c GROUP BY v")
def grid_histogram(t):
    return derived(t("part")).select(F.explode(F.flatten("g")).alias("color")).groupBy("color").agg(F.count("*").alias("n"))


@query(BASE + "SELECT p_partkey, n <= 5 AS valid FROM p")
def grid_valid(t):
    broken = derived(t("part")).select("p_partkey", F.when(F.size("g") > 5, F.concat("g", F.array(F.array(F.lit(10))))).otherwise(F.col("g")).alias("g"))
    return broken.select("p_partkey", G.is_small_grid(F.col("g")).alias("valid"))


@query(BASE + "SELECT p_partkey, array_to_string(list_transform(range(n), lambda i: array_to_string(list_transform(range(m), lambda j: g[i+1][j+1]::VARCHAR), '|')), chr(10)) AS txt FROM p")
def grid_to_text(t):
    return derived(t("part")).select("p_partkey", G.to_text(F.col("g"), [], "|").alias("txt"))


_PAIR = BASE + ", q AS (SELECT p_partkey, n, m, g, list_transform(range(n), lambda i: list_transform(range(m), lambda j: g[n-i][j+1])) f FROM p) "


@query(_PAIR + ", d AS (SELECT p_partkey, n * m a, len(list_filter(range(n * m), lambda k: g[k // m + 1][k % m + 1] = f[k // m + 1][k % m + 1])) s, p_partkey % 5 AS kind FROM q), e AS (SELECT *, CASE WHEN kind = 2 THEN 'SHAPE' WHEN kind = 3 THEN 'ERROR' WHEN kind = 4 THEN 'NON_2D' WHEN kind = 0 OR s = a THEN 'EQUAL' ELSE 'CONTENT' END AS verdict FROM d) SELECT p_partkey, verdict, round(CASE verdict WHEN 'EQUAL' THEN 1.0 WHEN 'CONTENT' THEN s / a ELSE 0.0 END, 6)::DOUBLE AS ratio FROM e")
def grid_compare(t):
    """An answer of each kind: the truth, the truth upside down, with a row too many, none, with a row cut short."""
    g, kind = F.col("g"), F.col("p_partkey") % 5
    longer, ragged = F.concat(g, F.slice(g, 1, 1)), F.concat(F.array(F.slice(F.get(g, 0), 1, G.width(g) - 1)), F.slice(g, 2, 100))
    answer = F.when(kind == 0, g).when(kind == 1, G.flip_rows(g)).when(kind == 2, longer).when(kind == 4, ragged)
    return derived(t("part")).select("p_partkey", G.compare(answer, g).alias("v")).select("p_partkey", "v.verdict", F.round("v.ratio", 6).alias("ratio"))


@query(_PAIR + ", s AS (SELECT p_partkey, n * m a, array_to_string(flatten(g), '') x, array_to_string(flatten(f), '') y FROM q) SELECT p_partkey, round(1 - levenshtein(x, y) / a, 6) AS similarity FROM s")
def grid_levenshtein(t):
    return derived(t("part")).select("p_partkey", F.round(G.edit_similarity(F.col("g"), G.flip_rows(F.col("g"))), 6).alias("similarity"))


@query(BASE + "SELECT p_partkey, len(list_filter(range(n * m), lambda k: k // m >= 1 AND k % m >= 1 AND g[k // m + 1][k % m + 1] >= 7 AND g[k // m][k % m] >= 7)) > 0 AS hit FROM p")
def grid_collision(t):
    return _objects(t).select("p_partkey", G.collision(F.col("g"), F.col("g"), 1, 1).alias("hit"))


_PARTS = BASE + """, c AS (SELECT p_partkey, i, j FROM p, range(6) a(i), range(5) b(j) WHERE i < n AND j < m AND g[i+1][j+1] >= 5),
r AS (SELECT p_partkey, i, j, row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) l FROM c),
w AS (WITH RECURSIVE z AS (SELECT p_partkey, i, j, l FROM r UNION SELECT r.p_partkey, r.i, r.j, z.l FROM z JOIN r ON r.p_partkey = z.p_partkey AND abs(r.i - z.i) + abs(r.j - z.j) = 1) SELECT p_partkey, i, j, min(l) l FROM z GROUP BY ALL)
"""


@query(_PARTS + "SELECT p.p_partkey, count(DISTINCT l)::INT AS parts FROM p LEFT JOIN w USING (p_partkey) GROUP BY p.p_partkey")
def grid_components(t):
    o = derived(t("part")).select("p_partkey", G.map_cells(F.col("g"), lambda c: F.when(c >= 5, c).otherwise(0)).alias("g"))
    return K.over_rows(o, "g", "parts", "int", lambda g: K.count_components(g, one_color=False), stacked=True).select("p_partkey", "parts")


@query(BASE + """, c AS (SELECT p_partkey, n, m, i, j FROM p, range(6) a(i), range(5) b(j) WHERE i < n AND j < m AND g[i+1][j+1] < 5),
w AS (WITH RECURSIVE z AS (SELECT p_partkey, i, j FROM c WHERE i IN (0, n - 1) OR j IN (0, m - 1) UNION SELECT c.p_partkey, c.i, c.j FROM z JOIN c ON c.p_partkey = z.p_partkey AND abs(c.i - z.i) + abs(c.j - z.j) = 1) SELECT DISTINCT * FROM z)
SELECT p.p_partkey, (any_value(n * m) - count(w.i))::INT AS inside FROM p LEFT JOIN w USING (p_partkey) GROUP BY p.p_partkey""")
def grid_interior(t):
    o = derived(t("part")).select("p_partkey", G.map_cells(F.col("g"), lambda c: F.when(c >= 5, c).otherwise(0)).alias("g"))
    return K.over_rows(o, "g", "inside", "int", lambda g: K.interior(g).sum(axis=(-2, -1)), stacked=True).select("p_partkey", "inside")


@query(_LONG + ", k AS (SELECT a.p_partkey, count(*) FILTER (a.v <> 0 AND b.v = a.v) kept, count(*) FILTER (a.v <> 0 AND b.v IS NULL) off, count(*) FILTER (a.v <> 0 AND b.v <> a.v) conflict FROM c a LEFT JOIN c b ON b.p_partkey = a.p_partkey AND b.i = a.i AND b.j = a.j + 2 GROUP BY a.p_partkey) SELECT p_partkey, kept::INT AS kept, off::INT AS off, conflict::INT AS conflict FROM k")
def grid_symmetry_score(t):
    out = K.over_rows(derived(t("part")), "g", "s", "array<int>", lambda g: Y.shift_scores(g, 0, 2, 0, ()), stacked=True)
    return out.select("p_partkey", F.get("s", 0).alias("kept"), F.get("s", 1).alias("off"), F.get("s", 2).alias("conflict"))


_O = BASE + ", c AS (SELECT p_partkey, n, m, i::INT i, j::INT j, CASE WHEN g[i+1][j+1] >= 7 THEN g[i+1][j+1] ELSE 0 END v FROM p, range(6) a(i), range(5) b(j) WHERE i < n AND j < m)"
_OUTSIDE = """, x AS (WITH RECURSIVE z AS (SELECT p_partkey, i, j FROM c WHERE v = 0 AND (i IN (0, n - 1) OR j IN (0, m - 1)) UNION SELECT c.p_partkey, c.i, c.j FROM z JOIN c ON c.p_partkey = z.p_partkey AND c.v = 0 AND abs(c.i - z.i) + abs(c.j - z.j) = 1) SELECT DISTINCT * FROM z)"""
_EDGE = ", e AS (SELECT c.*, v <> 0 AND (i IN (0, n - 1) OR j IN (0, m - 1) OR EXISTS (SELECT 1 FROM x WHERE x.p_partkey = c.p_partkey AND abs(c.i - x.i) + abs(c.j - x.j) = 1)) AS f FROM c)"
_JOINED = """, w AS (WITH RECURSIVE z AS (SELECT p_partkey, i, j, i * 10 + j l FROM c WHERE v <> 0 UNION SELECT c.p_partkey, c.i, c.j, z.l FROM z JOIN c ON c.p_partkey = z.p_partkey AND c.v <> 0 AND abs(c.i - z.i) + abs(c.j - z.j) = 1) SELECT p_partkey, i, j, min(l) l FROM z GROUP BY ALL)"""


def _grid_of(f: str, source: str) -> str:
    """SQL: the grid of f(i, j) over a table of cells, as JSON in `value`."""
    return f"SELECT p_partkey, concat('{{\"value\":', to_json(list(r ORDER BY i)), '}}') AS value FROM (SELECT p_partkey, i, list({f} ORDER BY j) r FROM {source} GROUP BY p_partkey, i) GROUP BY p_partkey"


def _list_of(item: str, source: str, order: str) -> str:
    """SQL: for every part the list of its rows in a table, as JSON in `value`."""
    return f"SELECT p.p_partkey, concat('{{\"value\":', to_json(coalesce(list({item} ORDER BY {order}) FILTER (s.p_partkey IS NOT NULL), [])), '}}') AS value FROM p LEFT JOIN {source} s USING (p_partkey) GROUP BY p.p_partkey"


def _scored(tries: str, x: str, y: str) -> str:
    """SQL: for each try (k, a, b) how many cells a map of points keeps, moves off and sets in conflict; black neither moves nor conflicts."""
    return f""", t AS ({tries}), s AS (SELECT t.p_partkey, t.k, t.a, t.b, t.o, count(*) FILTER (q.v = c.v) kept, count(*) FILTER (q.v IS NULL) off, count(*) FILTER (q.v <> c.v AND q.v <> 0) conflict
FROM t JOIN c ON c.p_partkey = t.p_partkey AND c.v <> 0 LEFT JOIN c q ON q.p_partkey = c.p_partkey AND q.i = {x} AND q.j = {y} GROUP BY ALL)"""


_CENTRES = "SELECT p_partkey, 2 AS k, i + h / 2.0 AS a, j + h / 2.0 AS b, (i * 10 + j) * 2 + h AS o FROM c, range(2) r(h)"
_AXES = f"SELECT p_partkey, 0 AS k, h / 2.0 AS a, -1.0 AS b, h AS o FROM p, range(12) r(h) WHERE h < 2 * n UNION ALL SELECT p_partkey, 1, -1.0, h / 2.0, h FROM p, range(10) r(h) WHERE h < 2 * m UNION ALL {_CENTRES}"
_SHIFTS = "SELECT p_partkey, 0 AS k, d::INT AS a, 0 AS b, 2 * abs(d) + (d < 0)::INT AS o FROM p, range(-5, 6) r(d) WHERE d <> 0 AND abs(d) < n UNION ALL SELECT p_partkey, 1, 0, d::INT, 2 * abs(d) + (d < 0)::INT FROM p, range(-4, 5) r(d) WHERE d <> 0 AND abs(d) < m UNION ALL SELECT p_partkey, 2, i, j, (i + j) * 100 + i * 10 + j FROM c WHERE i > 0 AND j > 0"
_BEST = ", u AS (SELECT *, {} AS score FROM s), z AS (SELECT * FROM u WHERE score > 0 {})"


def _kernel(name: str, kind: str, f, sql: str, stacked: bool = False):
    @query(sql, name=name)
    def one(t):
        return K.over_rows(_objects(t), "g", "value", kind, f, stacked).select("p_partkey", F.to_json(F.struct("value")).alias("value"))


_kernel("grid_boundary", "array<array<boolean>>", K.boundary, _O + _OUTSIDE + _EDGE + _grid_of("f", "e"), True)
_kernel("grid_neighbors", "array<array<boolean>>", K.neighbors, _O + _OUTSIDE + _EDGE + ", y AS (SELECT e.p_partkey, e.i, e.j, e.v = 0 AND EXISTS (SELECT 1 FROM e q WHERE q.f AND q.p_partkey = e.p_partkey AND abs(e.i - q.i) + abs(e.j - q.j) = 1) AS f FROM e)" + _grid_of("f", "y"), True)
_kernel(
    "grid_flood_fill", "array<array<int>>", lambda g: K.flood_fill(g, 0, 0, 3),
    _O + ", w AS (WITH RECURSIVE z AS (SELECT p_partkey, i, j, v FROM c WHERE i = 0 AND j = 0 UNION SELECT c.p_partkey, c.i, c.j, c.v FROM z JOIN c ON c.p_partkey = z.p_partkey AND c.v = z.v AND abs(c.i - z.i) + abs(c.j - z.j) = 1) SELECT DISTINCT p_partkey, i, j FROM z), y AS (SELECT c.p_partkey, c.i, c.j, CASE WHEN w.i IS NULL THEN v ELSE 3 END f FROM c LEFT JOIN w USING (p_partkey, i, j))" + _grid_of("f", "y"), True,
)
_kernel("grid_draw_line", "array<array<int>>", lambda g: K.draw_lines(g, 0, 0, 4, direction=(1, 1)), _O + _grid_of("CASE WHEN i = j THEN 4 ELSE v END", "c"), True)
_kernel("grid_draw_line_to", "array<array<int>>", lambda g: K.draw_lines(g, 0, 2, 4, end=(2, 1), stop_at=(8,)), _O + ", l AS (SELECT p_partkey, coalesce(min(i) FILTER (v = 8 AND i + j = 2), 9) AS stop FROM c GROUP BY p_partkey), y AS (SELECT c.*, CASE WHEN i + j = 2 AND i < stop THEN 4 ELSE v END f FROM c JOIN l USING (p_partkey))" + _grid_of("f", "y"), True)
_kernel("grid_contact", "boolean", lambda g: K.contact(g, g, 1, 0), _O + " SELECT p.p_partkey, concat('{\"value\":', EXISTS (SELECT 1 FROM c a, c b WHERE a.p_partkey = p.p_partkey AND b.p_partkey = p.p_partkey AND a.v <> 0 AND b.v <> 0 AND abs(a.i - b.i - 1) + abs(a.j - b.j) <= 1), '}') AS value FROM p", True)
_kernel("grid_free_places", "array<array<int>>", lambda g: K.free_places(g, g[:, :2, :2]), _O + ", y AS (SELECT p_partkey, i, j FROM c WHERE i < n - 1 AND j < m - 1 AND NOT EXISTS (SELECT 1 FROM c q, c k WHERE q.p_partkey = c.p_partkey AND k.p_partkey = c.p_partkey AND q.i < 2 AND q.j < 2 AND q.v <> 0 AND k.i = c.i + q.i AND k.j = c.j + q.j AND k.v <> 0))" + _list_of("[s.i, s.j]", "y", "s.i, s.j"), True)
_kernel(
    "grid_mirror_symmetry", "array<array<double>>", lambda g: [[[-1.0 if v is None else v for v in a] for a in axes] for axes in Y.mirror_symmetries(g)],
    _O + _scored(_AXES, "CASE WHEN t.k = 1 THEN c.i ELSE 2 * t.a - c.i END", "CASE WHEN t.k = 0 THEN c.j ELSE 2 * t.b - c.j END") + _BEST.format("kept - 0.01::DOUBLE * off", "AND kept > 0 AND conflict = 0") + ", y AS (SELECT * FROM z QUALIFY score = max(score) OVER (PARTITION BY p_partkey))" + _list_of("[s.a::DOUBLE, s.b::DOUBLE]", "y", "s.k, s.o"), True,
)
_kernel(
    "grid_translational_symmetry", "array<array<int>>", Y.translational_symmetries,
    _O + _scored(_SHIFTS, "c.i + t.a", "c.j + t.b") + _BEST.format("kept - 0.01::DOUBLE * off - 1e5 * conflict", "") + ", y AS (SELECT * FROM z WHERE k < 2 OR p_partkey NOT IN (SELECT p_partkey FROM z WHERE k < 2) QUALIFY row_number() OVER (PARTITION BY p_partkey, k ORDER BY score DESC, o) = 1)" + _list_of("[s.a, s.b]", "y", "s.k"), True,
)
_kernel(
    "grid_rotational_symmetry", "array<double>", lambda g: [c or [] for c in Y.rotational_symmetry(g)],
    _O + _scored(_CENTRES, "t.a + (c.j - t.b)", "t.b - (c.i - t.a)") + _BEST.format("kept - 5 * off - 1000 * conflict", "") + ", y AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, o) = 1) SELECT p.p_partkey, concat('{\"value\":', to_json(CASE WHEN y.a IS NULL THEN []::DOUBLE[] ELSE [y.a::DOUBLE, y.b::DOUBLE] END), '}') AS value FROM p LEFT JOIN y USING (p_partkey)", True,
)
_kernel(
    "grid_detect_objects", "array<array<array<int>>>", lambda g: K.detect_objects(g, overlap=False),
    _O + _JOINED + ", o AS (SELECT p_partkey, l, (max(i) - min(i) + 1) * (max(j) - min(j) + 1) area, count(*) mass FROM w GROUP BY p_partkey, l), f AS (SELECT o.p_partkey, o.l, o.area, o.mass, c.i, list(CASE WHEN w.l = o.l THEN c.v ELSE 0 END ORDER BY c.j) r FROM o JOIN c USING (p_partkey) LEFT JOIN w ON w.p_partkey = c.p_partkey AND w.i = c.i AND w.j = c.j GROUP BY ALL), y AS (SELECT p_partkey, l, area, mass, list(r ORDER BY i) r FROM f GROUP BY ALL)" + _list_of("s.r", "y", "s.area DESC, s.mass DESC, s.l"),
)
_kernel("grid_contiguous", "boolean", K.is_contiguous, _O + _JOINED + " SELECT p.p_partkey, concat('{\"value\":', count(DISTINCT w.l) = 1, '}') AS value FROM p LEFT JOIN w USING (p_partkey) GROUP BY p.p_partkey", True)


def _md5_draw(what: str, key: str, n: str) -> str:
    """functions.grid.draw in SQL."""
    return f"(('0x' || substr(md5(concat('{what}-', {key})), 1, 7))::BIGINT % {n})"


def _permutation(key: str, first: int) -> str:
    """functions.grid.seeded_permutation in SQL, of colours first to 9, as a list of all ten."""
    drawn = f"list_transform(list_sort(list_transform(range({first}, 10), lambda c: {{'h': md5(concat({key}, '-', c)), 'c': c}})), lambda s: s.c)"
    return drawn if first == 0 else f"list_concat([0], {drawn})"


def _moved(columns: str, rows: str, quarters: str, colors: str) -> str:
    """SQL: grid g, n x m, with columns and rows reversed, turned by quarters, scaled by k and recoloured."""
    turns = [("i // k", "j // k"), ("n - 1 - j // k", "i // k"), ("n - 1 - i // k", "m - 1 - j // k"), ("j // k", "m - 1 - i // k")]
    x = f"CASE {quarters} WHEN 0 THEN {turns[0][0]} WHEN 1 THEN {turns[1][0]} WHEN 2 THEN {turns[2][0]} ELSE {turns[3][0]} END"
    y = f"CASE {quarters} WHEN 0 THEN {turns[0][1]} WHEN 1 THEN {turns[1][1]} WHEN 2 THEN {turns[2][1]} ELSE {turns[3][1]} END"
    x, y = f"CASE WHEN {rows} THEN n - 1 - ({x}) ELSE {x} END", f"CASE WHEN {columns} THEN m - 1 - ({y}) ELSE {y} END"
    cell = f"g[({x}) + 1][({y}) + 1]"
    sides = [f"(CASE WHEN ({quarters}) % 2 = 0 THEN {a} ELSE {b} END) * k" for a, b in (("n", "m"), ("m", "n"))]
    return f"list_transform(range({sides[0]}), lambda i: list_transform(range({sides[1]}), lambda j: (CASE WHEN {colors} IS NULL THEN {cell} ELSE {colors}[{cell} + 1] END)::INT))"


def _tasks_sql() -> str:
    chance = lambda what: f"{_md5_draw(what, 'key', '1000')} < 500"
    of = {"": ("cs", "rs", "q"), "other": ("NOT cs", "NOT rs", "(q + 1) % 4")}
    pair = lambda source, kind: "{'input': " + _moved(*_flipped(source[0], *of[kind]), "colors") + ", 'output': " + _moved(*_flipped(source[1], *of[kind]), "colors") + "}"
    first, second = ("", "rows"), ("columns", "")
    return BASE + f""", r AS (SELECT p.*, round, concat(p_partkey, '-', round) AS key, greatest(n, m) AS side FROM p, range(2) x(round)),
t AS (SELECT *, {chance('columns')} AS cs, {chance('rows')} AS rs, CASE WHEN {chance('turn')} THEN {_md5_draw('quarters', 'key', '3')} + 1 ELSE 0 END AS q, CASE WHEN {chance('scale')} THEN {_md5_draw('k', 'key', '(30 // side)')} + 1 ELSE 1 END AS k,
CASE WHEN {_md5_draw('colors', 'key', '10')} < 5 THEN {_permutation('key', 1)} WHEN {_md5_draw('colors', 'key', '10')} = 5 THEN {_permutation('key', 0)} END AS colors FROM r)
SELECT p_partkey, round::INT AS round, to_json([{pair(first, '')}, {pair(second, '')}, CASE WHEN md5(concat(key, '-0')) < md5(concat(key, '-1')) THEN {pair(first, 'other')} ELSE {pair(second, 'other')} END])::VARCHAR AS train, to_json([{pair(first, '')}])::VARCHAR AS test FROM t"""


def _flipped(source: str, columns: str, rows: str, quarters: str) -> tuple[str, str, str]:
    return (f"NOT ({columns})" if source == "columns" else columns, f"NOT ({rows})" if source == "rows" else rows, quarters)


@query(_tasks_sql())
def augment_tasks(t):
    """Two rounds of each task of two pairs, the grids themselves: three train pairs each, the third under the complementary transform."""
    from ..operators.problems import augmented_tasks

    pair = lambda a, b: F.struct(a.alias("input"), b.alias("output"))
    g = F.col("g")
    pairs = F.array(pair(g, G.flip_rows(g)), pair(G.flip_columns(g), g))
    tasks = derived(dealt(t("part").select("p_partkey", "p_size"))).select(F.col("p_partkey").alias("uid"), pairs.alias("train"), pairs.alias("test"))
    return augmented_tasks(tasks, 2).select(F.col("uid").alias("p_partkey"), "round", F.to_json("train").alias("train"), F.to_json("test").alias("test"))


@query(BASE + "SELECT p_partkey, (p_size + 3 * (p_partkey % 3 - 1))::INT AS x, (1 - 2 * (p_partkey % 3 - 1))::INT AS y FROM p JOIN part USING (p_partkey)")
def translated_points(t):
    q = G.translate_point(F.col("p_size"), F.lit(1), F.lit(3), F.lit(-2), F.col("p_partkey") % 3 - 1)
    return t("part").select("p_partkey", q.alias("q")).select("p_partkey", F.col("q.x").cast("int").alias("x"), F.col("q.y").cast("int").alias("y"))


_TOSS = lambda what: f"{_md5_draw(what, 'p_partkey', '2')} = 0"
_AUGMENTED = BASE + f""", t AS (SELECT *, CASE WHEN {_md5_draw('color', 'p_partkey', '10')} < 5 THEN {_permutation('p_partkey', 1)} WHEN {_md5_draw('color', 'p_partkey', '10')} = 5 THEN {_permutation('p_partkey', 0)} END AS colors,
{_TOSS('columns')} AS cs, {_TOSS('rows')} AS rs, ({_TOSS('turn')})::INT AS q, CASE WHEN {_TOSS('scale')} THEN least(30 // greatest(n, m), {_md5_draw('k', 'p_partkey', '3')} + 1) ELSE 1 END AS k FROM p)
SELECT p_partkey, to_json({_moved('cs', 'rs', 'q', 'colors')})::VARCHAR AS grid FROM t"""


@query(_AUGMENTED)
def augment_policy(t):
    return derived(t("part")).select("p_partkey", F.to_json(G.augment(F.col("g"), F.col("p_partkey"))).alias("grid"))


@query(_LONG + ", b AS (SELECT p_partkey, min(i) x, max(i) x2, min(j) y, max(j) y2 FROM c WHERE v >= 7 GROUP BY p_partkey), y AS (SELECT c.p_partkey, c.i, c.j, coalesce(c.i BETWEEN x AND x2 AND c.j BETWEEN y AND y2, false) f FROM c LEFT JOIN b USING (p_partkey))" + _grid_of("f", "y"))
def grid_bbox_mask(t):
    return _objects(lambda name: dealt(t(name).select("p_partkey", "p_size"))).select("p_partkey", F.to_json(F.struct(G.bounding_box_mask(F.col("g")).alias("value"))).alias("value"))


@query("SELECT p_partkey, [5, 5, NULL, 0][1 + p_size % 4]::INT AS cell FROM part")
def grid_from_names(t):
    name = F.get(F.array(*[F.lit(n) for n in ("Grey", "gray", "Teal", "BLACK")]), (F.col("p_size") % 4).cast("int"))
    return t("part").select("p_partkey", G.at(G.from_text(name), 0, 0).alias("cell"))


@query(BASE + "SELECT count(DISTINCT g) AS distinct_grids, count(*) - count(DISTINCT g) AS rejected FROM p")
def grid_dedup(t):
    from ..operators.corpus import dedup_counts

    return dedup_counts(derived(t("part")), F.to_json("g")).select(F.col("distinct_rows").alias("distinct_grids"), "rejected")


@query(BASE + "SELECT p_partkey, md5('Example 1' || chr(10) || 'Input:' || chr(10) || x || chr(10) || chr(10) || 'Output:' || chr(10) || x || chr(10) || chr(10) || 'Here is the input grid for the test example:' || chr(10) || 'Input:' || chr(10) || x) AS digest FROM (SELECT p_partkey, array_to_string(list_transform(range(n), lambda i: array_to_string(list_transform(range(m), lambda j: ['Black','Blue','Red','Green','Yellow','Gray','Pink','Orange','Purple','Brown'][g[i+1][j+1]+1]), ' ')), chr(10)) x FROM p)")
def problem_prompt(t):
    pair = F.struct(F.col("g").alias("input"), F.col("g").alias("output"))
    return derived(t("part")).select("p_partkey", F.md5(X.problem_prompt(F.array(pair), pair)).alias("digest"))


def _fifth(x: str) -> str:
    return f"list_transform([{x}], lambda x: ((x * x % {R.PRIME}) * (x * x % {R.PRIME}) % {R.PRIME}) * x % {R.PRIME})[1]"


def _draw(key: str, step: str) -> str:
    """random_grids.draws in SQL."""
    first = _fifth(f"({key} % {R.PRIME} * 48271 + {step} * 69621 + {key} // {R.PRIME} + 1) % {R.PRIME}")
    return _fifth(f"({first} * 16807 + {key} % {R.PRIME} + {step} * 7919) % {R.PRIME}")


def _grown(name: str, kind: str, f, sql: str):
    @query(sql, name=name)
    def one(t):
        return K.over_rows(_objects(t), "g", "value", kind, f, True, "p_partkey").select("p_partkey", F.to_json(F.struct("value")).alias("value"))


_grown(
    "grid_scatter", "array<array<int>>", lambda g, keys: R.scatter(g, keys, 5, 0.3),
    _O + f", r AS (SELECT c.*, n * m AS size, row_number() OVER (PARTITION BY c.p_partkey, v = 0 ORDER BY {_draw('c.p_partkey', '(i * m + j)')}, i, j) AS k FROM c), y AS (SELECT *, CASE WHEN v = 0 AND k <= ceil(0.3 * size) THEN 5 ELSE v END AS f FROM r)" + _grid_of("f", "y"),
)
_grown(
    "grid_spaced_indices", "array<int>", lambda g, keys: R.spaced_indices(keys, 20, 4, 1, 2).tolist(),
    f"WITH r AS (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY {_draw('p_partkey', 'k')}, k) AS o FROM part, range(11) x(k)), y AS (SELECT p_partkey, k + (row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1) * 2 + 1 AS v FROM r WHERE o <= 4) SELECT p_partkey, concat('{{\"value\":', to_json(list(v::INT ORDER BY v)), '}}') AS value FROM y GROUP BY p_partkey",
)
_kernel("grid_apply_symmetry", "array<array<int>>", lambda g: K.apply_symmetry(g, "mirror"), _O + ", y AS (SELECT c.p_partkey, c.i, c.j, CASE WHEN c.v <> 0 THEN c.v WHEN a.v <> 0 THEN a.v WHEN b.v <> 0 THEN b.v ELSE d.v END AS f FROM c JOIN c a ON a.p_partkey = c.p_partkey AND a.i = c.n - 1 - c.i AND a.j = c.j JOIN c b ON b.p_partkey = c.p_partkey AND b.i = c.i AND b.j = c.m - 1 - c.j JOIN c d ON d.p_partkey = c.p_partkey AND d.i = c.n - 1 - c.i AND d.j = c.m - 1 - c.j)" + _grid_of("f", "y"), True)
_kernel(
    "grid_orbit", "array<array<int>>", lambda g: [K.orbit(g, 0, 1, [(lambda x, y, k: (g.shape[1] - 1 - x if k else x, y), range(2)), (lambda x, y, k: (x, y + 2 * k), range(-1, 2))])] * len(g),
    _O + ", y AS (SELECT DISTINCT p_partkey, a AS i, 1 + 2 * k AS j FROM p, range(-1, 2) s(k), (VALUES (0), (1)) z(b), LATERAL (SELECT CASE WHEN b = 1 THEN n - 1 ELSE 0 END AS a) WHERE 1 + 2 * k >= 0 AND 1 + 2 * k < m) SELECT p_partkey, concat('{\"value\":', to_json(list([i, j]::INT[] ORDER BY i, j)), '}') AS value FROM y GROUP BY p_partkey", True,
)


@query("""WITH b AS (SELECT p_partkey, p_size % 5 AS x1, p_partkey % 4 AS y1, 2 AS w1, 4 AS h1, 4 + p_size % 3 AS x2, 1 + p_partkey % 3 AS y2, 3 AS w2, 5 AS h2 FROM part),
q AS (SELECT *, x1 + w1 <= x AND x < x2 OR x2 + w2 <= x AND x < x1 AS along_x, y - 1 >= greatest(y1, y2) AND y + 1 < least(y1 + h1, y2 + h2) AS across_x, y1 + h1 <= y AND y < y2 OR y2 + h2 <= y AND y < y1 AS along_y, x - 1 >= greatest(x1, x2) AND x + 1 < least(x1 + w1, x2 + w2) AS across_y FROM b, range(12) r(x), range(12) s(y))
SELECT p_partkey, x::INT AS x, y::INT AS y FROM q WHERE along_x AND across_x OR along_y AND across_y""")
def grid_between(t):
    """Cells between two boxes, with padding."""
    box = lambda x, y, w, h: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    size, key = F.col("p_size"), F.col("p_partkey")
    boxes = t("part").select("p_partkey", box(size % 5, key % 4, 2, 4).alias("a"), box(4 + size % 3, 1 + key % 3, 3, 5).alias("b"))
    cells = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("y"))
    return cells.filter(G.between_boxes(F.col("a"), F.col("b"), F.col("x"), F.col("y"), 1)).select("p_partkey", "x", "y")


@query()
def grid_sprites(t):
    """A sprite of every part's own size, and what it promises, by the library's own functions; no SQL draws it."""
    made = K.over_rows(derived(t("part")), "g", "sprite", "array<array<int>>", lambda g, keys: R.sprites(keys, *g.shape[1:]), True, "p_partkey")
    made = K.over_rows(made, "sprite", "one", "boolean", K.is_contiguous, True)
    return made.select("p_partkey", F.to_json("sprite").alias("sprite"), "one", (G.height(F.col("sprite")) == G.height(F.col("g"))).alias("size"))
