"""Text functions: parsing of model answers and programs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import COLORS, MODEL_COLORS
from .grid import from_text, let, to_text


def squeeze(t: Column) -> Column:
    """White space runs, Unicode's too, become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"\A | \z", "")


def normalized(t: Column) -> Column:
    return squeeze(F.lower(t))


def one_line_base64(b: Column) -> Column:
    """Base64 without the line breaks that Spark puts after every 76 characters."""
    return F.translate(F.base64(b), "\r\n", "")


def strip(t: Column) -> Column:
    """Without white space at the ends, new lines too."""
    return F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")


def word_count(t: Column) -> Column:
    """A stand-in for a token count that needs no vocabulary."""
    s = squeeze(F.coalesce(t, F.lit("")))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def before_marker(t: Column, *markers: str) -> Column:
    for m in markers:
        t = F.substring_index(t, m, 1)
    return strip(t)


def fenced_blocks(t: Column, language: str = "python") -> Column:
    """Contents of all fences of the language, else of any fence."""
    tagged = F.regexp_extract_all(t, F.lit(rf"(?s)```{language}(.*?)```"), F.lit(1))
    anyone = F.regexp_extract_all(t, F.lit(r"(?s)```[A-Za-z]*(.*?)```"), F.lit(1))
    return F.transform(F.when(F.size(tagged) > 0, tagged).otherwise(anyone), strip)


def without_fence(t: Column) -> Column:
    return strip(F.regexp_replace(strip(t), r"\A```(?:json)?|```\z", ""))


def parse_json(t: Column, schema: str) -> Column:
    """from_json of the raw text, else without its fence, else with lone backslashes doubled, else without outer quotes; else null."""
    options = {"mode": "PERMISSIVE"}
    bare = without_fence(t)
    tries = [t, bare, F.regexp_replace(bare, r'\\(?!["\\/bfnrtu])', r"\\\\"), F.regexp_replace(bare, r"\A['\"]|['\"]\z", "")]
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema, options))
    return F.coalesce(*[ok(x) for x in tries])


def section(t: Column, heading: str, following: str | None = None) -> Column:
    """What stands between a heading and the next one (or the end)."""
    stop = rf"(?={following})" if following else r"\z"
    return strip(F.regexp_extract(t, rf"(?is){heading}\s*:?(.*?){stop}", 1))


def concepts(t: Column) -> Column:
    """The list after `# concepts:`, on that line or on the comment lines that follow, up to `# description`."""
    block = F.regexp_extract(t, r"(?is)#\s*concepts\s*:([^\n]*(?:\n#(?!\s*description)[^\n]*)*)", 1)
    items = F.split(F.regexp_replace(block, r"\n#", ","), ",")
    return F.filter(F.transform(items, strip), lambda x: x != "")


def description(t: Column) -> Column:
    """The comment lines after `# description:`, joined by spaces."""
    block = F.regexp_extract(t, r"(?is)#\s*description\s*:([^\n]*(?:\n#[^\n]*)*)", 1)
    return squeeze(F.regexp_replace(block, r"\n#", " "))


def concept_blocks(t: Column) -> Column:
    """ARRAY<STRUCT<concepts, description>>: every line with `# concepts` starts a block."""
    starts = F.filter(F.split(t, r"(?=(?m:^\s*# concepts))"), lambda b: F.lower(b).contains("# concepts"))
    return F.transform(starts, lambda b: F.struct(concepts(b).alias("concepts"), description(b).alias("description")))


def without_blocks(t: Column) -> Column:
    """The program without its concept and description comments."""
    return strip(F.regexp_replace(t, r"(?im)^#\s*(?:concepts|description)\s*:[^\n]*(?:\n#[^\n]*)*\n?", ""))


def docstring(t: Column) -> Column:
    """What stands between triple quotes, where there are two marks or four; else null."""
    parts = F.split(t, '"""')
    return F.when(F.size(parts).isin(3, 5), strip(F.get(parts, 1)))


def rename_entry(t: Column) -> Column:
    return F.replace(t, F.lit("def main("), F.lit("def transform("))


def rename_color(t: Column, old: str, new: str) -> Column:
    """One colour's name replaced where no letter touches it, in upper, capital and lower case."""
    for f in (str.upper, str.capitalize, str.lower):
        t = F.regexp_replace(t, rf"(?<![a-zA-Z]){f(old)}(?![a-zA-Z])", f(new))
    return t


def rename_colors(t: Column, mapping: dict[str, str], at_once: bool = True) -> Column:
    """All names replaced: at once (a name that was put in is not replaced again), or one after the other."""
    marks = {o: f"\u0001{k}\u0002" for k, o in enumerate(mapping)}
    if not at_once:
        for o, n in mapping.items():
            t = rename_color(t, o, n)
        return t
    for o, m in marks.items():
        for k, f in enumerate((str.upper, str.capitalize, str.lower)):
            t = F.regexp_replace(t, rf"(?<![a-zA-Z]){f(o)}(?![a-zA-Z])", m + "ucl"[k] + "\u0003")
    for o, m in marks.items():
        for k, f in enumerate((str.upper, str.capitalize, str.lower)):
            t = F.replace(t, F.lit(m + "ucl"[k] + "\u0003"), F.lit(f(mapping[o])))
    return t


def unknown_colors(t: Column) -> Column:
    """Names after `Color.` that no colour has."""
    known = [*COLORS, "GRAY", "TRANSPARENT", "BACKGROUND", "ALL_COLORS", "NOT_BLACK"]
    return F.array_except(F.regexp_extract_all(t, F.lit(r"Color\.([A-Za-z_]+)"), F.lit(1)), F.array(*[F.lit(k) for k in known]))


def repair_colors(t: Column) -> Column:
    """Every unknown colour becomes a known one, chosen by hash of its name."""
    pick = lambda name: F.get(F.array(*[F.lit(c) for c in COLORS]), F.pmod(F.xxhash64(name), F.lit(len(COLORS))).cast("int"))
    return F.aggregate(unknown_colors(t), t, lambda a, name: F.regexp_replace(a, F.concat(F.lit(r"Color\."), name, F.lit(r"(?![A-Za-z_])")), F.concat(F.lit("Color."), pick(name))))


def inject_constants(t: Column, constants: str) -> Column:
    """Lines put after the last import line."""
    head = F.regexp_extract(t, r"(?s)\A(.*(?:^|\n)(?:import|from) [^\n]*\n)", 1)
    return F.concat(head, F.lit(constants), F.substring(t, F.length(head) + 1, F.length(t)))


def fill(template: Column | str, **values: Column) -> Column:
    """{key} replaced by values."""
    t = F.lit(template) if isinstance(template, str) else template
    for k, v in values.items():
        t = F.replace(t, F.lit("{" + k + "}"), v)
    return t


def problem_prompt(train: Column, test: Column, names: list[str] | None = None) -> Column:
    """Numbered examples and then the test input."""
    one = lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\nInput:\n"), to_text(e["input"], names), F.lit("\n\nOutput:\n"), to_text(e["output"], names), F.lit("\n\n"))
    return F.concat(F.array_join(F.transform(train, one), ""), F.lit("Here is the input grid for the test example:\nInput:\n"), to_text(test["input"], names))


def prompt_pairs(t: Column) -> Column:
    """STRUCT<train: ARRAY<STRUCT<input, output>>, test>: the grids of a prompt, headings in turn; the last input has no output."""
    grids = F.filter(F.transform(prompt_grids(t), lambda g: from_text(g, strict=False)), lambda g: F.size(g) > 0)

    def paired(grids: Column) -> Column:
        pairs = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(grids) - 2, F.lit(0))), lambda k: (k % 2 == 0) & (k + 1 < F.size(grids))), lambda k: F.struct(F.get(grids, k).alias("input"), F.get(grids, k + 1).alias("output")))
        return F.struct(pairs.alias("train"), F.when(F.size(grids) % 2 == 1, F.get(grids, F.size(grids) - 1)).alias("test"))

    return let(grids, paired)


def prompt_grids(t: Column) -> Column:
    """The grid texts of a prompt, in order."""
    parts = let(F.split(t, r"(?:Input|Output):\s*\n"), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    grids = F.transform(parts, lambda p: strip(F.get(F.split(p, r"\n\s*\n"), 0)))
    return F.filter(grids, lambda g: g != "")


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("-", *parts))


def problem_uid(code: Column, examples: Column) -> Column:
    return F.concat(F.substring(F.md5(code), 1, 8), F.substring(F.md5(F.to_json(F.slice(examples, 1, 4))), 1, 8))


def hash_offset(t: Column) -> Column:
    """The first seven hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("long")


def seed_uid(name: Column) -> Column:
    """Eight hex digits of a seed file's name; null for another name."""
    uid = F.regexp_extract(name, r"\A([0-9a-f]{8})(?:_[a-zA-Z]+)?\.py\z", 1)
    return F.when(uid != "", uid)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?\z", 1)


def bracket_uid(name: Column) -> Column:
    """What stands in the first square brackets; none: null."""
    uid = F.regexp_extract(name, r"\[([^\]]+)\]", 1)
    return F.when(uid != "", uid)


def utc_text(ts: Column, default: Column | None = None) -> Column:
    """A time of the session's zone (UTC) in ISO form to the second; text stays as it is; null: the default, or the time of the query."""
    text = F.date_format(F.coalesce(ts.try_cast("timestamp"), F.lit(None).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = ts.cast("string")
    iso = F.coalesce(F.regexp_like(given, F.lit(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z")), F.lit(False))
    return F.coalesce(F.when(iso, given).otherwise(text), given, default if default is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def missing_as_null(t: Column) -> Column:
    return F.nullif(t, F.lit(""))


def judge_score(response: Column, correct: Column | None = None) -> Column:
    """The `answer` of a judge's JSON as a number, or whether it names the correct option (from 0)."""
    answer = F.get_json_object(without_fence(response), "$.answer").try_cast("double")
    return answer if correct is None else F.coalesce(answer == correct + 1, F.lit(False))


def html_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles or tags."""
    return squeeze(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " "))


def grid_html(g: Column) -> Column:
    """A grid as an HTML table of coloured cells."""
    cell = lambda c: F.concat(F.lit('<td class="'), F.lower(F.get(F.array(*[F.lit(n) for n in MODEL_COLORS]), c)), F.lit('"></td>'))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(g, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), ""), F.lit("</table>"))


def problem_html(uid: Column, examples: Column, media: Column | None = None) -> Column:
    """A section of a report: an anchor, the media (base64 of a picture, or null) and a row of two grids for each example."""
    rows = F.array_join(F.transform(examples, lambda e: F.concat(F.lit("<tr><td>"), grid_html(e["input"]), F.lit("</td><td>"), grid_html(e["output"]), F.lit("</td></tr>"))), "")
    picture = F.lit("") if media is None else F.coalesce(F.concat(F.lit('<img src="data:image/gif;base64,'), media, F.lit('">')), F.lit(""))
    return F.concat(F.lit('<section id="'), uid, F.lit('"><h2><a href="#'), uid, F.lit('">'), uid, F.lit("</a></h2>"), picture, F.lit("<table>"), rows, F.lit("</table></section>"))


#: The colours of cells 0 to 9 on a terminal that knows 256.
ANSI = [16, 21, 196, 34, 226, 244, 201, 208, 37, 88]


def grid_ansi(g: Column) -> Column:
    """A grid as coloured blanks for a terminal."""
    cell = lambda c: F.concat(F.lit("\x1b[48;5;"), F.get(F.array(*[F.lit(str(a)) for a in ANSI]), c), F.lit("m  "))
    return F.array_join(F.transform(g, lambda r: F.concat(F.array_join(F.transform(r, cell), ""), F.lit("\x1b[0m"))), "\n")
