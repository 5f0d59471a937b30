"""Prompts that ask for a new puzzle, made of seed programs and the library they call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import before_marker, concepts, fill, strip

#: Fixed value: what stands below this line of a seed is not shown.
CUT = "# ============= remove below this point for prompting ============="
#: Fixed value: a concept that is left out, as it is easily misread.
MISREAD = "color change"

CREATIVE = """Design one puzzle: a rule that maps a coloured grid to a coloured grid. Write Python with a random `generate_input` and a deterministic `main`. You can use this library:

```python
{library}
```

Puzzles to start from:

{examples}

Make a new puzzle like these, {remix}in these steps:
1. Choose concepts of the puzzles above{reminder}. They are:
   {concepts}
{steps}
No rule may depend on an order of the colours."""
TEMPLATED = """Make one puzzle that closely follows a given one: a rule that maps a coloured grid to a coloured grid. Write Python with a random `generate_input` and a deterministic `main`. Use this library as far as you can:

```python
{library}
```

Puzzles to follow:

{examples}

Make a puzzle after these, {remix}in these steps:
1. Choose concepts of the puzzles above{reminder}. They are:
   {concepts}
{steps}
No rule may depend on an order of the colours. Invent as little as you can."""
STEPS = {
    True: "2. Write down 20 concepts like the chosen ones.\n3. Pick one of them and think of a puzzle with it.\n4. Write the code, with comments `# concepts:` and `# description:` first.",
    False: "2. Think of a puzzle with the chosen concepts.\n3. Write the code, with comments `# concepts:` and `# description:` first.",
}


def drawn(items: Column, seed: Column) -> Column:
    """The items in an order that the seed decides."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(F.md5(F.concat_ws("-", seed.cast("string"), x)).alias("h"), x.alias("x")))), lambda s: s["x"])


def clean_concepts(items: Column, whole: bool = False) -> Column:
    """Distinct concepts in order, without the misread one: as a whole, or wherever it is part of a concept."""
    keep = (lambda c: c != MISREAD) if whole else (lambda c: ~F.contains(c, F.lit(MISREAD)))
    return F.array_sort(F.array_distinct(F.filter(items, keep)))


def description_and_code(t: Column) -> Column:
    """STRUCT<description, code>: the comment lines from `# description:` on, and the rest without the function generate_input, which goes up to the next line that starts a definition."""
    block = r"(?m)^#\s*description:[^\n]*(?:\n#[^\n]*)*"
    rest = F.regexp_replace(t, block, "")
    code = F.regexp_replace(rest, r"(?ms)^def\s+generate_input\s*\(.*?(?=^def\s|\z)", "")
    return F.struct(strip(F.regexp_extract(t, f"({block})", 1)).alias("description"), strip(code).alias("code"))


def direct_prompt(
    seeds: Column, library: Column, names: Column, seed: Column, number: int | None = None, remix: int = 0, hint: int = -1,
    creative: bool = True, brainstorm: bool = True, largest: int = 0, template: str | None = None,
) -> Column:
    """STRUCT<prompt, seed_ids>.

    seeds: ARRAY<STRUCT<seed_id, content>>, drawn in an order that `seed` decides, the first
    `number`; library: the text of the library; names: ARRAY<STRING> of its functions.
    remix: how many of the last examples to vary (0: none named). hint: -1 none, 0 the
    library, n > 0 also n of its functions. creative=False: after the last example, which
    needs remix = 1. largest: a bound on the grids' sides, where it is not 0.
    """
    if not creative and remix != 1:
        raise ValueError("following one example closely needs remix = 1")
    ids = drawn(F.transform(seeds, lambda s: s["seed_id"]), seed)
    ids = ids if number is None else F.slice(ids, 1, number)
    content = lambda i: before_marker(F.get(F.filter(seeds, lambda s: s["seed_id"] == i), 0)["content"], CUT)
    shown = F.transform(ids, content)
    last = F.size(shown) - 1
    head = lambda k: F.when((k == last) & F.lit(not creative), "Example puzzle (the last one, your template):").otherwise("Example puzzle:")
    examples = F.array_join(F.transform(shown, lambda c, k: F.concat(head(k), F.lit("\n```python\n"), c, F.lit("\n```"))), "\n\n")
    listed = drawn(clean_concepts(F.flatten(F.transform(shown, concepts)), whole=True), seed)
    kind = "variation" if creative else "close copy"
    which = "" if remix == 0 else "the last example" if remix == 1 else f"the last {remix} examples"
    prompt = fill(
        template or (CREATIVE if creative else TEMPLATED), library=library, examples=examples, concepts=F.array_join(listed, ", "), steps=F.lit(STEPS[brainstorm if creative else False]),
        remix=F.lit(f"as a {kind} of {which}, " if remix else ""), reminder=F.lit(f", for a {kind} of {which}" if remix else ""),
    )
    if largest:
        prompt = F.concat(prompt, F.lit(f"\nGrids should be large enough for interesting patterns, but under {largest} wide and high."))
    if hint >= 0:
        some = F.array_join(F.slice(drawn(names, seed), 1, max(hint, 1)), ", ")
        more = F.concat(F.lit(" In particular use: "), some, F.lit(".")) if hint else F.lit("")
        prompt = F.concat(prompt, F.lit("\nUse the functions of the library."), more)
    return F.struct(prompt.alias("prompt"), ids.alias("seed_ids"))
