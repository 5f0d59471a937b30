from pyspark.sql import functions as F

from gridloom.functions import code as C
from gridloom.functions import text as X

SEED = '''from common import *

# concepts:
# symmetry, color guide ,
# sprites

# description:
# Mirror the sprite.
# Then paint it.

def main(g):
    """doc of main"""
    return bar(foo(g))

def foo(x): return x
# ============= remove below this point for prompting =============
def generate_input():
    pass
'''


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_seed_parsing(spark):
    assert one(spark, X.concepts, SEED) == ["symmetry", "color guide", "sprites"]
    assert one(spark, X.concepts, "# concepts: a, b\n# description: d") == ["a", "b"]
    assert one(spark, X.description, SEED) == "Mirror the sprite. Then paint it."
    blocks = one(spark, X.concept_blocks, "# concepts:\n# a\n# description:\n# one\n\n# concepts:\n# b\n# description:\n# two\n")
    assert [(b.concepts, b.description) for b in blocks] == [(["a"], "one"), (["b"], "two")]
    bare = one(spark, X.without_blocks, SEED)
    assert "concepts" not in bare and "Mirror" not in bare and "def main" in bare
    assert one(spark, lambda t: X.before_marker(t, "# ============= remove below"), SEED).endswith("def foo(x): return x")
    assert one(spark, lambda t: X.inject_constants(t, "A = 1\n"), SEED).startswith("from common import *\nA = 1\n")


def test_fences(spark):
    assert one(spark, X.fenced_blocks, "a\n```python\nx = 1\n```\n```python\ny\n```\n```\nz\n```") == ["x = 1", "y"]
    assert one(spark, X.fenced_blocks, "```\nz\n```") == ["z"] and one(spark, X.fenced_blocks, "none") == []
    for raw in ('{"k": 1}', '```json\n{"k": 1}\n```', "'{\"k\": 1}'"):
        assert one(spark, lambda t: X.parse_json(t, "k int"), raw).k == 1
    assert one(spark, lambda t: X.parse_json(t, "k string"), '{"k": "a\\d"}').k == "a\\d"
    assert one(spark, lambda t: X.parse_json(t, "k int"), "broken {") is None


def test_white_space(spark):
    assert one(spark, X.squeeze, "  a b\r\n c ") == "a b c"
    assert one(spark, X.strip, "\n\t a b \n") == "a b"
    assert one(spark, X.word_count, "  ") == 0 and one(spark, X.word_count, None) == 0


def test_colors(spark):
    assert one(spark, lambda t: X.rename_color(t, "teal", "purple"), "teal, Teal, TEAL stealing end teal") == "purple, Purple, PURPLE stealing end purple"
    assert one(spark, lambda t: X.rename_colors(t, {"red": "blue", "blue": "red"}), "red Blue redder") == "blue Red redder"
    assert one(spark, lambda t: X.rename_colors(t, {"red": "blue", "blue": "red"}, False), "red Blue") == "red Red"
    assert one(spark, X.unknown_colors, "Color.RED Color.CYAN Color.GRAY") == ["CYAN"]
    fixed = one(spark, X.repair_colors, "Color.RED Color.CYAN")
    assert fixed.startswith("Color.RED Color.") and "CYAN" not in fixed


def test_small_functions(spark):
    assert one(spark, X.docstring, 'def f():\n  """ what it does """\n  pass') == "what it does"
    assert one(spark, X.docstring, "no") is None
    assert one(spark, X.hash_offset, "1") == 206349347
    assert one(spark, X.seed_uid, "25d487eb_Kevin.py") == "25d487eb" and one(spark, X.seed_uid, "common.py") is None
    assert one(spark, X.file_stem, "/a/b.c/d.e.gif") == "d.e"
    assert one(spark, lambda t: X.judge_score(t), '{"answer": "3"}') == 3.0
    assert one(spark, lambda t: X.fill("{a}-{b}", a=t, b=F.lit("y")), "x") == "x-y"
    assert one(spark, X.html_text, "<p>a<script>no</script> <b>c</b></p>") == "a c"


def test_syntax():
    found = {f["name"]: f for f in C.functions(SEED)}
    assert set(found) == {"main", "foo", "generate_input"} and found["main"]["docstring"] == "doc of main"
    assert found["main"]["stub"].startswith("def main(g):") and "bar" not in found["main"]["stub"]
    assert C.calls(SEED) == ["bar", "foo"] and C.functions("def broken(") == [] and C.literal("[1, 'a']") == [1, "a"] and C.literal("f()") is None


def test_library(spark):
    programs = C.with_syntax(spark.createDataFrame([(SEED,), ("foo(1)",)], "content string"))
    library = spark.createDataFrame([("foo", "does foo"), ("bar", "internal helper"), ("other", "")], "name string, docstring string")
    assert [r.name for r in C.pruned_library(library, programs).collect()] == ["foo"]
    assert {r.name: r.programs for r in C.usage_histogram(library, programs).collect()} == {"foo": 2, "bar": 1, "other": 0}
