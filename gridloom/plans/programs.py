"""Programs made of part rows: their syntax, their prompts, and running them in the sandbox. The programs are this module's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import code, tokens
from ..functions import text as X
from ..operators import chat, corpus, dataset, models, prompts, sandbox
from ..operators import problems as P
from ..session import dealt
from .grids import BASE, derived
from .registry import query


def _programs(t):
    """A function of the part's own, a class, and calls that differ by size."""
    call = F.when(F.col("p_size") % 3 == 0, "blit").when(F.col("p_size") % 3 == 1, "crop").otherwise("detect_mirror_symmetry")
    source = F.concat(F.lit('import numpy\n\nclass Thing:\n    """a thing"""\n    x = 1\n\ndef f'), F.col("p_partkey").cast("string"), F.lit('(g, k=2):\n    """docs of '), F.col("p_name"), F.lit('"""\n    return '), call, F.lit("(g.copy(), k)\n"))
    return t("part").select("p_partkey", source.alias("content"))


@query("SELECT p_partkey, concat('Thing,f', p_partkey) AS names, p_name AS doc, concat('def f', p_partkey, '(g, k=2):', chr(10), '    \"\"\"docs of ', p_name, '\"\"\"', chr(10), '    pass') AS stub, concat([ 'blit,copy', 'copy,crop', 'copy,detect_mirror_symmetry'][1 + p_size % 3]) AS calls FROM part")
def syntax_tree(t):
    out = code.with_syntax(_programs(t))
    f = F.get("functions", 1)
    return out.select("p_partkey", F.array_join(F.transform("functions", lambda x: x["name"]), ",").alias("names"), F.substring(f["docstring"], F.lit(9), F.length(f["docstring"])).alias("doc"), f["stub"].alias("stub"), F.array_join("calls", ",").alias("calls"))


_LIBRARY = [("blit", "lays", "function"), ("crop", "internal function", "function"), ("scale", "grows", "function"), ("detect_mirror_symmetry", "finds", "function"), ("Color", "colours", "class"), ("Symmetry", "maps", "class"), ("MirrorSymmetry", "mirror", "class")]


@query("SELECT name FROM (VALUES ('blit', 0), ('detect_mirror_symmetry', 2), ('Color', -1), ('Symmetry', 2)) v(name, k) WHERE k = -1 OR k IN (SELECT p_size % 3 FROM part)")
def library_pruning(t):
    p = code.with_syntax(_programs(t))
    return code.pruned_library(p.sparkSession.createDataFrame(_LIBRARY, "name string, docstring string, kind string"), p).select("name")


@query("SELECT name, (SELECT count(*) FROM part WHERE p_size % 3 = k) AS programs FROM (VALUES ('blit', 0), ('crop', 1), ('scale', 9), ('detect_mirror_symmetry', 2), ('Color', 9), ('Symmetry', 9), ('MirrorSymmetry', 9)) v(name, k)")
def usage_histogram(t):
    p = code.with_syntax(_programs(t))
    return code.usage_histogram(p.sparkSession.createDataFrame(_LIBRARY, "name string, docstring string, kind string"), p)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS doc FROM part")
def docstring_extract(t):
    source = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"""\n'), "p_name", F.lit('\n"""\nx = 1'))).otherwise(F.concat(F.lit('""" open '), "p_name"))
    return t("part").select("p_partkey", X.docstring(source).alias("doc"))


_SEED = ("# concepts:\n# ", ", color change\n\n# description:\n# Uses ", "\n# twice.\n\ndef main(g):\n    return g\n\ndef generate_input():\n    x = 1\n    return x\n\ndef after():\n    pass\n")


def _seed(*parts):
    return F.concat(*[c for k, s in enumerate(_SEED) for c in (F.lit(s), *parts[k : k + 1])])


@query("SELECT p_partkey, concat('# description:', chr(10), '# Uses ', p_name, chr(10), '# twice.') AS description, concat('# concepts:', chr(10), '# ', p_brand, ', color change', chr(10), chr(10), chr(10), chr(10), 'def main(g):', chr(10), '    return g', chr(10), chr(10), 'def after():', chr(10), '    pass') AS code FROM part")
def description_split(t):
    return t("part").select("p_partkey", prompts.description_and_code(_seed(F.col("p_brand"), F.col("p_name"))).alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, concat(p_brand, ',', p_type) AS concepts FROM part WHERE p_brand < p_type UNION ALL SELECT p_partkey, concat(p_type, ',', p_brand) FROM part WHERE p_brand > p_type UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_brand = p_type")
def concept_cleanup(t):
    items = F.array("p_type", F.lit("a color change"), "p_brand", F.lit("color change"), "p_type")
    return t("part").select("p_partkey", F.array_join(prompts.clean_concepts(items), ",").alias("concepts"))


@query("SELECT p_partkey, (CASE p_size % 3 WHEN 0 THEN 2 ELSE 1 END)::INT AS shown, p_size % 3 = 1 AS named, true AS concept, p_size % 3 = 2 AS close, true AS size FROM part")
def direct_prompt(t):
    seeds = F.array(*[F.struct(F.lit(s).alias("seed_id"), _seed(F.col("p_brand"), F.col("p_name")).alias("content")) for s in ("a", "b")])
    names = F.array(F.lit("blit"), F.lit("crop"))
    one = lambda **k: prompts.direct_prompt(seeds, F.lit("def blit(): ..."), names, F.col("p_partkey"), largest=20, **k)
    made = F.when(F.col("p_size") % 3 == 0, one(remix=2, hint=0)).when(F.col("p_size") % 3 == 1, one(number=1, hint=2)).otherwise(one(number=1, remix=1, creative=False, brainstorm=False))
    out = t("part").select("p_partkey", "p_brand", made.alias("d"))
    has = lambda s: F.contains("d.prompt", F.lit(s))
    return out.select("p_partkey", F.size("d.seed_ids").alias("shown"), has("In particular use: ").alias("named"), (F.contains("d.prompt", F.concat(F.lit("They are:\n   "), "p_brand", F.lit("\n")))).alias("concept"), has("your template").alias("close"), has("under 20 wide").alias("size"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE event_id END AS k FROM events")
def literal_json(t):
    """Answers in Python's own notation, single quotes and None, are read too."""
    k = F.col("event_id").cast("string")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{'k': "), k, F.lit(", 'x': None}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('```json\n{"k": '), k, F.lit("}\n```"))).otherwise("{'k': open(")
    return t("events").select("event_id", code.parse_any_json(answer, "k long")["k"].alias("k"))


@query("SELECT event_id, concat('k', event_id % 10) AS prompt, 'gone' AS other FROM events WHERE event_id % 10 < 3")
def generic_map_filter(t):
    kept = dataset.filtered(t("events").select("event_id", "event_type"), lambda r: r["event_id"] % 10 < 3)
    return dataset.mapped(kept, lambda b: b.assign(prompt="k" + (b["event_id"] % 10).astype(str), other="gone"), "event_id long, prompt string, other string", batched=True)


@query("SELECT o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN concat('u', o_orderkey) END AS uid, concat('f.', o_orderkey) AS stem FROM orders")
def names_of_files(t):
    k = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/a/b/[u"), k, F.lit("] x"))).otherwise(k)
    return t("orders").select(F.col("o_orderkey").alias("name"), X.bracket_uid(name).alias("uid"), X.file_stem(F.concat(F.lit("/a/b.c/f."), k, F.lit(".json"))).alias("stem"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN 'soon' ELSE 'none' END AS iso FROM events")
def time_or_text(t):
    given = F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("string")).when(F.col("event_id") % 3 == 1, "soon")
    return t("events").select("event_id", X.utc_text(given, F.lit("none")).alias("iso"))


@query("SELECT conv_id, turn, (len(text) * 2)::INT AS n FROM conversations WHERE role <> 'system' AND turn % 2 = 0")
def image_turns(t):
    block = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("v"))
    content = F.when(F.col("turn") % 2 == 0, F.array(block("text", F.col("text")), block("image_url", F.lit("x")), block("text", F.col("text")))).otherwise(F.array(block("image_url", F.lit("x"))))
    out = chat.text_turns(t("conversations").select("conv_id", "turn", "role", content.alias("content")))
    return out.select("conv_id", "turn", F.aggregate("content", F.lit(0), lambda n, b: n + F.length(b["v"])).alias("n"))


@query("SELECT conv_id, md5('<|system|>' || chr(10) || '</s>' || chr(10) || '<|user|>' || chr(10) || min_by(text, turn) || '</s>' || chr(10) || '<|assistant|>' || chr(10) || max_by(text, turn) || '</s>' || chr(10)) AS chosen, md5('<|assistant|>' || chr(10) || max_by(text, turn) || '</s>' || chr(10)) AS answer FROM conversations GROUP BY conv_id")
def preference_templates(t):
    ends = t("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"), F.max_by("text", "turn").alias("a"))
    m = F.filter(chat.record(F.lit(""), F.col("q"), F.col("a")), lambda x: x["role"] != "system")
    return ends.select("conv_id", F.md5(chat.reward(m, m)["chosen"]).alias("chosen"), F.md5(chat.orpo(m, m)["chosen"]).alias("answer"))


@query("SELECT count(*) AS prompts, (ceil(count(*) / 512))::BIGINT AS batches, least(512, count(*))::INT AS most FROM (SELECT DISTINCT text FROM conversations)")
def embedding_batches(t):
    b = models.embedding_batches(t("conversations").select(F.md5("text").alias("key"), F.col("text").alias("prompt")))
    return b.agg(F.sum(F.size("keys")).alias("prompts"), F.count("*").alias("batches"), F.max(F.size("keys")).alias("most"))


@query()
def token_budget_by_vocabulary(t):
    """Rows of under 400 tokens with both ways of writing them; SQL knows no vocabulary."""
    import public_tokenizers

    count = tokens.token_count(public_tokenizers.path("word_bpe_49k.json"))
    d = t("documents").select("doc_id", "text", F.upper("text").alias("loud"))
    return corpus.within_both_budgets(d, ["text"], ["loud"], limit=400, count=count).select("doc_id")


@query("SELECT 7 AS steps, 0.5::DOUBLE AS rate, true AS dual, 'a|b' AS splits, 'part' AS name, (SELECT count(*) FROM part) AS rows")
def run_settings(t):
    from dataclasses import dataclass, field

    @dataclass
    class Run:
        steps: int = 1
        rate: float = 0.1
        dual: bool = False
        splits: list[str] = field(default_factory=list)
        name: str = "none"

    Run.__annotations__ = {"steps": int, "rate": float, "dual": bool, "splits": list[str], "name": str}
    (run,) = config.load(None, ["--steps=7", "--rate=0.5", "--dual=true", "--splits=a,b", "--name=part"], Run)
    rows = t(run.name)
    return rows.agg(F.count("*").alias("rows")).select(F.lit(run.steps).alias("steps"), F.lit(run.rate).alias("rate"), F.lit(run.dual).alias("dual"), F.lit("|".join(run.splits)).alias("splits"), F.lit(run.name).alias("name"), "rows")


_MAINS = {0: "def main(g):\n    return g + 1", 1: "def main(g):\n    return g[::-1]", 2: "def main(g):\n    raise ValueError('no')", 3: "def main(g):\n    while True: pass"}


def _main(size):
    out = F.lit(_MAINS[0])
    for k in (1, 2):
        out = F.when(size % 3 == k, F.lit(_MAINS[k])).otherwise(out)
    return out


@query(BASE + ", c AS (SELECT p.p_partkey, p_size, n, m, g FROM p JOIN part USING (p_partkey)) SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN 'error' ELSE 'ok' END AS status, (CASE p_size % 3 WHEN 0 THEN to_json(list_transform(range(n), lambda i: list_transform(range(m), lambda j: g[i+1][j+1] + 1))) WHEN 1 THEN to_json(list_transform(range(n), lambda i: list_transform(range(m), lambda j: g[n-i][j+1]))) END)::VARCHAR AS output FROM c")
def sandbox_runs(t):
    jobs = derived(t("part")).join(t("part").select("p_partkey", "p_size"), "p_partkey")
    jobs = jobs.select("p_partkey", _main(F.col("p_size")).alias("program"), F.lit("main").alias("function"), F.to_json(F.array("g")).alias("args"), F.lit(0).alias("seed"))
    return sandbox.execute(jobs, trusted=True, timeout=5.0).select("p_partkey", "status", F.regexp_replace("output", " ", "").alias("output"))


@query(BASE + ", c AS (SELECT p_partkey, p_size, n, m, g FROM p JOIN part USING (p_partkey)) SELECT p_partkey, 0 AS pair_idx, CASE p_size % 3 WHEN 2 THEN 'ERROR' WHEN 0 THEN 'CONTENT' ELSE CASE WHEN g = list_transform(range(n), lambda i: list_transform(range(m), lambda j: g[n-i][j+1])) THEN 'EQUAL' ELSE 'CONTENT' END END AS verdict FROM c")
def program_validation(t):
    """Parts are dealt to all cores first, as building grids costs far more than reading the few bytes they are made of; the joins keep that order."""
    part = dealt(t("part").select("p_partkey", "p_size"), "p_partkey")
    rows = derived(part).join(part, "p_partkey")
    programs = rows.select(F.col("p_partkey").alias("uid"), _main(F.col("p_size")).alias("program"))
    pairs = rows.select(F.col("p_partkey").alias("uid"), F.lit(0).alias("pair_idx"), F.col("g").alias("input"), F.col("g").alias("output"))
    return P.validated(programs, pairs, trusted=True, timeout=5.0).select(F.col("uid").alias("p_partkey"), "pair_idx", "verdict")


_MAKERS = {
    "good": "import numpy\nclass Color:\n    RED, BLUE = 2, 1\ndef generate_input():\n    return numpy.random.randint(0, 10, (3, 3))\ndef main(g):\n    return g.T",
    "loud": "import numpy\ndef generate_input():\n    return numpy.random.randint(1, 10, (2, 2))\ndef main(g):\n    return numpy.where(g == 2, 3, g) * 0 + 3",
    "dice": "import numpy\ndef generate_input():\n    return numpy.random.randint(0, 10, (3, 3))\ndef main(g):\n    return numpy.random.randint(0, 10, (3, 3))",
    "same": "import numpy\ndef generate_input():\n    return numpy.random.randint(0, 10, (2, 3))\ndef main(g):\n    return g",
    "black": "import numpy\ndef generate_input():\n    return numpy.random.randint(0, 10, (2, 3))\ndef main(g):\n    return g * 0",
    "wrong": "import numpy\ndef generate_input():\n    return numpy.random.randint(0, 10, (2, 3))\ndef main(g):\n    return g + 100",
    "bad": "def generate_input():\n    return [[11]]\ndef main(g):\n    return g",
}


@query("SELECT * FROM (VALUES ('good', NULL, 3::BIGINT, 3::BIGINT), ('loud', 'non_colour_invariant', 0, 3), ('dice', 'non_deterministic', 0, 3), ('same', NULL, 0, 3), ('black', NULL, 0, 3), ('wrong', NULL, 0, 3)) v(problem, ended_by, accepted, tried)")
def problem_generation(t):
    """Inputs, twenty runs and twenty permutations of colours for each, and the verdicts."""
    spark = t("region").sparkSession
    programs = spark.createDataFrame(list(_MAKERS.items()), "problem string, program string").repartition(8)
    inputs = P.generated_inputs(programs, 3, trusted=True, timeout=5.0, failures=2, partitions=8).select("problem", F.col("attempt").alias("grid_idx"), "grid")
    return sandbox.verdicts(P.checked(programs, inputs, trusted=True, timeout=5.0, partitions=8))


@query("SELECT p_partkey AS problem, (1 + p_size % 2)::INT AS ord FROM part")
def first_valid_sample(t):
    rows = t("part").select(F.col("p_partkey").alias("problem"), "p_size", F.explode(F.array(*[F.lit(k) for k in (3, 2, 1)])).alias("ord"))
    return sandbox.first_valid(rows.withColumn("valid", F.col("ord") > F.col("p_size") % 2)).select("problem", "ord")


@query("SELECT p_partkey, concat('import numpy', chr(10), 'from x import y', chr(10), 'RED = 2', chr(10), 'def f(): ', p_name) AS program FROM part")
def injected_constants(t):
    source = F.concat(F.lit("import numpy\nfrom x import y\ndef f(): "), "p_name")
    return t("part").select("p_partkey", X.inject_constants(source, "RED = 2\n").alias("program"))


@query("SELECT p_partkey, 2 AS blocks, p_brand || '|' || p_type AS concepts, concat('x = 1') AS rest FROM part")
def concept_blocks(t):
    source = F.concat(F.lit("# concepts:\n# "), "p_brand", F.lit("\n# description:\n# one\n# concepts:\n# "), "p_type", F.lit("\n# description:\n# two\nx = 1"))
    b = X.concept_blocks(source)
    return t("part").select("p_partkey", F.size(b).alias("blocks"), F.array_join(F.transform(b, lambda x: F.array_join(x["concepts"], "|")), "|").alias("concepts"), X.without_blocks(source).alias("rest"))


_UID = """concat(substr(md5(concat('code', p_partkey)), 1, 8), substr(md5(concat('[{"input":', to_json(g), ',"output":', to_json(g), '}]')), 1, 8))"""


@query(BASE + f""", u AS (SELECT p_partkey, g, {_UID} AS uid FROM p)
SELECT p_partkey, uid, to_base64(encode(concat('{{"uid":"', uid, '",', CASE WHEN p_partkey % 2 = 0 THEN '"annotations":"good",' ELSE '' END, '"examples":[{{"input":', to_json(g), ',"output":', to_json(g), '}}],"code":"code', p_partkey, '"}}'))) AS export FROM u""")
def annotated_export(t):
    """The export itself."""
    pair = F.array(F.struct(F.col("g").alias("input"), F.col("g").alias("output")))
    rows = derived(t("part")).select("p_partkey", F.concat(F.lit("code"), F.col("p_partkey").cast("string")).alias("code"), pair.alias("examples"))
    notes = rows.filter("p_partkey % 2 = 0").select("p_partkey", X.problem_uid(F.col("code"), F.col("examples")).alias("uid"), F.lit("good").alias("annotations"))
    return P.annotated(rows, notes, ("uid", "p_partkey")).select("p_partkey", "uid", "export")
