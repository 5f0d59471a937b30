import json

import pytest
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.operators import chat, corpus, ledger, models, sandbox, scoring
from gridloom.sources import readers, writers
from gridloom.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("fractions, n", [({"a": 0.5, "b": 0.3, "c": 0.2}, 100), ({"a": 1, "b": 1, "c": 1}, 300), ({"a": 0.7, "b": 0.4}, 110)])
def test_mix(spark, fractions, n):
    df = spark.range(300).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("d"))
    assert corpus.mix(df, "d", "id", fractions).count() == n
    with pytest.raises(ValueError):
        corpus.mix(df, "d", "id", {"a": -0.1})


def test_split_numbers_and_batches(spark):
    df = spark.range(101)
    out = corpus.ordered_split(df, "id")
    assert out.filter("split = 'train'").count() == 95
    assert rows(corpus.numbered(df, F.desc("id"), groups=7).select("rn", "id")) == [(k + 1, 100 - k) for k in range(101)]
    assert rows(corpus.batch_of(df, 10, "id").groupBy("batch").count())[-1] == (10, 1)
    others = corpus.sample_others(df, "id", 4)
    assert others.count() == 404 == others.distinct().count() and others.filter("id = other").count() == 0


def test_decontamination(spark):
    docs = spark.createDataFrame([(0, "clean text here"), (1, "x One  two\nthree four five six seven eight nine TEN eleven y"), (2, "a short\tone b"), (3, "prefone two three four five six seven eight nine ten elevenpost")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "one two three four five six seven eight nine ten eleven"), (1, "Short one"), (2, " ")], "item_id long, text string")
    assert rows(corpus.contaminated(docs, bench)) == [(1, 0), (2, 1), (3, 0)]
    assert [r.doc_id for r in corpus.decontaminate(docs, bench).collect()] == [0]


def test_vote_and_pass(spark):
    s = spark.createDataFrame([("u", 0, 0, "a"), ("u", 0, 1, "b"), ("u", 0, 2, "b"), ("u", 0, 3, "c"), ("u", 1, 0, "c"), ("v", 0, 0, None)], "uid string, test_idx int, sample_idx long, answer string")
    top = scoring.vote(s)
    assert [(r.answer, r.votes) for r in top.filter("uid = 'u' AND test_idx = 0").orderBy("rank").collect()] == [("b", 2), ("a", 1)]
    assert [r.answer for r in scoring.vote(s, cumulative=True).filter("uid = 'u' AND test_idx = 1").orderBy("rank").collect()] == ["b", "c"]
    truth = spark.createDataFrame([("u", 0, "a"), ("u", 1, "x"), ("v", 0, "z"), ("w", 0, "q")], "uid string, test_idx int, answer string")
    assert tuple(scoring.pass_at_2(top, truth).first()) == (0.5, 3, pytest.approx(1 / 6, abs=1e-6))


def test_verdicts_and_expansions(spark):
    long = spark.createDataFrame([("u", 0, "train", True), ("u", 0, "train", None), ("u", 0, "test", True), ("u", 1, "test", True)], "uid string, sample_idx int, kind string, ok boolean")
    got = {r.sample_idx: (r.train_verdict, r.train_test_verdict) for r in scoring.verdict_rollup(long).collect()}
    assert got == {0: (False, False), 1: (True, True)}
    tasks = spark.createDataFrame([("t", [1, 1, 2], [7, 8]), ("two", [1, 2], [9])], "uid string, train array<int>, test array<int>")
    assert [r.train for r in scoring.leave_one_out(tasks).orderBy("held").collect()] == [[2], [2], [1, 1]]
    assert [r.uid for r in scoring.test_pairs(tasks).orderBy("uid").collect()] == ["t-0", "t-1", "two-0"]
    assert scoring.permutations([1, 2, 3]) == [[1, 2, 3]] and len(scoring.permutations([1, 2, 3], 99)) == 6
    parts = spark.createDataFrame([("u", 2, [3]), ("u", 1, [1, 2])], "uid string, ord int, items array<int>")
    assert scoring.merge_lists(parts, 2).first().items == [1, 2]


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "yo"), (1, 0, "user", "hi"), (2, 0, "system", "s"), (2, 1, "user", "q")], "conv_id long, turn long, role string, text string")
    m = chat.messages(turns).orderBy("conv_id")
    assert [r[0] for r in m.select(chat.render(chat.with_system(F.col("messages")))).collect()] == ["<|system|>\n</s>\n<|user|>\nhi</s>\n<|assistant|>\nyo</s>\n", "<|system|>\ns</s>\n<|user|>\nq</s>\n"]
    d = m.select(chat.dpo(F.col("messages"), F.col("messages")).alias("d")).first().d
    assert [x.content for x in d.prompt] == ["hi"] and [x.content for x in d.chosen] == ["yo"]
    assert rows(chat.tail(turns, 0).select("conv_id", "turn")) == [(2, 0)]
    blocks = spark.createDataFrame([([("text", "a"), ("image_url", "b")],)], "b array<struct<type:string,v:string>>")
    assert len(blocks.select(chat.without_images(F.col("b"))).first()[0]) == 1


def test_ledger(spark):
    led = spark.createDataFrame([("p", "c"), ("c", "d"), ("d", None), ("x", "gone")], "id string, prev_step_id string")
    assert [tuple(r) for r in ledger.lineage(led).orderBy("id").collect()] == [("c", "d", None, None), ("d", None, None, None), ("p", "c", "d", None), ("x", "gone", None, None)]
    raw = spark.createDataFrame([("", "b"), ("a", "b")], "`step-name` string, stepName string")
    assert rows(ledger.normalized_records(raw, {"step_name": ["step-name", "stepName"], "id": []})) == [("a", ""), ("b", "")]
    found = spark.createDataFrame([("a", "/2", 2), ("a", "/1", 1)], "k string, path string, r int")
    want = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(ledger.exists_or_missing(want, found, "k", "path", "r")) == [("a", True, "/1"), ("b", False, None)]


def test_model_tables(spark):
    prompts = models.keyed_prompts(spark.createDataFrame([(0, "p"), (1, "q")], "ordinal long, prompt string"), "m")
    cache = prompts.filter("ordinal = 0").select("key", F.lit("hit").alias("response"))
    assert models.complete(prompts, cache).count() == 1
    assert models.complete(prompts, cache, lambda miss: miss.select("key", F.lit("new").alias("response"))).count() == 2
    got = models.batch_answers(prompts, spark.createDataFrame([("request-1", "r")], "custom_id string, response string"))
    assert {r.ordinal: r.response for r in got.collect()} == {0: None, 1: "r"}
    assert json.loads(models.batch_requests(prompts, "m").first().body)["messages"][0]["content"] in ("p", "q")


def test_sandbox(spark):
    jobs = spark.createDataFrame(
        [(0, "def main(g):\n    return g + 1", "[[[1]]]"), (1, "def main(g):\n    while True: pass", "[[[1]]]"), (2, "def main(g):\n    raise ValueError('no')", "[[[1]]]"), (3, "import os\ndef main(g): return g", "[[[1]]]")],
        "id int, program string, args string",
    ).withColumns({"function": F.lit("main"), "seed": F.lit(1)})
    with pytest.raises(PermissionError):
        sandbox.execute(jobs)
    got = {r.id: (r.status, r.output) for r in sandbox.execute(jobs, trusted=True).collect()}
    assert got[0] == ("ok", "[[2]]") and got[1][0] in ("timeout", "error") and got[2][0] == got[3][0] == "error"


def test_problem_verdicts(spark):
    names = ["deterministic", "well_formed", "all_black", "colour_runs", "colour_formed", "equivariant", "identity"]
    good = [True, True, False, True, True, True, False]
    bad = [True, True, False, True, True, False, False]
    skip = [True, True, True, True, True, True, False]
    df = spark.createDataFrame([("a", 0, *good), ("a", 1, *skip), ("b", 0, *good), ("b", 1, *bad)], "problem string, grid_idx int, " + ", ".join(f"{n} boolean" for n in names))
    assert rows(sandbox.verdicts(df)) == [("a", None, 1, 2), ("b", "non_colour_invariant", 1, 2)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.jsonl").write_text('{"code": ["x"], "seeds": []}\nnot json\n')
    (tmp_path / "in/a.jsonl").write_text('{"code": ["y"], "seeds": ["s"]}\n')
    assert readers.json_lines(spark, f"{tmp_path}/in", schemas.CODE, skip_bad=True).count() == 2
    assert [r.file_name for r in readers.json_files(spark, f"{tmp_path}/in", schemas.CODE, most=1).collect()] == ["a.jsonl"]
    (tmp_path / "t/Concept").mkdir(parents=True)
    (tmp_path / "t/Concept/One1.json").write_text('{"train": [{"input": [[1]], "output": [[2]]}],\n "test": []}')
    one = readers.tasks(spark, f"{tmp_path}/t", schemas.TASK).first()
    assert (one.uid, one.concept, one.train[0].output) == ("One1", "Concept", [[2]])
    (tmp_path / "s").mkdir()
    (tmp_path / "s/25d487eb_Kevin.py").write_text("x\ny")
    (tmp_path / "s/common.py").write_text("z")
    assert [tuple(r) for r in readers.seeds(spark, f"{tmp_path}/s").collect()] == [("25d487eb_Kevin", "25d487eb", "x\ny")]
    (tmp_path / "log.csv").write_text('a,b\n1,"{""x"": ""y\nz""}"\n')
    assert rows(readers.csv(spark, f"{tmp_path}/log.csv")) == [("1", '{"x": "y\nz"}')]
    (tmp_path / "ids.txt").write_text("u1, u2,\nu3,")
    assert rows(readers.selectors(spark, f"{tmp_path}/ids.txt").select("id")) == [("u1",), ("u2",), ("u3",)]
    assert readers.selectors(spark, f"{tmp_path}/ids.txt", 2).count() == 2
    assert readers.probe_encoding("é".encode("latin1")) == "iso-8859-1" or readers.probe_encoding("é".encode("latin1")) in ("cp949", "euc-kr")
    (tmp_path / "m").mkdir()
    (tmp_path / "m/e.gif").write_bytes(b"")
    (tmp_path / "m/f.gif").write_bytes(b"abc")
    assert [(r.length, r.empty, r.too_large) for r in readers.listing(spark, f"{tmp_path}/m", "*.gif", 2).orderBy("length").collect()] == [(0, True, False), (3, False, True)]
    assert readers.media(spark, f"{tmp_path}/m").filter("length = 3").first().base64 == "YWJj"
    df = spark.createDataFrame([(1, [1, None], "train"), (2, None, "test")], "id int, a array<int>, split string")
    writers.json_lines(df, f"{tmp_path}/out")
    assert '"a":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    writers.splits(df, f"{tmp_path}/ds")
    assert readers.dataset(spark, f"{tmp_path}/ds", "split=train").count() == 1
    writers.csv(df, f"{tmp_path}/csv")
    assert readers.csv(spark, f"{tmp_path}/csv").filter("a = '[1,null]'").count() == 1
    writers.ledger(df, f"{tmp_path}/led")
    writers.ledger(df, f"{tmp_path}/led")
    assert spark.read.parquet(f"{tmp_path}/led").count() == 4
    writers.id_batches(spark.range(5), f"{tmp_path}/batches", "id", 2)
    assert len([p for p in (tmp_path / "batches").iterdir() if p.name.startswith("batch=")]) == 3


def test_streaming(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/land/1")
    schema = spark.range(1).schema
    for n in (3, 3, 5):
        if n == 5:
            spark.range(10, 12).write.parquet(f"{tmp_path}/land/2")
        ingest.once(ingest.landing(spark, f"{tmp_path}/land/*", schema), f"{tmp_path}/out", f"{tmp_path}/state")
        assert spark.read.parquet(f"{tmp_path}/out").count() == n


def test_generated_and_validated_programs(spark):
    from gridloom.operators import problems

    good = "import numpy\ndef main(g):\n    return g + 1\ndef generate_input():\n    return numpy.random.randint(0, 2, (1, 1))"
    programs = spark.createDataFrame([("a", good), ("b", "def main(g):\n    return g\ndef generate_input():\n    return [[11]]")], "problem string, program string")
    found = problems.generated_inputs(programs, 6, trusted=True, timeout=5.0).collect()
    assert {r.problem for r in found} == {"a"} and sorted(r.grid for r in found) == [[[0]], [[1]]]
    pairs = spark.createDataFrame([("a", 0, [[1]], [[2]]), ("a", 1, [[1]], [[3]]), ("b", 0, [[1, 2]], [[1, 3]])], "uid string, pair_idx int, input array<array<int>>, output array<array<int>>")
    got = problems.validated(programs.withColumnRenamed("problem", "uid"), pairs, trusted=True, timeout=5.0)
    assert rows(got.select("uid", "pair_idx", "verdict", "ratio")) == [("a", 0, "EQUAL", 1.0), ("a", 1, "CONTENT", 0.0), ("b", 0, "CONTENT", 0.5)]
