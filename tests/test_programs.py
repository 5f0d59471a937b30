import json
import time
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from gridloom import config
from gridloom.operators import dataset, problems, prompts, sandbox


@dataclass
class Model:
    name: str = "m"
    dual: bool = False
    splits: list[str] = field(default_factory=lambda: ["train"])


@dataclass
class Train:
    steps: int = 1
    rate: float = 0.1


def test_settings(tmp_path):
    (tmp_path / "run.yaml").write_text('{"name": "from file", "steps": 5}')
    m, t = config.load(f"{tmp_path}/run.yaml", ["--rate=0.5", "--dual=True", "--splits=a,b"], Model, Train)
    assert (m, t) == (Model("from file", True, ["a", "b"]), Train(5, 0.5))
    assert config.load(None, ["--dual=yes"], Model)[0].dual is False
    for args, kinds in ((["--steps=1", "--steps=2"], [Train]), (["--none=1"], [Train]), (["--steps"], [Train]), (["--steps=2"], [Train, Train])):
        with pytest.raises(ValueError):
            config.load(None, args, *kinds)


def test_blocked_imports():
    for program in ("import os", "x = 1; import os", "def f():\n  from os.path import join", "import numpy, sys", "__import__('os')"):
        assert sandbox.blocked(program)
    assert not sandbox.blocked("import numpy\nos_name = 'import os'") and not sandbox.blocked("def (")


def test_one_interpreter_serves_many_jobs():
    with sandbox.Runner() as r:
        assert r.run("def main(g):\n    return g + 1", "main", [[[1]]], timeout=20.0)["output"] == "[[2]]"
        pid = r.server.pid
        assert r.run("def main(g):\n    while True: pass", "main", [[[1]]], timeout=0.5)["status"] in ("timeout", "error")
        assert r.run("import numpy\ndef main(g):\n    raise SystemExit(3)", "main", [[[1]]])["status"] == "error"
        assert r.run("def main(g):\n    print('noise')\n    return g", "main", [[[7]]])["output"] == "[[7]]"
        assert r.run("def main(", "main", [])["status"] == "error"
        assert r.server.pid == pid
        began = time.time()
        for k in range(20):
            assert json.loads(r.run("import numpy\ndef main(g):\n    return numpy.random.randint(0, 9, (2, 2))", "main", [[[1]]], seed=k)["output"])
        assert time.time() - began < 20
    assert r.server is None


def test_prompts(spark):
    seeds = [("b", f"# concepts:\n# beta, color change\n\n# description:\n# d\n\ndef main(g): return g\n{prompts.CUT}\nhidden"), ("a", "# concepts:\n# alpha\n\n# description:\n# e\n\ndef main(g): return g")]
    df = spark.createDataFrame([(seeds,)], "s array<struct<seed_id:string,content:string>>")
    made = lambda **k: df.select(prompts.direct_prompt(F.col("s"), F.lit("LIB"), F.array(F.lit("blit"), F.lit("crop")), F.lit(1), **k).alias("d")).first().d
    plain = made()
    assert sorted(plain.seed_ids) == ["a", "b"] and "hidden" not in plain.prompt and "LIB" in plain.prompt and "color change\n" not in plain.prompt.split("They are:")[1]
    assert "variation of the last 2 examples" in made(remix=2).prompt and "In particular use: " in made(hint=1).prompt and "under 12 wide" in made(largest=12).prompt
    assert made(number=1).seed_ids == plain.seed_ids[:1] and made() == plain
    close = made(remix=1, creative=False).prompt
    assert "close copy of the last example" in close and close.index("your template") > close.index("Example puzzle:")
    with pytest.raises(ValueError):
        made(creative=False)
    assert made(template="{concepts}|{remix}").prompt in ("alpha, beta|", "beta, alpha|")


def test_map_and_filter(spark):
    df = spark.range(25)
    assert dataset.filtered(df, lambda r: r["id"] % 2 == 0).count() == 13
    assert dataset.filtered(df, lambda b: b["id"] < 5, batched=True, batch_size=3).count() == 5
    assert sorted(r.n for r in dataset.mapped(df, lambda r: {"n": r["id"] * 2}, "n long").collect()) == list(range(0, 50, 2))
    assert dataset.mapped(df.limit(0), lambda b: b.rename(columns={"id": "n"}), "n long", batched=True).count() == 0


def test_inputs_are_counted(spark):
    program = "import numpy\ndef generate_input():\n    k = numpy.random.randint(0, 4)\n    if k == 3: raise ValueError('no')\n    return [[int(k)]] if k else [[77]]"
    runs = problems.input_runs(spark.createDataFrame([("p", program)], "problem string, program string"), 24, trusted=True, timeout=5.0).cache()
    c = problems.input_counts(runs).first()
    assert c.tried == 24 and c.failed > 0 and c.malformed > 0 and c.failed + c.malformed + c.duplicates + 2 == 24
    got = problems.generated_inputs(spark.createDataFrame([("p", program)], "problem string, program string"), 1, trusted=True, timeout=5.0, failures=23).collect()
    assert len(got) == 1


def test_colours_in_programs(spark):
    df = spark.createDataFrame([("Color.BLUE Color.RED Color.BLUES Color.BLACK", [0, 2, 1, 3, 4, 5, 6, 7, 8, 9])], "p string, m array<int>")
    assert df.select(problems.with_colors(F.col("p"), F.col("m"))).first()[0] == "Color.RED Color.BLUE Color.BLUES Color.BLACK"
