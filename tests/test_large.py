"""What only shows on larger tables, made small."""

import duckdb
from pyspark.sql import functions as F

from gridloom.functions import grid as G
from gridloom.functions import text as X
from gridloom.operators import problems, sandbox
from gridloom.plans import catalogue


def same_as_sql(spark, name, folder, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def parts(spark, keys):
    return spark.createDataFrame([(k, 3) for k in keys], "p_partkey long, p_size int")


def test_problems_that_share_a_uid(spark, tmp_path):
    """Pairs of these part keys have equal grids, and codes whose hashes begin alike."""
    assert same_as_sql(spark, "annotated_export", tmp_path, part=parts(spark, [154217, 476177, 1125775, 958345, 1, 2]))
    rows = spark.createDataFrame([(k, f"code{k}", [([[1]], [[2]])]) for k in (154217, 476177)], "k long, code string, examples array<struct<input:array<array<int>>,output:array<array<int>>>>")
    notes = rows.filter("k = 154217").select("k", problems.problem_uid("code", "examples").alias("uid"), F.lit("x").alias("annotations"))
    out = {r.k: r for r in problems.annotated(rows, notes, ("uid", "k")).select("k", "uid", F.unbase64("export").cast("string").alias("e")).collect()}
    assert len(out) == 2 and out[154217].uid == out[476177].uid and '"x"' in out[154217].e and "annotations" not in out[476177].e


def test_a_prompt_is_parsed_once(spark, tmp_path):
    pairs = spark.createDataFrame([("Input:\nBlack Red\n\nOutput:\nBlue\n\nInput:\nGreen\n",)], "t string").select(X.prompt_pairs(F.col("t")).alias("q"))
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Input|Output") == 1
    assert pairs.select("q.train.input", "q.train.output", "q.test").first() == ([[[0, 2]]], [[[1]]], [[3]])
    assert same_as_sql(spark, "prompt_to_grids", tmp_path, part=parts(spark, range(20)).coalesce(1))
    out = catalogue.queries()["prompt_to_grids"](spark, str(tmp_path))
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_equal_jobs_run_once_and_others_on_all_cores(spark):
    clock = "import time\ndef main(g):\n    return [time.time_ns()]"
    jobs = spark.range(60).coalesce(1).select("id", F.lit(clock).alias("program"), F.lit("main").alias("function"), F.concat(F.lit("[[["), F.col("id") % 20, F.lit("]]]")).alias("args"), F.lit(0).alias("seed"))
    got = sandbox.execute(jobs, trusted=True, timeout=20.0).withColumn("at", F.spark_partition_id()).collect()
    assert len(got) == 60 and {r.status for r in got} == {"ok"}
    assert len({r.output for r in got}) == 20 == len({(r.args, r.output) for r in got}) and len({r.at for r in got}) > 1


def test_the_memory_of_jobs_is_bounded():
    memory, runs = sandbox.Memory(40), []
    for k in (1, 1, 2, 3, 4, 1):
        job = ("p" * 8, "f", f"{k}", 0)
        assert memory.of(job, lambda k=k: runs.append(k) or {"status": "ok", "output": f"{k}", "error": None})["output"] == f"{k}"
    assert runs == [1, 2, 3, 4, 1] and memory.held <= 40


def test_validation_uses_all_cores(spark, tmp_path):
    assert same_as_sql(spark, "program_validation", tmp_path, part=parts(spark, range(12)).coalesce(1))
    out = catalogue.queries()["program_validation"](spark, str(tmp_path))
    assert out.select("verdict", F.spark_partition_id().alias("at")).select("at").distinct().count() > 1


def test_a_box_is_found_once_a_grid(spark, tmp_path):
    """The mask asks for the box at every cell."""
    rows = [(0, [[0, 1, 0], [0, 0, 2]]), (1, [[0, 0]]), (2, [[3]]), (3, [])]
    grids = spark.createDataFrame(rows, "k int, g array<array<int>>").select("k", G.bounding_box_mask(F.col("g")).alias("mask"), G.bounding_box(F.col("g")).alias("b"))
    assert grids.select("mask")._jdf.queryExecution().optimizedPlan().toString().count("filter(flatten(") == 1
    assert {r.k: (r.mask, tuple(r.b)) for r in grids.collect()} == {0: ([[False, True, True]] * 2, (0, 1, 2, 2)), 1: ([[False, False]], (1, 2, -1, -2)), 2: ([[True]], (0, 0, 1, 1)), 3: ([], (0, None, 0, None))}
    assert same_as_sql(spark, "grid_bbox_mask", tmp_path, part=parts(spark, range(40)).coalesce(1))
    out = catalogue.queries()["grid_bbox_mask"](spark, str(tmp_path))
    assert out.select("value", F.spark_partition_id().alias("at")).select("at").distinct().count() > 1


def test_a_transform_is_drawn_once_a_task_and_round(spark, tmp_path):
    """All grids of a task ask for it, some at every cell."""
    assert same_as_sql(spark, "augment_tasks", tmp_path, part=parts(spark, range(60)).coalesce(1))
    out = catalogue.queries()["augment_tasks"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(-, colors") == 1
    assert out.select("train", F.spark_partition_id().alias("at")).select("at").distinct().count() > 1
