"""Programs, problems and their prompts: the filters and exports between the stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import all_color, compare, drawn_transform, is_grid, is_small_grid, pair_fits, permute_colors, seeded_permutation
from ..functions.kernels import moved_pairs
from ..functions.text import fill, one_line_base64, problem_uid
from ..schemas import COLORS
from .sandbox import execute

#: The columns of an error log and the fields they come from.
ERROR_FIELDS = {"code": "$.error.code", "kind": "$.error.type", "message": "$.error.message"}


def is_program(source: Column) -> Column:
    """Has both an entry point and an input generator."""
    return source.contains("def generate_input") & source.contains("def main(")


def is_solution(source: Column) -> Column:
    """An entry point alone: no generator and no concept comments."""
    return source.contains("def main") & ~source.contains("def generate_input") & ~source.contains("# concepts:")


def fitting_problems(problems: DataFrame, least: int = 4, largest: int = 30) -> DataFrame:
    """Pairs with a side over the limit go, then problems with too few pairs left."""
    kept = F.filter("examples", lambda p: pair_fits(p, largest))
    return problems.withColumn("examples", kept).filter(F.size("examples") >= least)


def valid_pairs(examples: Column) -> Column:
    """Well-formed pairs within the limit whose output differs from the input and is not all black."""
    ok = lambda p: is_small_grid(p["input"]) & is_small_grid(p["output"]) & (p["input"] != p["output"]) & F.exists(F.flatten(p["output"]), lambda c: c != 0)
    return F.filter(examples, ok)


def augmented_tasks(tasks: DataFrame, rounds: int, odds: float = 0.5, recolor: bool = True, wanted: int = 3) -> DataFrame:
    """tasks: (uid, train, test), pairs of grids. (uid, round, train, test) of each task under a transform drawn for each round, the same for all its pairs.

    Train pairs are topped up by those under the complementary transform, in drawn order,
    and the first `wanted` stay; of the tests the first. Tasks with a malformed grid or a
    side over the limit are left out.
    """
    pairs = F.concat("train", "test")
    whole = F.forall(pairs, lambda p: is_small_grid(p["input"]) & is_small_grid(p["output"])) & (F.size("test") > 0)
    side = F.array_max(F.transform(pairs, lambda p: F.greatest(F.size(p["input"]), F.size(F.get(p["input"], 0)), F.size(p["output"]), F.size(F.get(p["output"], 0)))))
    key = F.col("_key")
    # no filter, which Spark would move below the making of the grids and so make them twice
    drawn = tasks.withColumn("round", F.explode(F.when(whole, F.sequence(F.lit(0), F.lit(rounds - 1)))))
    drawn = drawn.withColumn("_key", F.concat_ws("-", F.col("uid").cast("string"), F.col("round").cast("string"))).withColumn("_t", drawn_transform(key, side, odds, recolor))
    pair = lambda p, other=False: F.struct(p["input"].alias("input"), p["output"].alias("output"), F.lit(other).alias("other"))
    places = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.size("train") - 1), lambda k: F.struct(F.md5(F.concat_ws("-", key, k.cast("string"))).alias("h"), k.alias("k")))), lambda x: x["k"])
    more = F.transform(F.slice(places, 1, F.greatest(wanted - F.size("train"), F.lit(0))), lambda k: pair(F.get("train", k), True))
    first = lambda pairs, n: F.transform(F.slice(pairs, 1, n), lambda p: pair(p))
    train = F.when(F.size("train") > 0, F.concat(first("train", wanted), more)).otherwise(first("train", wanted))
    return moved_pairs(drawn.select("uid", "round", train.alias("train"), first("test", 1).alias("test"), "_t"), ("train", "test"), "_t")


def usage_index(functions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(name, seed_id): each function with every seed whose text before the generator calls it, a row each, so that no list of a name that most seeds use is gathered. Names are looked up in the calls found in the text, so this is an equality join."""
    main = F.substring_index("content", "def generate_input", 1)
    called = seeds.select("seed_id", F.explode(F.array_distinct(F.regexp_extract_all(main, F.lit(r"(\w+)\("), F.lit(1)))).alias("name"))
    return functions.select("name").distinct().join(called, "name").select("name", "seed_id").distinct()


def error_rows(log: DataFrame) -> DataFrame:
    """log with the nested answer's fields as columns."""
    return log.withColumns({k: F.get_json_object("server_response", path) for k, path in ERROR_FIELDS.items()})


def prompts(rows: DataFrame, templates: DataFrame, mode: str, **values: str) -> DataFrame:
    """rows with `prompt`: the template of each row's mode, with columns filled in for its keys; a mode without a template gives none."""
    filled = fill(F.col("template"), **{k: F.col(c).cast("string") for k, c in values.items()})
    return rows.join(templates.select(mode, "template"), mode).withColumn("prompt", filled).drop("template")


def annotated(problems: DataFrame, annotations: DataFrame, by: tuple[str, ...] = ("uid",)) -> DataFrame:
    """(uid, export, and of `by` the rest): problems with their annotations, where there are any, as base64 JSON.

    A uid is 64 bits of two hashes, and equal grids share half of them, so in millions of
    problems some differ but share one; `by` names further columns of both tables that tell
    these apart.
    """
    p = problems.withColumn("uid", problem_uid(F.col("code"), F.col("examples"))).join(annotations, list(by), "left")
    return p.select(*dict.fromkeys(("uid", *by)), one_line_base64(F.to_json(F.struct("uid", "annotations", "examples", "code")).cast("binary")).alias("export"))


def generated_inputs(programs: DataFrame, wanted: int, trusted: bool = False, timeout: float = 1.0, failures: int = 20, partitions: int | None = None) -> DataFrame:
    """programs: (problem, program). (problem, attempt, grid) of the first `wanted` distinct well-formed inputs that seeded runs of generate_input give, the first attempt of equals.

    wanted + failures runs are made of each program, so a program that fails oftener than
    `failures` times gives fewer inputs.
    """
    done = input_runs(programs, wanted + failures, trusted, timeout, partitions).filter("status = 'ok' AND formed")
    good = done.groupBy("problem", "grid").agg(F.min("attempt").alias("attempt"))
    place = F.row_number().over(Window.partitionBy("problem").orderBy("attempt"))  # wanted + failures rows at most
    return good.withColumn("_k", place).filter(F.col("_k") <= wanted).select("problem", "attempt", "grid")


def input_runs(programs: DataFrame, attempts: int, trusted: bool = False, timeout: float = 1.0, partitions: int | None = None) -> DataFrame:
    """(problem, attempt, status, grid, formed) of seeded runs of generate_input."""
    runs = programs.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumns({"function": F.lit("generate_input"), "args": F.lit("[]")})
    done = execute(runs, trusted, timeout, partitions).withColumn("grid", F.from_json("output", "array<array<int>>"))
    return done.select("problem", F.col("seed").alias("attempt"), "status", "grid", is_grid(F.col("grid")).alias("formed"))


def input_counts(runs: DataFrame) -> DataFrame:
    """runs: as from input_runs(). (problem, tried, failed, malformed, duplicates)."""
    good = (F.col("status") == "ok") & F.col("formed")
    return runs.groupBy("problem").agg(
        F.count("*").alias("tried"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if((F.col("status") == "ok") & ~F.col("formed")).alias("malformed"),
        (F.count_if(good) - F.count_distinct(F.when(good, F.to_json("grid")))).alias("duplicates"),
    )


def checked(programs: DataFrame, inputs: DataFrame, trusted: bool = False, timeout: float = 1.0, runs: int = 20, permutations: int = 20, partitions: int | None = None) -> DataFrame:
    """programs: (problem, program); inputs: (problem, grid_idx, grid). One row for each input with what sandbox.verdicts() judges, and its output.

    Every input is run `runs` times with different seeds, and `permutations` times with the
    colours 1 to 9 permuted in the input, and in the program, whose names of colours follow.
    Inputs of which no plain run gives anything are left out.
    """
    job = programs.join(inputs, "problem").withColumns({"function": F.lit("main"), "_k": F.explode(F.sequence(F.lit(0), F.lit(runs + permutations - 1)))})
    key = F.concat_ws("-", F.col("problem").cast("string"), F.col("grid_idx").cast("string"), F.col("_k").cast("string"))
    turned = F.col("_k") >= runs
    job = job.withColumn("_map", F.when(turned, seeded_permutation(key)))
    job = job.withColumn("program", F.when(turned, with_colors(F.col("program"), F.col("_map"))).otherwise(F.col("program")))
    given = F.when(turned, permute_colors(F.col("grid"), F.col("_map"))).otherwise(F.col("grid"))
    done = execute(job.withColumns({"args": F.to_json(F.array(given)), "seed": F.col("_k")}), trusted, timeout, partitions)
    done = done.withColumn("got", F.from_json("output", "array<array<int>>")).withColumn("ran", F.col("status") == "ok")
    plain = ~turned
    # the first output that came is what the permuted ones are held against
    first = done.filter(plain & F.col("ran")).groupBy("problem", "grid_idx").agg(F.min_by("got", "_k").alias("_first"))
    both = done.join(first, ["problem", "grid_idx"])
    same = F.coalesce(F.col("got") == permute_colors(F.col("_first"), F.col("_map")), F.lit(False))
    formed = is_grid(F.col("got"))
    return both.groupBy("problem", "grid_idx").agg(
        (F.count_distinct(F.when(plain & F.col("ran"), F.to_json("got"))) == 1).alias("deterministic"),
        F.bool_and(F.when(plain & F.col("ran"), formed)).alias("well_formed"),
        F.coalesce(F.bool_and(F.when(plain & F.col("ran"), all_color(F.col("got")))), F.lit(False)).alias("all_black"),
        F.bool_and(F.when(turned, F.col("ran"))).alias("colour_runs"),
        F.bool_and(F.when(turned, formed)).alias("colour_formed"),
        F.bool_and(F.when(turned, same)).alias("equivariant"),
        F.bool_and(F.coalesce(F.col("grid") == F.col("_first"), F.lit(False))).alias("identity"),
        F.first("grid").alias("grid"), F.first("_first").alias("output"),
    )


def with_colors(program: Column, mapping: Column) -> Column:
    """The program in a palette of its own: names of colours 1 to 9 stand for what the mapping makes of them."""
    names = F.array(*[F.lit(c) for c in COLORS])
    marked = program
    for k, name in enumerate(COLORS[1:], 1):
        marked = F.regexp_replace(marked, rf"Color\.{name}(?![A-Za-z_])", f"Color.\u0001{k}\u0002")
    for k in range(1, 10):
        marked = F.replace(marked, F.lit(f"\u0001{k}\u0002"), F.get(names, F.get(mapping, F.lit(k))))
    return marked


def validated(programs: DataFrame, pairs: DataFrame, trusted: bool = False, timeout: float = 1.0) -> DataFrame:
    """programs: (uid, program); pairs: (uid, pair_idx, input, output). (uid, pair_idx, status, verdict, ratio) of running each program on each pair."""
    jobs = programs.join(pairs.withColumnRenamed("output", "want"), "uid").withColumns({"function": F.lit("main"), "seed": F.lit(0), "args": F.to_json(F.array("input"))})
    done = execute(jobs, trusted, timeout)
    got = compare(F.from_json("output", "array<array<int>>"), F.col("want"))
    return done.select("uid", "pair_idx", "status", got["verdict"].alias("verdict"), got["ratio"].alias("ratio"))
