"""Queries of the stages between programs, problems and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid as G
from ..operators import chat, models
from ..operators import problems as P
from .grids import BASE, derived
from .registry import query


@query("SELECT p_partkey, p_size % 3 = 0 AS program, p_size % 3 = 1 AS solution FROM part")
def program_filters(t):
    source = F.when(F.col("p_size") % 3 == 0, "def generate_input(): pass\ndef main(g): pass").when(F.col("p_size") % 3 == 1, "def main(g): pass").otherwise("# concepts:\ndef main(g): pass")
    return t("part").select("p_partkey", P.is_program(source).alias("program"), P.is_solution(source).alias("solution"))


@query(BASE + "SELECT p_partkey, (CASE WHEN n * 6 <= 30 AND m * 6 <= 30 THEN 5 ELSE 4 END)::INT AS pairs FROM p")
def pair_dimension_filter(t):
    pair = lambda k: F.struct(G.scale(F.col("g"), k).alias("input"), F.col("g").alias("output"))
    problems = derived(t("part")).select("p_partkey", F.array(*[pair(1)] * 4, pair(6)).alias("examples"))
    return P.fitting_problems(problems).select("p_partkey", F.size("examples").alias("pairs"))


@query(BASE + "SELECT p_partkey, (CASE WHEN g = list_transform(range(n), lambda i: list_transform(range(m), lambda j: g[n-i][j+1])) THEN 0 ELSE 1 END)::INT AS pairs FROM p")
def identity_filter(t):
    pair = lambda f: F.struct(F.col("g").alias("input"), f(F.col("g")).alias("output"))
    examples = F.array(pair(lambda g: g), pair(G.flip_rows), pair(lambda g: G.map_cells(g, lambda c: c * 0)))
    return derived(t("part")).select("p_partkey", F.size(P.valid_pairs(examples)).alias("pairs"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'blit' ELSE 'crop' END AS name, c_custkey::VARCHAR AS seed_id FROM customer")
def function_usage_index(t):
    seeds = t("customer").select(F.col("c_custkey").cast("string").alias("seed_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "x = blit(blit(g))").otherwise("x = crop(g)"), F.lit("\ndef generate_input():\n  flood(g)")).alias("content"))
    names = seeds.sparkSession.createDataFrame([("blit",), ("crop",), ("flood",)], "name string")
    return P.usage_index(names, seeds)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS code FROM events")
def error_rows(t):
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("code")).alias("error")))).otherwise("plain text")
    return P.error_rows(t("events").select("event_id", body.alias("server_response"))).select("event_id", "code")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'even ' || p_name ELSE p_name || ' odd ' || p_brand END AS prompt FROM part")
def prompt_modes(t):
    rows = t("part").withColumn("mode", F.when(F.col("p_size") % 2 == 0, "a").otherwise("b"))
    templates = rows.sparkSession.createDataFrame([("a", "even {name}"), ("b", "{name} odd {brand}")], "mode string, template string")
    return P.prompts(rows, templates, "mode", name="p_name", brand="p_brand").select("p_partkey", "prompt")


@query("SELECT coalesce(max(event_id) FILTER (event_type = 'click'), -1) AS last_index, coalesce(max(event_id) FILTER (event_type = 'none'), -1) AS none_index FROM events")
def last_index(t):
    top = lambda kind: F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("event_id"))), F.lit(-1))
    return t("events").agg(top("click").alias("last_index"), top("none").alias("none_index"))


@query("SELECT custkey, 'both' AS side FROM (SELECT c_custkey custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT custkey, 'left' FROM (SELECT c_custkey custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(t):
    c, o = t("customer").select(F.col("c_custkey").alias("custkey")), t("orders").select(F.col("o_custkey").alias("custkey"))
    return c.intersect(o).withColumn("side", F.lit("both")).unionByName(c.exceptAll(o.distinct()).distinct().withColumn("side", F.lit("left")))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS response FROM events")
def batch_api(t):
    prompts = t("events").select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("prompt"))
    answers = models.batch_requests(prompts.filter("ordinal % 3 <> 0"), "m")
    answers = answers.select("custom_id", F.get_json_object("body", "$.messages[0].content").alias("response"))
    return models.batch_answers(prompts, answers).select(F.col("ordinal").alias("event_id"), "response")


@query("SELECT event_id, value FROM events WHERE value >= 50")
def rating_filter(t):
    rated = t("events").withColumn("rating", models.rating(F.to_json(F.struct(F.col("value").alias("answer")))))
    return rated.filter("rating >= 50").select("event_id", "value")


@query("SELECT conv_id, md5('<|system|>' || chr(10) || 's</s>' || chr(10) || '<|user|>' || chr(10) || min_by(text, turn) || '</s>' || chr(10) || '<|assistant|>' || chr(10) || max_by(text, turn) || '</s>' || chr(10)) AS digest FROM conversations GROUP BY conv_id")
def chat_record(t):
    ends = t("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"), F.max_by("text", "turn").alias("a"))
    return ends.select("conv_id", F.md5(chat.render(chat.record(F.lit("s"), F.col("q"), F.col("a")))).alias("digest"))




@query(BASE + "SELECT p_partkey, (2 * (n - 1))::DOUBLE AS mx, (m - 1 - (p_partkey % 2))::DOUBLE AS ry FROM p")
def symmetry_points(t):
    g = derived(t("part"))
    turned = G.rotate_point(F.lit(0), F.col("p_partkey") % 2, (F.size(F.get("g", 0)) - 1) / 2, (F.size(F.get("g", 0)) - 1) / 2, 2)
    return g.select("p_partkey", G.mirror_point(F.lit(0), F.size("g") - 1).cast("double").alias("mx"), turned["y"].cast("double").alias("ry"))
