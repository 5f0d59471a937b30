"""Text queries; fences and headings are put around table columns, which have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ',two' WHEN 1 THEN event_type ELSE '' END AS code FROM events")
def fence_extract(t):
    tagged = F.concat(F.lit("Here:\n```python\n"), "event_type", F.lit("\n```\nand\n```text\nno\n```\n```python\ntwo\n```"))
    bare = F.concat(F.lit("Here:\n```\n"), "event_type", F.lit("\n```"))
    answer = F.when(F.col("event_id") % 3 == 0, tagged).when(F.col("event_id") % 3 == 1, bare).otherwise(F.col("event_type"))
    return t("events").select("event_id", F.array_join(X.fenced_blocks(answer), ",").alias("code"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k FROM events")
def robust_json(t):
    wrapped = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("'"), "props", F.lit("'"))).when(F.col("event_id") % 4 == 3, F.lit("not json")).otherwise(F.col("props"))
    return t("events").select("event_id", X.parse_json(wrapped, "k long")["k"].alias("k"))


@query("SELECT event_id, event_type AS process FROM events")
def section_regex(t):
    answer = F.concat(F.lit("THINKING ANALOGY: x\nTHINKING PROCESS:\n"), "event_type", F.lit("\nSOLUTION CODE:\ny"))
    return t("events").select("event_id", X.section(answer, "THINKING PROCESS", "SOLUTION CODE").alias("process"))


@query("SELECT p_partkey, 'PURPLE x ' || p_name || ' purple, stealing Purple' AS renamed FROM part")
def color_rename(t):
    source = F.concat(F.lit("TEAL x "), "p_name", F.lit(" teal, stealing Teal"))
    return t("part").select("p_partkey", X.rename_color(source, "teal", "purple").alias("renamed"))


@query("SELECT p_partkey, 'blue RED ' || p_partkey AS renamed FROM part")
def color_swap(t):
    return t("part").select("p_partkey", X.rename_colors(F.concat(F.lit("red BLUE "), F.col("p_partkey").cast("string")), {"red": "blue", "blue": "red"}).alias("renamed"))


@query("SELECT conv_id, turn, md5(text || '-m-0.0-5') AS key FROM conversations")
def md5_uid(t):
    return t("conversations").select("conv_id", "turn", X.cache_key(F.col("text"), F.lit("m"), F.lit("0.0"), F.lit("5")).alias("key"))


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT AS off FROM documents")
def hash_offset(t):
    return t("documents").select("doc_id", X.hash_offset(F.col("doc_id").cast("string")).alias("off"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def html_text(t):
    return t("pages").select("page_id", F.md5(X.html_text(F.col("html"))).alias("digest"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def utc_text(t):
    return t("events").select("event_id", X.utc_text(F.col("ts")).alias("iso"))


@query("SELECT p_partkey, 'alpha|' || p_brand AS concepts, 'does ' || p_name || ' and more' AS description FROM part")
def concept_parse(t):
    seed = F.concat(F.lit("# concepts:\n# alpha, "), "p_brand", F.lit("\n\n# description:\n# does "), "p_name", F.lit("\n# and more\n\ndef main(g):\n    return g\n"))
    return t("part").select("p_partkey", F.array_join(X.concepts(seed), "|").alias("concepts"), X.description(seed).alias("description"))


@query("SELECT p_partkey, true AS repaired, CASE p_size % 3 WHEN 0 THEN '' ELSE 'HUE' || chr(65 + p_size % 26) END AS unknown, ' = Color.RED, Colors.' || p_size AS kept FROM part")
def color_repair(t):
    name = F.when(F.col("p_size") % 3 == 0, "Color.BLUE").otherwise(F.concat(F.lit("Color.HUE"), F.char(65 + F.col("p_size") % 26)))
    source = F.concat(name, F.lit(" = Color.RED, Colors."), F.col("p_size").cast("string"))
    fixed = X.repair_colors(source)
    rest = F.regexp_extract(fixed, r"\AColor\.[A-Z]+( = .*)\z", 1)
    return t("part").select("p_partkey", (F.size(X.unknown_colors(fixed)) == 0).alias("repaired"), F.array_join(X.unknown_colors(source), ",").alias("unknown"), rest.alias("kept"))


@query("SELECT p_partkey, 'def transform(g): ' || p_name AS code FROM part")
def truncate_and_rename(t):
    source = F.concat(F.lit("def main(g): "), "p_name", F.lit("\n\ndef generate_input():\n    pass"))
    return t("part").select("p_partkey", X.rename_entry(X.before_marker(source, "def generate_input")).alias("code"))


@query("SELECT event_id, (event_id % 6)::DOUBLE AS score, event_id % 6 = 3 AS hit FROM events")
def judge_answers(t):
    reply = F.concat(F.lit('{"answer": "'), (F.col("event_id") % 6).cast("string"), F.lit('"}'))
    return t("events").select("event_id", X.judge_score(reply).alias("score"), X.judge_score(reply, F.lit(2)).alias("hit"))
