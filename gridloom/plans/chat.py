"""Chat queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat as C
from .registry import query

_ALL = "string_agg('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10), '' ORDER BY turn)"
_FIRST = "CASE WHEN min_by(role, turn) = 'system' THEN '' ELSE '<|system|>' || chr(10) || '</s>' || chr(10) END"


@query(f"SELECT conv_id, md5({_ALL}) AS digest FROM conversations GROUP BY conv_id")
def chat_render_sft(t):
    return C.messages(t("conversations")).select("conv_id", F.md5(C.render(F.col("messages"))).alias("digest"))


@query(f"SELECT conv_id, md5({_FIRST} || {_ALL} || '<|assistant|>' || chr(10)) AS digest FROM conversations GROUP BY conv_id")
def chat_insert_system(t):
    return C.messages(t("conversations")).select("conv_id", F.md5(C.render(C.with_system(F.col("messages")), True)).alias("digest"))


@query("SELECT conv_id, (count(*) - 1)::INT AS n_prompt, max_by(role, turn) AS last_role, md5(max_by(text, turn)) AS last FROM conversations GROUP BY conv_id")
def chat_dpo_split(t):
    d = C.messages(t("conversations")).select("conv_id", C.dpo(F.col("messages"), F.col("messages")).alias("d"))
    last = F.get("d.chosen", 0)
    return d.select("conv_id", F.size("d.prompt").alias("n_prompt"), last["role"].alias("last_role"), F.md5(last["content"]).alias("last"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY role = 'system' OR row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) <= 3")
def history_tail(t):
    return C.tail(t("conversations"), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, md5(max_by(text, turn)) AS digest FROM conversations GROUP BY conv_id")
def last_prompt(t):
    return C.last_prompt(t("conversations")).select("conv_id", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND NOT contains(text, 'the')")
def filter_role_keyword(t):
    return C.drop_keyword(C.drop_roles(t("conversations"), "system"), "the").select("conv_id", "turn")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def strip_end_mark(t):
    marked = t("conversations").withColumn("text", F.concat("text", F.lit("<|eot_id|>")))
    m = C.messages(marked)
    return m.select("conv_id", F.md5(F.regexp_replace(F.array_join(F.transform("messages", lambda x: C.strip_end(x["content"])), ""), r"\n\z", "")).alias("digest"))
