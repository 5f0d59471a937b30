"""Conversations: histories, filters, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def messages(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, messages): each conversation's turns in order. A conversation is one training row, so its list is bounded by a row."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("turn"), F.col("role"), F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def record(system: Column, user: Column, assistant: Column | None = None) -> Column:
    parts = [("system", system), ("user", user), *([("assistant", assistant)] if assistant is not None else [])]
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in parts])


def with_system(m: Column, supported: bool = True) -> Column:
    """An empty system turn first where there is none and the template knows one."""
    if not supported:
        return m
    empty = F.array(F.struct(F.lit("system").alias("role"), F.lit("").alias("content")))
    return F.when(F.get(m, 0)["role"] == "system", m).otherwise(F.concat(empty, m))


def render(m: Column, generation: bool = False) -> Column:
    """Turns as tagged text; for generation with an open assistant turn at the end."""
    text = F.array_join(F.transform(m, lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["content"], F.lit("</s>\n"))), "")
    return F.concat(text, F.lit("<|assistant|>\n")) if generation else text


def dpo(chosen: Column, rejected: Column) -> Column:
    """STRUCT<prompt, chosen, rejected>: all but the last turn, and the last turns."""
    last = lambda m: F.slice(m, -1, 1)
    return F.struct(F.slice(chosen, 1, F.size(chosen) - 1).alias("prompt"), last(chosen).alias("chosen"), last(rejected).alias("rejected"))


def orpo(chosen: Column, rejected: Column) -> Column:
    """STRUCT<prompt, chosen, rejected> as rendered text; the system turn comes first."""
    d = dpo(with_system(chosen), with_system(rejected))
    return F.struct(render(d["prompt"]).alias("prompt"), render(d["chosen"]).alias("chosen"), render(d["rejected"]).alias("rejected"))


def reward(chosen: Column, rejected: Column) -> Column:
    """STRUCT<chosen, rejected> as rendered text, whole conversations, the system turn first: for a reward model."""
    return F.struct(render(with_system(chosen)).alias("chosen"), render(with_system(rejected)).alias("rejected"))


def text_turns(turns: DataFrame, content: str = "content") -> DataFrame:
    """Turns whose content is a list of blocks: without system turns, without image blocks, and without turns that have none left."""
    return turns.filter("role <> 'system'").withColumn(content, without_images(F.col(content))).filter(F.size(content) > 0)


def drop_roles(turns: DataFrame, *roles: str) -> DataFrame:
    return turns.filter(~F.col("role").isin(*roles))


def drop_keyword(turns: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    return turns.filter(~F.coalesce(F.contains(text, F.lit(keyword)), F.lit(False)))


def without_images(blocks: Column) -> Column:
    """Content blocks that are no images."""
    return F.filter(blocks, lambda b: b["type"] != "image_url")


def tail(turns: DataFrame, last: int, conv: str = "conv_id") -> DataFrame:
    """The system turns and the last `last` others of each conversation."""
    others = F.row_number().over(Window.partitionBy(conv, F.col("role") == "system").orderBy(F.desc("turn")))
    return turns.withColumn("_k", others).filter((F.col("role") == "system") | (F.col("_k") <= last)).drop("_k")


def last_prompt(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    return turns.groupBy(conv).agg(F.max_by("text", "turn").alias("text"))


def strip_end(t: Column, mark: str = "<|eot_id|>") -> Column:
    """The end mark at the text's end becomes a new line."""
    return F.regexp_replace(t, mark.replace("|", r"\|") + r"\z", "\n")
