"""Model calls as tables: prompts meet cached answers by key; what is missing is left for a client that the caller supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key
from .corpus import batch_of
from .ledger import cached


def keyed_prompts(prompts: DataFrame, model: str, temperature: float = 0.0, max_tokens: int = 0, system: str = "", top_p: float = 1.0) -> DataFrame:
    settings = [F.lit(str(x)) for x in (model, temperature, max_tokens, system, top_p)]
    return prompts.withColumn("key", cache_key(F.col("prompt"), *settings))


def complete(prompts: DataFrame, cache: DataFrame, client=None) -> DataFrame:
    """prompts (with key) and their answers from the cache, and for the others from client(missing) -> (key, response) where one is given."""
    known, missing = cached(prompts, cache)
    return known if client is None else known.unionByName(missing.join(client(missing), "key"), allowMissingColumns=True)


def lacking(requests: DataFrame, cache: DataFrame, wanted: int, key: str = "key") -> DataFrame:
    """Distinct requests of which the cache has fewer than `wanted` answers, with `remaining`, how many are to be asked for. Answers are counted where they lie, so a prompt with very many costs a row a task."""
    have = cache.groupBy(key).agg(F.count("*").alias("_n"))
    out = requests.dropDuplicates([key]).join(have, key, "left").withColumn("remaining", F.lit(wanted) - F.coalesce("_n", F.lit(0)))
    return out.filter("remaining > 0").drop("_n")


def cached_answers(requests: DataFrame, cache: DataFrame, wanted: int, key: str = "key", ordinal: str = "ordinal", seed: int = 0) -> DataFrame:
    """cache's rows of the requested keys, at most `wanted` of each: all there are, or those that a hash of seed, key and ordinal draws. Every task cuts its own rows of a key first, so no task holds all answers to one prompt."""
    mark = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"), F.col(ordinal).cast("string")))
    rows = cache.join(requests.select(key).distinct(), key, "left_semi").withColumn("_mark", mark).withColumn("_task", F.spark_partition_id())
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_mark", ordinal))
    some = rows.withColumn("_at", place(key, "_task")).filter(F.col("_at") <= wanted)
    return some.withColumn("_at", place(key)).filter(F.col("_at") <= wanted).drop("_mark", "_task", "_at")


def embedding_batches(prompts: DataFrame, size: int = 512, key: str = "key", text: str = "prompt") -> DataFrame:
    """(batch, keys, texts): distinct prompts, `size` to a request, in order of their keys."""
    numbered = batch_of(prompts.groupBy(key).agg(F.first(text).alias(text)), size, key)
    listed = F.array_sort(F.collect_list(F.struct(key, text)))  # `size` rows
    return numbered.groupBy("batch").agg(listed.alias("_p")).select("batch", F.col(f"_p.{key}").alias("keys"), F.col(f"_p.{text}").alias("texts"))


def batch_requests(prompts: DataFrame, model: str, ordinal: str = "ordinal") -> DataFrame:
    """(custom_id, body) of a batch file."""
    body = F.to_json(F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages")))
    return prompts.select(F.concat(F.lit("request-"), F.col(ordinal).cast("string")).alias("custom_id"), body.alias("body"))


def batch_answers(prompts: DataFrame, responses: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Every prompt with its response by number; none: null."""
    got = responses.select(F.regexp_extract("custom_id", r"\Arequest-(\d+)\z", 1).try_cast("long").alias(ordinal), "response")
    return prompts.join(got, ordinal, "left")


def rating(response: Column, field: str = "answer") -> Column:
    return F.get_json_object(response, f"$.{field}").try_cast("double")
