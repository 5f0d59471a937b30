"""The registered queries of this subpackage: each applies its operator to the whole of `documents`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, language, line_dedup, minhash, pieces, quality, secrets, toxicity, whitening
from .common import keyed
from .oracles import oracle_sql  # noqa: F401  (part of this module's interface)
from .packing import pack
from .simhash import near_duplicates
from .substring_dedup import remove_repeated_words
from .suffix_dedup import remove_repeated_bytes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _id():
    return F.col("row.doc_id").alias("doc_id")


def _cut():
    """Tokens in all spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(documents(spark, sf_dir))
    return out.select(_id(), "n_words", _cut().alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def _remainder(k: int):
    return F.crc32(F.col("doc_id").cast("string")) % k


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.learn(docs, _remainder(3) != 1)
    out = language.identify(docs, model)
    return out.select(_id(), F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    sha = F.sha2(secrets.written_spans(base).cast("binary"), 256)
    return out.select(_id(), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), sha.alias("base_sha256"), secrets.written_spans(F.col("spans")).alias("spans"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.compare_edited(keyed(documents(spark, sf_dir)))
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    return out.select(_id(), "n_chars", sha.alias("edited_sha256"), minhash.packed(F.col("fingerprint")).alias("fingerprint"), minhash.packed(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the number of ids, a digest of them in decimal, and whether decoding gives the text back."""
    out = pieces.decode(pieces.encode(documents(spark, sf_dir)))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    digest = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
    return out.select(_id(), F.size("ids").cast("long").alias("n_ids"), digest.alias("ids_sha256"), (F.col("decoded") == text).alias("round_trip"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(documents(spark, sf_dir))
    return out.select(_id(), "n_bytes", _cut().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base_failed = F.col("failures").bitwiseAND(quality.policy_mask("v1")) != 0
    out = quality.ledger(documents(spark, sf_dir))
    return out.select(_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & quality.passes("v2")).alias("kept"), "failures")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule how many texts fail it, fail it alone, and would be kept without it."""
    return quality.ablations(quality.ledger(documents(spark, sf_dir)), "v2")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = toxicity.score(docs, toxicity.learn(docs, labels, _remainder(5) != 0))
    return out.select(_id(), F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])
    return out.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(documents(spark, sf_dir))
    return out.select(_id(), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The opN_ queries."""
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def reports() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries on what the operators leave behind."""
    return {"quality_ablations": quality_ablations}
