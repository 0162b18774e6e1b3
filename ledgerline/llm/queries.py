"""Queries opN_<name> over the given tables, and the SQL they are checked against where SQL can express them.

Each query calls its operator and derives the columns of its contract from the operator's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    bpe, chat, decontaminate, filteraudit, jaccardjoin, licenses, linededup, merkle, quality, sharding, simhash, topk, toxicity)
from ledgerline.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _fold(doc_id: Column, parts: int) -> Column:
    """The part of an id; a null id is in none, so comparisons with it need a value for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        _sha(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    best = licenses.license_notices(docs).groupBy("doc_id", "place", "start").agg(
        F.max("dice").alias("dice"), F.max_by("license", F.struct("dice", "license")).alias("license"))
    per_doc = best.groupBy(F.col("doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("n_matches"), F.max("dice").alias("best_dice"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"))
    return docs.select("doc_id").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"),
        F.coalesce("licenses", F.lit("")).alias("licenses"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, drop_text=True)
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = _fold(F.col("doc_id"), 5)
    scored = toxicity.toxicity(docs, labels.where(fold != 0))
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shard_names() -> list[str]:
    return [f"shard-{i:04d}" for i in range(sharding.SHARDS)]


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), shard_names())


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.preference_pairs(chat.echo_pairs(table(spark, sf_dir, "conversations")))

    def places(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["from"], s["to"])), ",").alias(spans)

    return pairs.select(
        F.col("pair_id").alias("conv_id"), "n_prompt_turns", _sha(F.col("prompt")).alias("prompt_sha256"),
        _sha(F.col("chosen")).alias("chosen_sha256"), _sha(F.col("rejected")).alias("rejected_sha256"),
        places("chosen_spans"), places("rejected_spans"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = _fold(F.col("doc_id"), 3)
    scored = quality.quality(docs, labels.where(fold != 1))
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linededup.remove_lines(docs, F.col("source")).select(
        "doc_id", F.col("_llm_removed").cast("long").alias("n_removed"),
        _sha(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"), _fold(F.col("doc_id"), 7) == 0)


def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.near_sets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination,
    "op2_license_scan": license_scan,
    "op3_bpe": bpe_round_trip,
    "op4_top_k": exact_top_k,
    "op5_toxicity": toxicity_scores,
    "op6_simhash": simhash_components,
    "op7_sharding": sharded,
    "op8_preferences": preferences,
    "op9_quality": quality_scores,
    "op10_line_dedup": line_dedup,
    "op11_filter_audit": filter_audit,
    "op12_merkle_manifest": merkle_proofs,
    "op13_jaccard_join": jaccard_components,
}
