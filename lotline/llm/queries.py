"""The queries of these operators over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, filter_audit, gru_lm, jaccard, kd_cluster, media, mixing, pii, suffix_dedup, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings played as recordings, a row for each query they match; queries are those whose id is divisible by 100."""
    prints = media.fingerprints(media.played(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id")
    return media.aligned(prints, lambda key: key % 100 == 0).withColumnRenamed("key", "vec_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.scored(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    score = F.col(toxicity.RESULT)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.annotated(docs, table(spark, sf_dir, "benchmark"), result="r")
    return found.select("doc_id", "r.n_words", "r.n_hit", "r.n_items", "r.items_sha256", "r.contaminated")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations and the conversation -1, whose texts hold control strings."""
    told = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.digests(chat.format_paths(chat.as_chains(turns)))
    return read.select(F.expr("try_cast(tree as long)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.annotated(table(spark, sf_dir, "documents").select("doc_id", "text"), result="r")
    return found.select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_kd_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_cluster.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_media, op3_url_filter, op4_mixing, op5_language_model, op6_jaccard, op7_warc, op8_toxicity, op9_decontamination, op10_chat, op11_suffix_dedup, op12_filter_audit, op13_kd_cluster)}
