"""The registered queries: each operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.llm import (bpe_chunks, centroid_clusters, fingerprints, line_templates, packing, periodic_runs, quality_model,
                            quality_rules, secrets, sentencepieces, simhash, suffix_dedup, toxicity)
from hybridlake.llm.common import documents
from hybridlake.sources.tables import read_table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encode(documents(spark, sf_dir))
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                        "parity")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).drop("covered_words", "longest_repeat")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    count = {f"n_{kind}": secrets.counted("base", kind) for kind in secrets.KINDS[:3]}
    return found.withColumns(count).select(
        "doc_id", *count, F.sha2(secrets.joined("base").cast("binary"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    found = line_templates.drop_boilerplate(docs.withColumn("n_lines", n_lines), count_col="n_dropped")
    return found.select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("kept_text"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_likeness(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.written("sketch").alias("fingerprint"),
        fingerprints.written("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next", "in_edited")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir, "doc_id", "text", "lang"), read_table(spark, sf_dir, "labels"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters.with_inertia(centroid_clusters.cluster(read_table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_chunks.encode(documents(spark, sf_dir))
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic_runs.detect(documents(spark, sf_dir), seed_col=seed).withColumn("best", periodic_runs.longest("runs"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(periodic_runs.listed("runs").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_bpe": op12_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}
