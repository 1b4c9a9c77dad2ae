"""Readers for the input tables and the shapes the operators expect.

Every reader is a plain ``spark.read.parquet``: Catalyst prunes columns and
pushes filters into the scan, so callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.params import PDF_SUFFIX

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin the rows over the cluster's cores when the scan is narrower.

    A large input arrives as many file splits and is returned untouched (no
    shuffle); a small or unsplittable one (a single row group) would otherwise
    run every CPU-heavy text step in one task.
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        narrow = df.rdd.getNumPartitions() < target
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave the scan as is
        return df
    return df.repartition(target) if narrow else df


def text_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The columns of a text-heavy table, spread over the cores."""
    return spread(read_table(spark, sf_dir, name).select(*cols))


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as extracted files: ``doc_id, path, text, source, lang``.

    The driver corpus has no file names, so each document gets the path
    ``<source>/<doc_id>.pdf`` (source is one of a few collections).
    """
    d = text_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return d.select(
        "doc_id",
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(PDF_SUFFIX)).alias("path"),
        "text", "source", "lang",
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts: ``qid, query_text`` (every benchmark item)."""
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query_text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: ``conv_id, turn, role, text``."""
    return text_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations re-read as paged documents (the input shape of page assembly).

    One document per conversation (``conv-<id>``), one page per turn. Turns of
    role ``system`` stand for scanned pages: no extractable text, their text
    arrives as OCR output of two images, the second of which failed (NULL).
    An empty turn stands for a page whose extraction raised.
    """
    m = messages(spark, sf_dir)
    scanned = F.col("role") == "system"
    return m.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("document_name"),
        F.col("turn").cast("int").alias("page_number"),
        F.when(scanned, F.lit("")).otherwise(F.col("text")).alias("page_text"),
        (F.col("text") == "").alias("page_error"),
        F.when(scanned, F.array(F.col("text"), F.lit(None).cast("string")))
        .otherwise(F.array().cast("array<string>")).alias("image_texts"),
    )
