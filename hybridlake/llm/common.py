"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.session import scratch_path
from hybridlake.sources.tables import read_table, spread

#: Rows of one Arrow batch handed back to Spark by the Python stages.
OUT_ROWS = 20_000


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(*(cols or ("doc_id", "text"))))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` and nothing else, so that no other column can clash; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key() -> Column:
    """Tells rows with one id and different texts apart; repeated rows share it."""
    return F.xxhash64("text")


def packed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, key``: whole rows as one column, beside which no name can clash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"),
                       F.xxhash64(text).alias("key"))


def stored_at(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` once below the shared checkpoint folder; what reads it back, and where it is.

    Cuts the lineage: a lost executor costs a re-read of files, not a rerun of
    what made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``stored_at`` without the place: the table stays until the folder is cleaned."""
    return stored_at(df, name, compression)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored_at`` wrote and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The strings of a column one after another; null is the empty text."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py() or ""


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, without making Python strings."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    for value in column:
        yield value.as_py() or b""


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=field.type) for col, field in zip(zip(*rows), schema)], schema=schema)
