"""Listing records in id order at any offset: ranges of ids with a directory of their counts.

``list_records`` finds a page by a global top-(offset + limit), which grows with
the offset. ``write_listing`` lays the records out once by ranges of their ids, a
folder for each, cut into stretches of rows that the directory counts; a page then
reads the stretches that hold it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a stretch, and stretches at most (the directory has a row for each, and for each folder).
RANGE_ROWS, MAX_RANGES = 100_000, 10_000
#: Rows of a folder at least: short stretches share one, or files and tasks would be as many as stretches.
FOLDER_ROWS = 25_000


def write_listing(records: DataFrame, root: str, id_col: str = "chunk_id", cols: tuple[str, ...] = ("text", "metadata"),
                  range_rows: int = RANGE_ROWS) -> str:
    """Records without an id are left out. Returns ``root``."""
    spark = records.sparkSession
    named = records.select(id_col, *cols).where(F.col(id_col).isNotNull())
    n = named.count()
    folders = max(1, min(MAX_RANGES, math.ceil(n / max(range_rows, FOLDER_ROWS))))
    rows = max(range_rows, math.ceil(n / MAX_RANGES))
    # ranges ascend with their number; rows of one id are in one range
    laid = named.repartitionByRange(folders, id_col).withColumn("range", F.spark_partition_id()).sortWithinPartitions("range", id_col)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of a row in its partition
    laid = laid.withColumn("stretch", F.floor(place / rows).cast("int")).select(id_col, *cols, "stretch", "range")
    laid.write.partitionBy("range").parquet(f"{root}/rows")
    rows = spark.read.schema(laid.schema).parquet(f"{root}/rows")
    rows.groupBy("range", "stretch").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{root}/directory")
    # the empty table tells the columns, whatever was written
    laid.limit(0).coalesce(1).write.parquet(f"{root}/columns")
    return root


def list_page(spark: SparkSession, root: str, limit: int = 100, offset: int = 0, id_col: str = "chunk_id") -> DataFrame:
    """``limit`` records in id order after the first ``offset``, as ``list_records`` gives them."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be >= 0")
    directory = sorted((r["range"], r["stretch"], r["n"]) for r in spark.read.schema("range int, stretch int, n long").parquet(
        f"{root}/directory").collect())
    wanted, before, skipped = [], 0, 0
    for folder, stretch, n in directory:
        if before + n <= offset:
            skipped = before + n
        elif before < offset + limit:
            wanted.append((folder, stretch))
        before += n
    rows = spark.read.schema(spark.read.parquet(f"{root}/columns").schema).parquet(f"{root}/rows")
    rows = rows.where(F.col("range").isin(sorted({folder for folder, _ in wanted})))
    if wanted:
        (first, least), (last, most) = wanted[0], wanted[-1]
        from_first, to_last = F.col("stretch") >= least, F.col("stretch") <= most
        rows = rows.where(from_first & to_last if first == last else ((F.col("range") > first) | from_first) & (
            (F.col("range") < last) | to_last))
    return rows.drop("range", "stretch").orderBy(id_col).offset(offset - skipped).limit(limit)
