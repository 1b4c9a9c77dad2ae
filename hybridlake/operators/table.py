"""Record maintenance: validation, upsert, deletes, listing, counts, and a
snapshot store standing in for the reference's index lifecycle.

Upsert keeps the latest version per id with an aggregate (``max_by`` on
(batch, seq)), which combines map-side: a hot id is reduced to one row per
partition before the shuffle instead of sorting its whole group in one task.
The aggregate only sees the incoming batch and the rows it touches; the rest
of the table is streamed through an anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, FloatType, IntegerType, MapType, StringType, StructField,
                               StructType, TimestampType)

from hybridlake.functions.vectors import dimension_ok

RECORD_SCHEMA = StructType([
    StructField("chunk_id", StringType(), False),
    StructField("document_name", StringType()),
    StructField("page_number", IntegerType()),
    StructField("chunk_index", IntegerType()),
    StructField("text", StringType()),
    StructField("embedding", ArrayType(FloatType(), False)),
    StructField("metadata", MapType(StringType(), StringType())),
    StructField("created_at", TimestampType()),
])


def validate_records(batch: DataFrame, dim: int, id_col: str = "chunk_id", text_col: str = "text",
                     vec_col: str = "embedding") -> DataFrame:
    """Tag rows ``accepted`` / ``rejected`` with the first failing rule."""
    reason = (F.when(F.col(id_col).isNull(), F.lit("missing_id"))
              .when(F.col(text_col).isNull(), F.lit("missing_text"))
              .when(~dimension_ok(vec_col, dim), F.lit("bad_dimension")))
    return batch.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("accepted")).otherwise(F.lit("rejected")))


def ingest_report(validated: DataFrame) -> DataFrame:
    """Counts per (status, reason): the bulk call's (success count, errors)."""
    return validated.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def latest_by_id(df: DataFrame, id_col: str, order_cols: tuple[str, ...]) -> DataFrame:
    """One row per id: the one with the greatest ``order_cols`` (later wins)."""
    payload = [c for c in df.columns if c != id_col]
    best = F.max_by(F.struct(*payload), F.struct(*order_cols))
    return df.groupBy(id_col).agg(best.alias("r")).select(id_col, *[F.col("r")[c].alias(c) for c in payload])


# Incoming batches up to this many rows have their ids broadcast, so the table
# being updated is only streamed (semi/anti joins), never shuffled.
MAX_BROADCAST_IDS = 1_000_000


def merge_latest(base: DataFrame, incoming: DataFrame, id_col: str, order_cols: tuple[str, ...],
                 broadcast_ids: bool) -> DataFrame:
    """``base`` (one row per id) updated with ``incoming``: per id the row with
    the greatest ``order_cols`` wins. Only ids present in ``incoming`` are
    aggregated; the rest of ``base`` passes through an anti join."""
    new = latest_by_id(incoming, id_col, order_cols)
    ids = new.select(id_col)
    if broadcast_ids:
        ids = F.broadcast(ids)
    touched = base.join(ids, id_col, "left_semi")
    resolved = latest_by_id(touched.unionByName(new), id_col, order_cols)
    return base.join(ids, id_col, "left_anti").unionByName(resolved.select(*base.columns))


def upsert(current: DataFrame, batch: DataFrame, batch_id: int, id_col: str = "chunk_id",
           seq_col: str | None = None) -> DataFrame:
    """Replace-by-id: the batch's rows replace whole records; inside the batch the
    row with the greatest ``seq_col`` wins; a row never replaces a newer
    version (so replaying a batch is a no-op). Rows have no order of their own:
    without ``seq_col`` an id that the batch holds twice is an error. Rows
    without an id are left out.

    Only the ids the batch touches are resolved by an aggregate; the rest of
    the table passes through an anti join against the batch's ids.
    """
    batch = batch.where(F.col(id_col).isNotNull())
    seq = F.col(seq_col) if seq_col else F.lit(0)
    if not seq_col and not batch.groupBy(id_col).count().where("count > 1").isEmpty():
        raise ValueError(f"the batch has several rows of one {id_col}: name the column that orders them (seq_col)")
    cols = [c for c in current.columns if c not in ("_batch", "_seq")]
    old = current.select(*cols, F.col("_batch") if "_batch" in current.columns else F.lit(-1).cast("long").alias("_batch"),
                         F.col("_seq") if "_seq" in current.columns else F.lit(0).cast("long").alias("_seq"))
    new = batch.select(*cols, F.lit(batch_id).cast("long").alias("_batch"), seq.cast("long").alias("_seq"))
    return merge_latest(old, new, id_col, ("_batch", "_seq"), batch.count() <= MAX_BROADCAST_IDS)


def index_one(current: DataFrame, record: dict, batch_id: int, id_col: str = "chunk_id") -> DataFrame:
    """Index a single record (metadata defaults to ``{}``): an upsert of one row,
    visible in the returned table at once."""
    spark = current.sparkSession
    row = {c: record.get(c) for c in current.columns if c not in ("_batch", "_seq")}
    if "metadata" in row and row["metadata"] is None:
        row["metadata"] = {}
    schema = current.select(*row.keys()).schema
    one = spark.createDataFrame([tuple(row.values())], schema)
    return upsert(current, one, batch_id, id_col=id_col, seq_col=None)


def delete_report(records: DataFrame, name: str, name_col: str = "document_name") -> DataFrame:
    """Counts of a delete-by-name: rows removed and rows kept (one pass)."""
    hit = F.col(name_col).eqNullSafe(F.lit(name))
    return records.agg(F.count(F.when(hit, 1)).alias("deleted"), F.count(F.when(~hit, 1)).alias("remaining"))


def delete_by_ids(records: DataFrame, ids: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return records.join(ids.select(id_col), id_col, "left_anti")


def delete_by_name(records: DataFrame, name: str, name_col: str = "document_name") -> DataFrame:
    """Exact keyword match; NULL names are kept."""
    return records.filter(~F.col(name_col).eqNullSafe(F.lit(name)))


def list_records(records: DataFrame, limit: int = 100, offset: int = 0, id_col: str = "chunk_id",
                 cols: tuple[str, ...] = ("text", "metadata")) -> DataFrame:
    """A page of records in id order (a global top-(offset+limit), not a sort)."""
    return records.select(id_col, *cols).orderBy(id_col).offset(offset).limit(limit)


def sample_record(records: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    return records.drop(vec_col).orderBy(id_col).limit(1)


class RecordStore:
    """Snapshots under ``root``: ``snapshot=<n>`` folders, the current one being
    the highest with a ``_SUCCESS`` marker. Writers never overwrite a folder
    being read; a failed write leaves no marker and is ignored."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _snapshots(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        out = []
        for st in self._fs.listStatus(self._path(self.root)):
            name = st.getPath().getName()
            if name.startswith("snapshot=") and self._fs.exists(self._path(f"{st.getPath()}/_SUCCESS")):
                out.append(int(name.split("=", 1)[1]))
        return sorted(out)

    def exists(self) -> bool:
        return self._fs.exists(self._path(self.root))

    def create(self, schema: StructType = RECORD_SCHEMA) -> bool:
        """Create if absent; True when created."""
        if self.exists():
            return False
        self.spark.createDataFrame([], schema).write.parquet(f"{self.root}/snapshot=0")
        return True

    def drop(self) -> bool:
        """Delete if present; True when deleted."""
        if not self.exists():
            return False
        return bool(self._fs.delete(self._path(self.root), True))

    def read(self) -> DataFrame:
        snaps = self._snapshots()
        if not snaps:
            return self.spark.createDataFrame([], RECORD_SCHEMA)
        return self.spark.read.parquet(f"{self.root}/snapshot={snaps[-1]}")

    def commit(self, df: DataFrame) -> int:
        snaps = self._snapshots()
        n = (snaps[-1] + 1) if snaps else 1
        df.write.mode("overwrite").parquet(f"{self.root}/snapshot={n}")
        return n

    def count(self) -> int:
        """Record count; 0 when the store does not exist."""
        try:
            return self.read().count()
        except Exception:  # noqa: BLE001 - a missing or unreadable store counts as empty
            return 0
