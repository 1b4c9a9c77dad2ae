"""Record maintenance, snapshot store and incremental ingest."""

import pytest
from pyspark.sql import functions as F

from hybridlake.operators.table import (RecordStore, delete_by_ids, delete_by_name, ingest_report,
                                        latest_by_id, list_records, upsert, validate_records)
from hybridlake.session import scratch_path
from hybridlake.streaming.ingest import current_view, run_ingest


def _recs(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_name string, text string")


def test_upsert_later_wins_and_replay_is_noop(spark):
    cur = _recs(spark, [("a", "d", "a0"), ("b", "d", "b0")])
    batch = spark.createDataFrame([("a", "d", "a1", 0), ("a", "d", "a2", 1), ("c", "e", "c1", 2)],
                                  "chunk_id string, document_name string, text string, seq long")
    once = upsert(cur, batch, 1, seq_col="seq")
    got = {r.chunk_id: r.text for r in once.collect()}
    assert got == {"a": "a2", "b": "b0", "c": "c1"}
    twice = upsert(once, batch, 1, seq_col="seq")
    assert sorted((r.chunk_id, r.text) for r in twice.collect()) == sorted((r.chunk_id, r.text) for r in once.collect())


def test_latest_by_id_with_hot_key(spark):
    rows = [(1, i, f"v{i}") for i in range(5000)] + [(2, 0, "only")]
    df = spark.createDataFrame(rows, "id long, ver long, v string").repartition(8)
    out = {r.id: r.v for r in latest_by_id(df, "id", ("ver",)).collect()}
    assert out == {1: "v4999", 2: "only"}


def test_validation_rejects_and_counts(spark):
    b = spark.createDataFrame([("a", "t", [1.0, 2.0]), (None, "t", [1.0, 2.0]), ("c", "t", [1.0]),
                               ("d", None, [1.0, 2.0]), ("e", "t", None)],
                              "chunk_id string, text string, embedding array<float>")
    rep = {(r.status, r.reason): r.n for r in ingest_report(validate_records(b, 2)).collect()}
    assert rep == {("accepted", None): 1, ("rejected", "missing_id"): 1, ("rejected", "bad_dimension"): 2,
                   ("rejected", "missing_text"): 1}


def test_deletes_and_listing(spark):
    recs = _recs(spark, [("a", "x", "1"), ("b", "y", "2"), ("c", None, "3"), ("d", "x", "4")])
    ids = spark.createDataFrame([("b",), ("zz",)], "chunk_id string")
    assert sorted(r.chunk_id for r in delete_by_ids(recs, ids).collect()) == ["a", "c", "d"]
    assert sorted(r.chunk_id for r in delete_by_name(recs, "x").collect()) == ["b", "c"]
    assert [r.chunk_id for r in list_records(recs, limit=2, offset=1, cols=("text",)).collect()] == ["b", "c"]


def test_record_store_lifecycle(spark):
    store = RecordStore(spark, scratch_path(spark, "store"))
    assert store.count() == 0
    assert store.create() is True and store.create() is False
    assert store.count() == 0
    n = store.commit(_recs(spark, [("a", "d", "t")]).select(
        "chunk_id", "document_name", F.lit(None).cast("int").alias("page_number"),
        F.lit(0).alias("chunk_index"), "text", F.lit(None).cast("array<float>").alias("embedding"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.lit(None).cast("timestamp").alias("created_at")))
    assert n >= 1 and store.count() == 1
    assert store.drop() is True and store.drop() is False and store.count() == 0


def test_streaming_ingest_replace_by_id_and_rerun(spark):
    root = scratch_path(spark, "stream-test")
    src, store, ckpt = f"{root}/in", f"{root}/store", f"{root}/ckpt"
    schema = "id long, text string"
    spark.createDataFrame([(i, f"v0-{i}") for i in range(20)], schema).write.mode("append").parquet(src)

    def keyed(df):
        return df.withColumnRenamed("id", "chunk_id")

    from pyspark.sql.types import LongType, StringType, StructField, StructType
    st = StructType([StructField("id", LongType()), StructField("text", StringType())])
    assert run_ingest(spark, src, st, store, ckpt, keyed) == 1
    spark.createDataFrame([(i, f"v1-{i}") for i in range(15, 25)], schema).write.mode("append").parquet(src)
    assert run_ingest(spark, src, st, store, ckpt, keyed) == 1
    assert spark.read.parquet(store).count() == 30
    view = {r.chunk_id: r.text for r in current_view(spark, store).collect()}
    assert len(view) == 25 and view[16] == "v1-16" and view[3] == "v0-3"
    assert run_ingest(spark, src, st, store, ckpt, keyed) == 0   # nothing new: no batch, same view
    assert len(current_view(spark, store).collect()) == 25


def test_index_one_and_delete_report(spark):
    from hybridlake.operators.table import delete_report, index_one
    cur = spark.createDataFrame([("a", "d", "t", {"k": "v"})],
                                "chunk_id string, document_name string, text string, metadata map<string,string>")
    out = {r.chunk_id: r for r in index_one(cur, {"chunk_id": "b", "document_name": "e", "text": "new"}, 1).collect()}
    assert set(out) == {"a", "b"} and out["b"].metadata == {} and out["a"].metadata == {"k": "v"}
    rep = delete_report(cur.unionByName(cur.withColumn("document_name", F.lit(None))), "d").first()
    assert (rep.deleted, rep.remaining) == (1, 1)


def test_upsert_older_batch_never_wins(spark):
    cur = _recs(spark, [("a", "d", "a0")])
    b2 = spark.createDataFrame([("a", "d", "a2", 0)], "chunk_id string, document_name string, text string, seq long")
    b1 = spark.createDataFrame([("a", "d", "a1", 0), ("z", "d", "z1", 1)],
                               "chunk_id string, document_name string, text string, seq long")
    after = upsert(upsert(cur, b2, 2, seq_col="seq"), b1, 1, seq_col="seq")
    assert {r.chunk_id: r.text for r in after.collect()} == {"a": "a2", "z": "z1"}


def test_streaming_view_with_compaction(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from hybridlake.streaming.ingest import compact
    root = scratch_path(spark, "stream-compact")
    src, store, ckpt, snap = f"{root}/in", f"{root}/store", f"{root}/ckpt", f"{root}/snap"
    st = StructType([StructField("id", LongType()), StructField("text", StringType())])

    def keyed(df):
        return df.withColumnRenamed("id", "chunk_id")

    def drop(rows):
        spark.createDataFrame(rows, st).write.mode("append").parquet(src)
        run_ingest(spark, src, st, store, ckpt, keyed)

    drop([(i, f"a{i}") for i in range(10)])
    drop([(i, f"b{i}") for i in range(5, 12)])
    before = {r.chunk_id: r.text for r in current_view(spark, store).collect()}
    assert compact(spark, store, snap) == 1
    drop([(i, f"c{i}") for i in (0, 11, 20)])
    after = {r.chunk_id: r.text for r in current_view(spark, store, snapshot_dir=snap).collect()}
    plain = {r.chunk_id: r.text for r in current_view(spark, store).collect()}
    assert after == plain
    assert before[5] == "b5" and after[0] == "c0" and after[11] == "c11" and after[20] == "c20" and after[3] == "a3"


def test_duplicates_in_a_batch_need_an_order(spark):
    cur = _recs(spark, [("a", "d", "a0")])
    twice = spark.createDataFrame([("a", "d", "a1", 1), ("a", "d", "a2", 2)],
                                  "chunk_id string, document_name string, text string, seq long")
    with pytest.raises(ValueError):
        upsert(cur, twice, 1)
    assert upsert(cur, twice.repartition(7), 1, seq_col="seq").first().text == "a2"


def test_streamed_versions_of_one_file_keep_their_order(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    root = scratch_path(spark, "stream-order")
    st = StructType([StructField("chunk_id", LongType()), StructField("text", StringType())])
    rows = [(i % 10, f"v{i // 10}") for i in range(40)]
    spark.createDataFrame(rows, st).coalesce(1).write.parquet(f"{root}/in")
    run_ingest(spark, f"{root}/in", st, f"{root}/store", f"{root}/ckpt", lambda df: df)
    assert {r.text for r in current_view(spark, f"{root}/store").collect()} == {"v3"}
