"""Scale properties of the physical plans, locked in as tests."""

import re

from pyspark.sql import functions as F

from hybridlake.operators.ann import build_ivf, ivf_search
from hybridlake.operators.hits import attach_records
from hybridlake.operators.fusion import hybrid_search
from hybridlake.operators.index import write_records
from hybridlake.operators.keyword import keyword_search
from hybridlake.operators.prompts import history_windows
from hybridlake.operators.table import upsert
from hybridlake.params import IVFParams, SearchParams
from hybridlake.plans.corpus import driver_index, driver_queries
from hybridlake.session import scratch_path

from conftest import SF_SMALL


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]


def test_single_query_keyword_search_prunes_term_buckets(spark):
    idx = driver_index(spark, SF_SMALL)
    one = driver_queries(spark, SF_SMALL).filter(F.col("qid") == 1)
    plan = _plan(keyword_search(idx, one, method="join"))
    pruned = re.findall(r"PartitionFilters: \[term_bucket[^\]]*\]", plan)
    assert len(pruned) == 2  # postings and term_stats


def test_ivf_reads_only_probed_cells(spark):
    vecs = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding")
    ivf = build_ivf(vecs, IVFParams(n_cells=8, nprobe=1), dim=64, id_col="vec_id",
                    materialize_to=scratch_path(spark, "t-ivf"))
    one = driver_queries(spark, SF_SMALL).filter(F.col("qid") == 2)
    plan = _plan(ivf_search(ivf, one, SearchParams(), nprobe=1))
    m = re.search(r"PartitionFilters: \[([^\]]*cell[^\]]*)\]", plan)
    assert m and re.search(r"cell#?\d* (= \d+|IN \(\d+\))", m.group(1)), plan[:2000]


def test_hit_lookup_reads_only_hit_buckets(spark):
    idx = driver_index(spark, SF_SMALL)
    one = driver_queries(spark, SF_SMALL).filter(F.col("qid") == 4)
    hits = hybrid_search(idx, one, SearchParams(top_k=2))
    plan = _plan(attach_records(hits, idx.records, ("text",), id_buckets=idx.id_buckets))
    m = re.search(r"PartitionFilters: \[([^\]]*id_bucket[^\]]*)\]", plan)
    assert m, plan[:2000]
    values = re.findall(r"id_bucket#?\d* = (\d+)", m.group(1)) or \
        re.search(r"id_bucket#?\d* IN \(([\d,]+)\)", m.group(1)).group(1).split(",")
    assert 1 <= len(values) <= 2


def test_upsert_never_shuffles_the_table(spark):
    big = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    batch = big.limit(3).withColumn("text", F.lit("new"))
    plan = _plan(upsert(big, batch, 1, id_col="doc_id", seq_col="doc_id"))
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "LeftSemi" in plan
    # every exchange sits above the small side or the touched rows, never directly over a scan of the table
    for m in re.finditer(r"Exchange hashpartitioning\(doc_id[^\n]*\n(?:[ :|+-]*\n)*?[ :|+-]*\+- ([^\n]*)", plan):
        assert "FileScan" not in m.group(1)


def test_history_windows_partition_by_turn_blocks(spark):
    msgs = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    plan = _plan(history_windows(msgs, 3))
    assert re.search(r"hashpartitioning\(conv_id#?\d*L?, _blk", plan)


def test_hit_lookup_shuffles_hit_records_only(spark):
    rows = [(f"c{i:05d}", f"text {i} " * 20) for i in range(3000)]
    records = write_records(spark.createDataFrame(rows, "chunk_id string, text string"), scratch_path(spark, "t-lookup"), "chunk_id", 8)
    hits = spark.createDataFrame([(q, f"c{q * 31:05d}", 1) for q in range(40)] + [(40, "absent", 1), (41, "c00031", 2)],
                                 "qid long, chunk_id string, rank int")
    found = attach_records(hits, records, ("text",), max_rows=42, id_buckets=8)
    got = {(r.qid, r.chunk_id, r.text) for r in found.collect()}
    text = dict(rows)
    assert got == {(r.qid, r.chunk_id, text.get(r.chunk_id)) for r in hits.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan, plan
