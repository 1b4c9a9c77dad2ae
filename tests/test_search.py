"""Keyword, vector, IVF and hybrid search: fixtures, equivalences, plan shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridlake.functions.text import analyze
from hybridlake.functions.vectors import hash_embedding
from hybridlake.operators.ann import build_ivf, ivf_search
from hybridlake.operators.fusion import fuse, hybrid_search, min_max
from hybridlake.operators.index import build_index, embed_records
from hybridlake.operators.keyword import keyword_search
from hybridlake.operators.knn import vector_search
from hybridlake.params import EmbedParams, IVFParams, SearchParams
from hybridlake.plans.corpus import driver_index, driver_queries
from hybridlake.session import scratch_path

from conftest import SF_CHECK, SF_SMALL

DIM = 16


def _index(spark, texts, materialize=False):
    recs = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    recs = embed_records(recs, EmbedParams(dim=DIM))
    return build_index(recs, dim=DIM, materialize_to=scratch_path(spark, "t-index") if materialize else None)


def _queries(spark, texts):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, query_text string")
    return q.withColumn("query_vector", hash_embedding(analyze("query_text"), DIM))


def test_keyword_unknown_term_gives_no_rows(spark):
    idx = _index(spark, ["alpha beta", "gamma"])
    assert keyword_search(idx, _queries(spark, ["zeta"]), SearchParams()).count() == 0


@pytest.mark.parametrize("method", ["join", "scan"])
def test_keyword_identical_docs_tie_by_id(spark, method):
    idx = _index(spark, ["red fox", "blue sky", "red fox"], materialize=True)
    rows = keyword_search(idx, _queries(spark, ["fox"]), SearchParams(), method=method).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["c0", "c2"]
    assert rows[0].score == rows[1].score


def test_keyword_join_and_scan_agree_on_driver_data(spark):
    idx = driver_index(spark, SF_SMALL)
    q = driver_queries(spark, SF_SMALL)
    a = sorted((r.qid, r.chunk_id, round(r.score, 9), r.rank) for r in keyword_search(idx, q, method="join").collect())
    b = sorted((r.qid, r.chunk_id, round(r.score, 9), r.rank) for r in keyword_search(idx, q, method="scan").collect())
    assert a == b and len(a) > 0


def test_cosine_zero_vector_is_not_a_hit(spark):
    corpus = spark.createDataFrame([("z", [0.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0])],
                                   "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 1.0])], "qid long, query_vector array<float>")
    rows = vector_search(corpus, q, SearchParams(space="cosine", top_k=5), dim=2).collect()
    assert sorted(r.chunk_id for r in rows) == ["a", "b"]
    l2 = vector_search(corpus, q, SearchParams(space="l2", top_k=5), dim=2).collect()
    assert sorted(r.chunk_id for r in l2) == ["a", "b", "z"]


def test_vector_search_matches_numpy_and_splits_passes(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    qv = rng.normal(size=(37, 8)).astype(np.float32)
    corpus = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, qv[i].tolist()) for i in range(37)], "qid long, query_vector array<float>")
    small = SearchParams(top_k=4, max_broadcast_bytes=2048)  # forces several passes
    got = {(r.qid, r.vec_id) for r in vector_search(corpus, q, small, dim=8, id_col="vec_id").collect()}
    d2 = ((qv[:, None, :].astype(np.float64) - v[None, :, :].astype(np.float64)) ** 2).sum(-1)
    want = {(i, int(j)) for i in range(37) for j in np.argsort(d2[i], kind="stable")[:4]}
    assert got == want


def test_ivf_all_cells_is_exact_and_recall(spark):
    vecs = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").select("vec_id", "embedding")
    q = driver_queries(spark, SF_CHECK)
    ivf = build_ivf(vecs, IVFParams(n_cells=16, nprobe=8), dim=64, id_col="vec_id")
    exact = {(r.qid, r.vec_id) for r in vector_search(vecs, q, SearchParams(top_k=10), dim=64, id_col="vec_id").collect()}
    full = {(r.qid, r.vec_id) for r in ivf_search(ivf, q, SearchParams(top_k=10), nprobe=16).collect()}
    assert full == exact
    approx = {(r.qid, r.vec_id) for r in ivf_search(ivf, q, SearchParams(top_k=10), nprobe=8).collect()}
    recall = len(approx & exact) / len(exact)
    assert recall >= 0.6, recall


def test_min_max_rules(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (1, "c", 3.0), (2, "x", 7.0)],
                               "qid long, chunk_id string, score double")
    out = {(r.qid, r.chunk_id): r.norm for r in min_max(df).collect()}
    assert out == {(1, "a"): 0.0, (1, "b"): 1.0, (1, "c"): 0.5, (2, "x"): 1.0}


def test_fusion_missing_leg_counts_zero_with_weight(spark):
    kw = spark.createDataFrame([(1, "a", 5.0), (1, "b", 1.0)], "qid long, chunk_id string, score double")
    vec = spark.createDataFrame([(1, "b", 0.9)], "qid long, chunk_id string, score double")
    rows = {r.chunk_id: r for r in fuse(kw, vec, SearchParams()).collect()}
    assert rows["a"].score == pytest.approx(0.3)          # keyword 1.0, vector missing
    assert rows["b"].score == pytest.approx(0.7)          # keyword 0.0, vector single hit -> 1.0
    assert rows["b"].rank == 1 and rows["a"].rank == 2


def test_batched_hybrid_equals_single_query_runs(spark):
    idx = driver_index(spark, SF_SMALL)
    q = driver_queries(spark, SF_SMALL)
    batch = {(r.qid, r.chunk_id, r.rank) for r in hybrid_search(idx, q).collect()}
    singles = set()
    for qid in (0, 7, 13):
        singles |= {(r.qid, r.chunk_id, r.rank) for r in hybrid_search(idx, q.filter(F.col("qid") == qid)).collect()}
    assert singles <= batch


def test_plans_have_group_limit_and_no_pair_join(spark):
    idx = driver_index(spark, SF_SMALL)
    q = driver_queries(spark, SF_SMALL)
    for df in (keyword_search(idx, q, method="join"), keyword_search(idx, q, method="scan"),
               vector_search(idx.records, q, dim=64), hybrid_search(idx, q)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_model_encoder_hook_and_prefix(spark):
    from hybridlake.functions.text import with_passage_prefix
    from hybridlake.functions.vectors import model_embedding

    class Lengths:
        def encode(self, texts):
            return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("ab c",), ("",)], "t string")
    rows = df.select(model_embedding(with_passage_prefix("t", True), Lengths, 2).alias("v")).collect()
    assert [list(r.v) for r in rows] == [[13.0, 2.0], [9.0, 1.0]]


def test_keyword_scan_with_forced_passes_matches_join(spark):
    from hybridlake.operators.keyword import keyword_search_batch
    idx = driver_index(spark, SF_SMALL)
    q = driver_queries(spark, SF_SMALL)
    a = sorted((r.qid, r.chunk_id, r.rank) for r in keyword_search(idx, q, method="join").collect())
    tiny = SearchParams(max_broadcast_bytes=20_000)  # several query passes
    b = sorted((r.qid, r.chunk_id, r.rank) for r in keyword_search_batch(idx, q, tiny).collect())
    assert a == b


def test_vectors_with_nan_or_null_hide_no_hits(spark):
    from hybridlake.functions.vectors import dimension_ok
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(100 + i, [float("nan"), 1.0]) for i in range(6)]
    rows += [(200, [None, 1.0]), (201, [float("inf"), 0.0]), (202, [1.0])]
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [float("nan"), 0.0])], "qid string, query_vector array<double>")
    hits = vector_search(corpus.coalesce(1), queries, SearchParams(top_k=5), dim=2).collect()
    assert [(h.qid, h.chunk_id) for h in sorted(hits, key=lambda h: h.rank)] == [("a", i) for i in range(5)]
    ok = corpus.where(dimension_ok("embedding", 2)).count()
    assert ok == 20


@pytest.mark.parametrize("method", ["join", "scan"])
def test_any_type_of_request_id(spark, method):
    from hybridlake.operators.index import build_index, embed_records
    from hybridlake.params import EmbedParams
    recs = spark.createDataFrame([(f"c{i}", f"word{i} shared") for i in range(30)], "chunk_id string, text string")
    index = build_index(embed_records(recs, EmbedParams(dim=8)), dim=8)
    queries = spark.createDataFrame([("1:1000", "word3 shared"), ("2:0", "word7 shared")], "qid string, query_text string")
    top = {h.qid: h.chunk_id for h in keyword_search(index, queries, SearchParams(top_k=1), method=method).collect()}
    assert top == {"1:1000": "c3", "2:0": "c7"}


def test_a_task_hands_on_its_best_hits_only(spark):
    import numpy as np
    import pyarrow as pa

    from hybridlake.operators.topk import RunningTopK
    rng, best, rows = np.random.default_rng(1), RunningTopK(3), []
    for _ in range(20):
        q, s = rng.integers(0, 4, 50), rng.integers(0, 9, 50) / 3
        ids = [f"i{x}" for x in rng.integers(0, 10 ** 6, 50)]
        rows += list(zip(q.tolist(), (-s).tolist(), ids))
        best.add(q, pa.array(ids), s)
    out = pa.Table.from_batches(best.batches(pa.array(["a", "b", "c", "d"]), "id")).to_pylist()
    want = [("abcd"[q], i) for k in range(4) for q, _, i in sorted(r for r in rows if r[0] == k)[:3]]
    assert [(r["qid"], r["id"]) for r in out] == want and len(out) == 12


def test_passes_run_one_after_the_other(spark):
    rows = [(i, [float(i), 1.0]) for i in range(50)]
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "qid int, query_vector array<double>")
    one = vector_search(corpus, queries, SearchParams(top_k=2), dim=2)
    many = vector_search(corpus, queries, SearchParams(top_k=2, max_broadcast_bytes=500), dim=2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
