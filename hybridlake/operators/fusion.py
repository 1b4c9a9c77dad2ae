"""Hybrid search: keyword leg + vector leg, normalised and combined.

Each leg returns its top-k per query; scores are min-max normalised per leg
per query over those k rows (max = min -> 1.0), missing from a leg counts 0
with its weight kept, combined by the weighted arithmetic mean, then top-k.
Both legs arrive hash-partitioned by ``qid``, so stacking them, combining per
(query, id) and the final ranking run without another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hybridlake.operators.ann import IVFIndex, ivf_search
from hybridlake.operators.index import SearchIndex, scan_tasks
from hybridlake.operators.keyword import keyword_search
from hybridlake.operators.knn import vector_search
from hybridlake.operators.topk import SCORE_DECIMALS, top_k
from hybridlake.params import SearchParams


def min_max(df: DataFrame, score: str = "score", out: str = "norm", group: str = "qid") -> DataFrame:
    """Per-group min-max: lowest -> 0, highest -> 1, a single value -> 1.

    Scores are normalised after rounding to 9 decimals (the ranking rule), so
    exact copies whose sums differ only in the last bit stay tied instead of
    being stretched to 0 and 1.
    """
    w = Window.partitionBy(group)
    s = F.round(F.col(score), SCORE_DECIMALS)
    mn, mx = F.min(s).over(w), F.max(s).over(w)
    return df.withColumn(out, F.when(mx == mn, F.lit(1.0)).otherwise((s - mn) / (mx - mn)))


def fuse(keyword: DataFrame, vector: DataFrame, params: SearchParams, id_col: str = "chunk_id") -> DataFrame:
    """``keyword``/``vector``: (qid, id, score) top-k legs -> fused top-k.

    The legs are stacked and combined per (query, id) with an aggregate rather
    than a full outer join: both legs are already hash-partitioned by ``qid``
    and the union keeps that, so the aggregate and the final ranking need no
    further exchange.
    """
    none = F.lit(None).cast("double")
    if params.normalization == "min_max":
        kw, vec = min_max(keyword).withColumn("score", F.col("norm")), min_max(vector).withColumn("score", F.col("norm"))
    else:
        kw, vec = keyword, vector
    legs = (kw.select("qid", id_col, F.col("score").alias("keyword_score"), none.alias("vector_score"))
            .unionByName(vec.select("qid", id_col, none.alias("keyword_score"), F.col("score").alias("vector_score"))))
    both = legs.groupBy("qid", id_col).agg(F.max("keyword_score").alias("keyword_score"),
                                           F.max("vector_score").alias("vector_score"))
    wk, wv = params.keyword_weight, params.vector_weight
    combined = (F.lit(wk) * F.coalesce("keyword_score", F.lit(0.0))
                + F.lit(wv) * F.coalesce("vector_score", F.lit(0.0))) / F.lit(wk + wv)
    return top_k(both.withColumn("score", combined), params.top_k, tiebreak=id_col)


def vector_leg(index: SearchIndex, queries: DataFrame, params: SearchParams, ivf: IVFIndex | None = None,
               qvec_col: str = "query_vector") -> DataFrame:
    """The vector hits: exact over the records, or through ``ivf``, an index over the records' vectors."""
    if ivf is None:
        return vector_search(index.records, queries, params, dim=index.dim, id_col=index.id_col, qvec_col=qvec_col, tasks=scan_tasks(index))
    if (ivf.dim, ivf.id_col) != (index.dim, index.id_col):
        raise ValueError("the vector index is not one of these records")
    return ivf_search(ivf, queries, params, qvec_col=qvec_col)


def hybrid_search(index: SearchIndex, queries: DataFrame, params: SearchParams = SearchParams(),
                  text_col: str = "query_text", qvec_col: str = "query_vector", ivf: IVFIndex | None = None) -> DataFrame:
    """``queries(qid, query_text, query_vector)`` -> ``qid, <id>, keyword_score,
    vector_score, score, rank`` (top_k per query); with ``ivf`` the vector leg is approximate."""
    kw = keyword_search(index, queries, params, text_col)
    return fuse(kw, vector_leg(index, queries, params, ivf, qvec_col), params, index.id_col)
