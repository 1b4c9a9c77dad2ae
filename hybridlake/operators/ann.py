"""Approximate vector search: an inverted-file (IVF) index.

Every vector is stored with its cell, the nearest of a set of centroids that
MLlib's ``KMeans`` fits (on a bounded sample of a large corpus) or the caller
gives. A query is routed to its ``nprobe`` nearest cells and is scored against
the vectors of those cells only: one matrix product for each cell, with the
queries that probe it. ``nprobe = n_cells`` gives exactly the exact search.

Two plans give the same hits. A query batch within the broadcast budget goes to
every task, which reads only the probed cells' folders. A larger one is routed
as rows and meets the vectors by (cell, part of the cell, part of the queries);
the parts bound what one task holds, so a crowded cell or one that most queries
probe is split, and the corpus is read once whatever the number of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridlake.functions.vectors import dimension_ok
from hybridlake.operators.knn import Candidates, collect_queries, local_hits, matrix, vector_search
from hybridlake.operators.topk import SCORE_DECIMALS, RunningTopK, top_k
from hybridlake.params import IVFParams, SearchParams


@dataclass(frozen=True)
class IVFIndex:
    vectors: DataFrame   # id, embedding, cell
    centers: np.ndarray  # (n_cells, dim); its bytes are bounded by IVFParams.max_center_bytes
    dim: int
    id_col: str
    space: str
    nprobe: int
    recall: float | None = None  # measured by ``calibrate`` at ``nprobe``


def n_cells_for(n_vectors: int, dim: int, params: IVFParams) -> int:
    """Square root of the number of vectors, as far as the centroids' bytes allow."""
    wanted = params.n_cells or max(1, round(math.sqrt(n_vectors)))
    return max(1, min(wanted, n_vectors, params.max_center_bytes // (8 * dim)))


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1))
    return v / np.where(norm > 0, norm, 1.0)[:, None]


def nearest_cells(v: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each vector, nearest first; equal distances by cell number."""
    d2 = (v * v).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2.0 * v @ centers.T
    return np.argsort(np.round(d2, SCORE_DECIMALS), axis=1, kind="stable")[:, :n]


def _fit(vectors: DataFrame, n_vectors: int, n_cells: int, id_col: str, vec_col: str, space: str, params: IVFParams) -> np.ndarray:
    """k-means centroids of at most about ``max_train_rows`` vectors, taken by a hash of their ids."""
    every = max(1, n_vectors // params.max_train_rows)
    sample = vectors if every == 1 else vectors.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)
    src = F.col(vec_col)
    if space == "cosine":
        norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
        src = F.transform(vec_col, lambda x: x.cast("double") / norm)
    model = KMeans(k=n_cells, seed=params.seed, maxIter=params.max_iter, featuresCol="features", predictionCol="cell").fit(
        sample.select(array_to_vector(src).alias("features")))
    return np.array(model.clusterCenters(), dtype=np.float64)


def assign_cells(vectors: DataFrame, centers, dim: int, vec_col: str, space: str) -> DataFrame:
    """``vectors`` with ``cell``; ``centers`` is broadcast."""
    schema = T.StructType([*vectors.schema, T.StructField("cell", T.IntegerType())])
    at = vectors.columns.index(vec_col)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                _, v = matrix(rb.column(at), dim)
                cell = nearest_cells(_unit(v) if space == "cosine" else v, centers.value, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cell, pa.int32())], names=schema.names)

    return vectors.mapInArrow(fn, schema)


def build_ivf(vectors: DataFrame, params: IVFParams = IVFParams(), *, dim: int, id_col: str, vec_col: str = "embedding",
              space: str = "l2", materialize_to: str | None = None, centers: np.ndarray | None = None) -> IVFIndex:
    """Every valid vector with its cell; without ``centers`` they are fitted."""
    valid = vectors.filter(dimension_ok(vec_col, dim)).select(id_col, vec_col)
    if space == "cosine":
        valid = valid.filter(F.exists(vec_col, lambda x: x != 0))
    if centers is None:
        n = valid.count()
        centers = _fit(valid, n, n_cells_for(n, dim, params), id_col, vec_col, space, params) if n else np.zeros((1, dim))
    centers = np.asarray(centers, np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast(centers)
    assigned = assign_cells(valid, shared, dim, vec_col, space)
    if materialize_to is not None:
        # One folder per cell; REBALANCE lets AQE split a crowded cell over
        # several tasks instead of every task writing a file into every cell.
        assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(materialize_to)
        assigned = vectors.sparkSession.read.schema(assigned.schema).parquet(materialize_to)
    return IVFIndex(assigned, centers, dim, id_col, space, min(params.nprobe, len(centers)))


def _by_cell(cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, rows) of an array of cells."""
    order = np.argsort(cells, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(cells[order]) != 0)) if len(cells) else []
    for a, b in zip(starts, [*starts[1:], len(cells)]):
        yield int(cells[order[a]]), order[a:b]


def _broadcast_search(ivf: IVFIndex, qids: pa.Array, q: np.ndarray, probes: np.ndarray, params: SearchParams,
                      schema: T.StructType) -> DataFrame:
    """The routed batch in every task; only the probed cells are read."""
    queries_of = {cell: rows // probes.shape[1] for cell, rows in _by_cell(probes.ravel())}
    scan = ivf.vectors.select(ivf.id_col, "embedding", "cell")
    if len(queries_of) < len(ivf.centers):
        scan = scan.filter(F.col("cell").isin(sorted(queries_of)))
    shared = ivf.vectors.sparkSession.sparkContext.broadcast((qids, q, queries_of))
    dim, space, k, id_col, block = ivf.dim, ivf.space, params.top_k, ivf.id_col, params.query_block

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, queries_of = shared.value
        best = RunningTopK(k)
        for rb in batches:
            cells = pc.fill_null(rb.column(2), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for cell, rows in _by_cell(cells):
                if cell in queries_of:
                    take = pa.array(rows)
                    held = Candidates(rb.column(0).take(take), rb.column(1).take(take), dim, space)
                    local_hits(best, held, q, queries_of[cell], space, k, block)
        yield from best.batches(names, id_col)

    return scan.mapInArrow(fn, schema)


def _routed_search(ivf: IVFIndex, queries: DataFrame, nprobe: int, params: SearchParams, qvec_col: str,
                   schema: T.StructType) -> DataFrame:
    """Queries and vectors meet by (cell, part of its vectors, part of its queries)."""
    spark, dim, space, id_col, k, block = (ivf.vectors.sparkSession, ivf.dim, ivf.space, ivf.id_col, params.top_k,
                                           params.query_block)
    centers = spark.sparkContext.broadcast(ivf.centers)
    source = queries.select("qid", F.col(qvec_col).alias("query_vector"))
    routed_schema = T.StructType([*source.schema, T.StructField("cell", T.IntegerType())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            held = Candidates(rb.column(0), rb.column(1), dim, space)
            rows = np.flatnonzero(held.valid)
            if not len(rows):
                continue
            cells = nearest_cells(held.v[rows], centers.value, nprobe)
            at = pa.array(held.places[np.repeat(rows, cells.shape[1])])
            yield pa.RecordBatch.from_arrays([rb.column(0).take(at), rb.column(1).take(at), pa.array(cells.ravel(), pa.int32())],
                                             names=routed_schema.names)

    routed = source.mapInArrow(route, routed_schema)

    def parts(df: DataFrame, rows: int, name: str) -> DataFrame:
        """Number of parts of each cell (at most n_cells rows)."""
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias(name))

    vector_parts = parts(ivf.vectors, params.cell_rows, "vs")
    query_parts = parts(routed, params.cell_queries, "qs")
    both = vector_parts.join(query_parts, "cell")
    both = F.broadcast(spark.createDataFrame(both.collect(), "cell int, vs int, qs int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(both, "cell").select(
        "qid", "query_vector", "cell", every("vs").alias("v_part"), F.pmod(F.xxhash64("qid"), "qs").cast("int").alias("q_part"))
    right = ivf.vectors.join(both, "cell").select(
        id_col, "embedding", "cell", F.pmod(F.xxhash64(id_col), "vs").cast("int").alias("v_part"), every("qs").alias("q_part"))

    def score(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        best = RunningTopK(k)
        if queries.num_rows and vectors.num_rows:
            asked = Candidates(queries.column("qid").combine_chunks(), queries.column("query_vector"), dim, space)
            held = Candidates(vectors.column(id_col).combine_chunks(), vectors.column("embedding"), dim, space)
            local_hits(best, held, asked.v, np.flatnonzero(asked.valid), space, k, block)
            found = list(best.batches(asked.ids, id_col))
            if found:
                return pa.Table.from_batches(found)
        return empty

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    keys = ("cell", "v_part", "q_part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def ivf_search(ivf: IVFIndex, queries: DataFrame, params: SearchParams = SearchParams(), *, nprobe: int | None = None,
               qvec_col: str = "query_vector", plan: str = "auto") -> DataFrame:
    """Top-k over the probed cells only: ``qid, <id>, score, rank``.

    ``plan`` is ``"broadcast"``, ``"routed"`` or ``"auto"``, by the bytes of the
    query batch. A query that is no vector of finite numbers has no hits.
    """
    if params.space != ivf.space:
        raise ValueError(f"index built for {ivf.space}, search asks for {params.space}")
    nprobe = min(nprobe or ivf.nprobe, len(ivf.centers))
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType),
                           T.StructField(ivf.id_col, ivf.vectors.schema[ivf.id_col].dataType), T.StructField("score", T.DoubleType())])
    if plan == "auto":
        size = queries.count() * (8 * (ivf.dim + nprobe) + 64)
        plan = "broadcast" if size <= params.max_broadcast_bytes else "routed"
    if plan == "routed":
        return top_k(_routed_search(ivf, queries, nprobe, params, qvec_col, schema), params.top_k, tiebreak=ivf.id_col)
    qids, q = collect_queries(queries, ivf.dim, qvec_col, params.space)
    if not len(qids):
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(None).cast("bigint"))
    hits = _broadcast_search(ivf, qids, q, nearest_cells(q, ivf.centers, nprobe), params, schema)
    return top_k(hits, params.top_k, tiebreak=ivf.id_col)


def calibrate(ivf: IVFIndex, recall: float = 0.9, k: int = 10, every: int = 100, max_queries: int = 1000) -> IVFIndex:
    """``ivf`` with the least ``nprobe`` that finds ``recall`` of the exact ``k`` nearest neighbours of every
    ``every``-th vector (by a hash of its id; fewer of them where that makes more than about ``max_queries``),
    itself left out, and with the recall measured there.

    A neighbour is found once its cell is probed, so one exact search gives the
    recall of every number of probes.
    """
    n = ivf.vectors.count()
    every = max(1, min(every, n // 20), n // max_queries)
    asked = ivf.vectors.where(F.pmod(F.xxhash64(ivf.id_col), F.lit(every)) == 0).select(
        F.col(ivf.id_col).alias("qid"), F.col("embedding").alias("query_vector"))
    qids, q = collect_queries(asked, ivf.dim, space=ivf.space)
    if not len(qids):
        return replace(ivf, nprobe=len(ivf.centers), recall=1.0)
    exact = vector_search(ivf.vectors, asked, SearchParams(top_k=k + 1, space=ivf.space), dim=ivf.dim, id_col=ivf.id_col)
    exact = exact.where(F.col("qid") != F.col(ivf.id_col)).select("qid", ivf.id_col)  # at most k + 1 rows a query
    cells = F.broadcast(exact).join(ivf.vectors.select(ivf.id_col, "cell"), ivf.id_col).select("qid", "cell").toArrow()
    row = pc.index_in(cells.column("qid"), value_set=qids).to_numpy()
    order = nearest_cells(q, ivf.centers, len(ivf.centers))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    found = place[row, cells.column("cell").to_numpy()]
    shares = np.cumsum(np.bincount(found, minlength=len(ivf.centers))) / max(1, len(found))
    nprobe = int(np.searchsorted(shares, min(recall, shares[-1]))) + 1
    return replace(ivf, nprobe=nprobe, recall=float(shares[nprobe - 1]))
