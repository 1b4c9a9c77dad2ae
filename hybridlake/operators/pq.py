"""Compressed vectors: product-quantised codes, table look-ups, exact re-rank.

A vector is cut into equal parts; each part is stored as the number of its
nearest centroid among at most 256 that k-means finds for that part, one byte
instead of the part's floats. A query's distance to a code is a sum of entries
of its look-up tables. The nearest codes of each query are candidates, which
are ranked by their exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridlake.functions.vectors import dimension_ok
from hybridlake.operators.knn import Candidates, _local_top_k, collect_queries, matrix
from hybridlake.operators.topk import RunningTopK, split_passes, settled, top_k
from hybridlake.params import SearchParams


@dataclass(frozen=True)
class PQParams:
    parts: int = 8
    centroids: int = 64
    #: Candidates of a query that are ranked exactly, a multiple of top_k.
    candidates: int = 20
    max_iter: int = 15
    seed: int = 7
    #: Vectors that centroids are fitted on at most, about; every vector is coded and searched.
    max_train_rows: int = 200_000

    def __post_init__(self) -> None:
        if not 1 <= self.centroids <= 256 or self.parts < 1 or self.candidates < 1:
            raise ValueError("parts and candidates must be >= 1, centroids in 1..256")


@dataclass(frozen=True)
class PQIndex:
    codes: DataFrame        # id, code (one byte for each part)
    vectors: DataFrame      # id, embedding: for the exact ranking
    codebooks: np.ndarray   # (parts, centroids, dim / parts)
    dim: int
    id_col: str
    params: PQParams


def build_pq(vectors: DataFrame, params: PQParams = PQParams(), *, dim: int, id_col: str, vec_col: str = "embedding",
             materialize_to: str | None = None) -> PQIndex:
    """Codes of every valid vector. The codebooks (parts x centroids small vectors) are broadcast."""
    if dim % params.parts:
        raise ValueError(f"dim {dim} isn't a multiple of {params.parts} parts")
    width = dim // params.parts
    valid = vectors.where(dimension_ok(vec_col, dim)).select(id_col, F.col(vec_col).alias("embedding"))
    n = valid.count()
    every = max(1, n // params.max_train_rows)
    sample = valid.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).cache()
    books = np.zeros((params.parts, params.centroids, width))
    for part in range(params.parts if n else 0):
        piece = sample.select(array_to_vector(F.slice("embedding", part * width + 1, width)).alias("features"))
        model = KMeans(k=params.centroids, seed=params.seed, maxIter=params.max_iter).fit(piece)
        found = np.array(model.clusterCenters())
        books[part] = found[np.minimum(np.arange(params.centroids), len(found) - 1)]  # fewer distinct parts than centroids
    sample.unpersist()
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([valid.schema[id_col], T.StructField("code", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                _, v = matrix(rb.column(1), dim)
                v = v.reshape(len(v), params.parts, width)
                code = np.stack([((v[:, p, None, :] - shared.value[p][None]) ** 2).sum(2).argmin(1)
                                 for p in range(params.parts)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([c.tobytes() for c in code], pa.binary())], names=schema.names)

    codes = valid.mapInArrow(encode, schema)
    if materialize_to is not None:
        codes.write.mode("overwrite").parquet(materialize_to)
        codes = vectors.sparkSession.read.schema(schema).parquet(materialize_to)
    return PQIndex(codes, valid, books, dim, id_col, params)


def pq_search(pq: PQIndex, queries: DataFrame, params: SearchParams = SearchParams(), qvec_col: str = "query_vector") -> DataFrame:
    """Top-k by L2: ``qid, <id>, score, rank``. Codes give ``candidates x top_k`` candidates a query, exact
    distances their order; a vector that isn't among the candidates is no hit, so the search is approximate."""
    if params.space != "l2":
        raise ValueError("codes approximate L2 distances only")
    spark, id_col, dim, k = queries.sparkSession, pq.id_col, pq.dim, params.top_k
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), pq.codes.schema[id_col],
                           T.StructField("score", T.DoubleType())])
    parts, width, wanted = pq.params.parts, dim // pq.params.parts, pq.params.candidates * k
    found = []
    table_bytes = 8 * parts * pq.params.centroids + 8 * dim + 64  # of a query: its tables, and its vector
    passes = split_passes(queries, queries.count(), table_bytes, params.max_broadcast_bytes)
    for part in passes:
        qids, q = collect_queries(part, dim, qvec_col)
        if not len(qids):
            continue
        tables = ((q.reshape(len(q), parts, 1, width) - pq.codebooks[None]) ** 2).sum(3)  # (query, part, centroid)
        shared = spark.sparkContext.broadcast((qids, tables))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, tables = shared.value
            best = RunningTopK(wanted)
            for rb in batches:
                if not rb.num_rows:
                    continue
                code = np.frombuffer(b"".join(rb.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                ids = rb.column(0).to_numpy(zero_copy_only=False)
                id_rank = np.empty(len(ids), np.int64)
                id_rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                for at in range(0, len(tables), params.query_block):
                    own = tables[at:at + params.query_block]
                    distance = sum(own[:, p][:, code[:, p]] for p in range(parts))
                    qi, bi = _local_top_k(1.0 / (1.0 + distance), id_rank, wanted)
                    if len(qi):
                        best.add(at + qi, rb.column(0).take(pa.array(bi)), 1.0 / (1.0 + distance[qi, bi]))
            yield from best.batches(names, id_col)

        found.append(settled(pq.codes.mapInArrow(near, schema), shared, len(passes), wanted, id_col))
    if not found:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(None).cast("bigint"))
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    candidates = top_k(candidates, wanted, tiebreak=id_col).select("qid", id_col)
    asked = queries.select("qid", F.col(qvec_col).alias("q"))
    pairs = candidates.join(pq.vectors, id_col).join(asked, "qid")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                held = Candidates(rb.column(1), rb.column(2), dim, "l2")
                _, q = matrix(rb.column(3), dim)
                d2 = np.maximum((q * q).sum(1) + held.norm2 - 2.0 * np.einsum("ij,ij->i", q, held.v), 0.0)
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(1.0 / (1.0 + d2))], names=schema.names)

    return top_k(pairs.select("qid", id_col, "embedding", "q").mapInArrow(rank, schema), k, tiebreak=id_col)
