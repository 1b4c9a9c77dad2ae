"""Vector leg: exact k-nearest-neighbour search.

Exact search costs Q x N distance evaluations whatever the engine; what we
control is what moves. The query batch (size-checked, split into passes above
``max_broadcast_bytes``) is broadcast once; every corpus partition scores its
Arrow batches against it with one matrix product per query block and emits only
its local top-k per query. No pair (query, vector) is ever materialised as a
row, the corpus is never shuffled, and the final top-k runs on at most
k x partitions rows per query.

Scores increase with similarity: L2 -> 1 / (1 + d^2); cosine -> (1 + cos) / 2
(a zero vector has no cosine and is never a hit).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hybridlake.operators.topk import SCORE_DECIMALS, RunningTopK, settled, split_passes, top_k
from hybridlake.params import SearchParams


def matrix(vecs: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a valid vector, float64 matrix of those rows)."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    lens = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy(zero_copy_only=False)
    ok = lens == dim
    if not ok.all():
        vecs = vecs.filter(pa.array(ok))
    flat = pc.list_flatten(vecs).to_numpy(zero_copy_only=False)
    return ok, flat.astype(np.float64, copy=False).reshape(-1, dim)


def _scores(qb: np.ndarray, qn2: np.ndarray, v: np.ndarray, vn2: np.ndarray, space: str) -> np.ndarray:
    dot = qb @ v.T
    if space == "cosine":
        return (1.0 + dot) / 2.0
    d2 = np.maximum(qn2[:, None] + vn2[None, :] - 2.0 * dot, 0.0)
    return 1.0 / (1.0 + d2)


def _local_top_k(s: np.ndarray, id_rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, column) of each query's k best columns, ties by id order."""
    r = np.round(s, SCORE_DECIMALS)
    nb = r.shape[1]
    kk = min(k, nb)
    thr = np.partition(r, nb - kk, axis=1)[:, nb - kk]
    # Keep everything within 1e-9 of the k-th score so a rounding difference
    # between engines can never drop a row the final ranking would keep.
    cand = (r >= thr[:, None] - 10.0 ** -SCORE_DECIMALS) & np.isfinite(r)
    qi, bi = np.nonzero(cand)
    keep = _first_k(qi, bi, r[qi, bi], id_rank, k)
    return qi[keep], bi[keep]


def _first_k(qi: np.ndarray, bi: np.ndarray, rounded: np.ndarray, id_rank: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best (query row, column) pairs, ties by id order."""
    order = np.lexsort((id_rank[bi], -rounded, qi))
    at = qi[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at, side="left") < k]


class Candidates:
    """The rows of a batch that have a vector of the dimension: their ids, places, vectors, and which of them
    are valid. NaN, infinite or NULL elements, and a zero vector by cosine, are never a hit."""

    def __init__(self, ids: pa.Array, vecs: pa.Array, dim: int, space: str):
        ok, v = matrix(vecs, dim)
        self.places = np.flatnonzero(ok)
        self.ids = ids if ok.all() else ids.filter(pa.array(ok))
        self.valid = np.isfinite(v).all(axis=1)
        self.v = np.where(self.valid[:, None], v, 0.0)
        if space == "cosine":
            norm = np.sqrt((self.v * self.v).sum(axis=1))
            self.valid &= norm > 0
            self.v = self.v / np.where(self.valid, norm, 1.0)[:, None]
        self.norm2 = (self.v * self.v).sum(axis=1)


#: Scores (queries x vectors) that a task holds at a time.
SCORE_CELLS = 1 << 21
#: Vectors that give queries their first k-th score, by which the next ones are passed over.
FIRST_VECTORS = 1024
#: Share of a block's pairs that reach their query's k-th score, above which all its pairs are scored in full.
DENSE_SHARE = 0.05
#: Vectors of greater squared norm are compared in float64.
NARROW_NORM2 = 1e15


def local_hits(best: RunningTopK, held: Candidates, q: np.ndarray, rows: np.ndarray, space: str, k: int, block: int) -> None:
    """Score the queries ``q[rows]`` against the batch, a block of them at a time; each one's k best go to ``best``.

    Pairs that stay below the k-th score that their query has reached already
    are told by one product in float32, with room for its rounding; only the
    others are scored.
    """
    if not len(held.v) or not len(rows):
        return
    names = held.ids.to_numpy(zero_copy_only=False)
    id_rank = np.empty(len(names), dtype=np.int64)
    id_rank[np.argsort(names, kind="stable")] = np.arange(len(names))
    at = 0
    while at < len(names):
        floor = best.floor(len(q))
        bounded = floor is not None and np.isfinite(floor[rows]).any()
        to = len(names) if bounded else min(len(names), at + max(FIRST_VECTORS, k))
        _local_hits(best, held, slice(at, to), id_rank[at:to], q, rows, floor if bounded else None, space, k, block)
        at = to


def _local_hits(best: RunningTopK, held: Candidates, part: slice, id_rank: np.ndarray, q: np.ndarray, rows: np.ndarray,
                floor: np.ndarray | None, space: str, k: int, block: int) -> None:
    v, norm2, invalid = held.v[part], held.norm2[part], ~held.valid[part]
    out_q, out_i, out_s = [], [], []
    block = max(1, min(block, SCORE_CELLS // len(v)))
    if floor is not None:
        greatest = float(norm2.max())
        narrow = np.float32 if max(greatest, float((q[rows] * q[rows]).sum(axis=1).max())) < NARROW_NORM2 else np.float64
        # a pair's product is q . v - |v|^2 / 2 (l2) or q . v (cosine): greater for greater scores
        wide = np.concatenate([v, (-0.5 * norm2 if space == "l2" else np.zeros(len(v)))[:, None]], axis=1).astype(narrow)
    for at in range(0, len(rows), block):
        own = rows[at:at + block]
        qb = q[own]
        qn2 = (qb * qb).sum(axis=1)
        if floor is not None and np.isfinite(floor[own]).all():
            least = floor[own] - 10.0 ** -SCORE_DECIMALS
            with np.errstate(divide="ignore"):
                need = 2.0 * least - 1.0 if space == "cosine" else (qn2 + 1.0 - 1.0 / np.maximum(least, 0.0)) / 2.0
            room = 4.0 * (q.shape[1] + 4) * np.finfo(narrow).eps * (np.sqrt(qn2 * greatest) + greatest / 2.0 + np.abs(need) + 1e-30)
            with np.errstate(invalid="ignore"):
                need = np.where(np.isfinite(need), need - room, -np.inf).astype(narrow)
            product = np.concatenate([qb, np.ones((len(qb), 1))], axis=1).astype(narrow) @ wide.T
            reach = product >= need[:, None]
            if invalid.any():
                reach[:, invalid] = False
            cells = np.flatnonzero(reach)
            if len(cells) <= DENSE_SHARE * reach.size:
                qi, bi = cells // len(v), cells % len(v)
                s = np.empty(len(cells))
                step = max(1, SCORE_CELLS // q.shape[1])
                for i in range(0, len(cells), step):
                    a, b = qi[i:i + step], bi[i:i + step]
                    dot = np.einsum("ij,ij->i", qb[a], v[b])
                    s[i:i + step] = (1.0 + dot) / 2.0 if space == "cosine" else 1.0 / (
                        1.0 + np.maximum(qn2[a] + norm2[b] - 2.0 * dot, 0.0))
                keep = _first_k(qi, bi, np.round(s, SCORE_DECIMALS), id_rank, k)
                out_q.append(own[qi[keep]])
                out_i.append(bi[keep])
                out_s.append(s[keep])
                continue
        s = _scores(qb, qn2, v, norm2, space)
        s[:, invalid] = -np.inf
        qi, bi = _local_top_k(s, id_rank, k)
        out_q.append(own[qi])
        out_i.append(bi)
        out_s.append(s[qi, bi])
    bi = np.concatenate(out_i)
    if len(bi):
        best.add(np.concatenate(out_q), held.ids.take(pa.array(bi + part.start)), np.concatenate(out_s))


def _search_fn(bq, id_col: str, dim: int, k: int, space: str, block: int):
    def fn(batches):
        qids, q = bq.value
        best, rows = RunningTopK(k), np.arange(len(q))
        for rb in batches:
            local_hits(best, Candidates(rb.column(0), rb.column(1), dim, space), q, rows, space, k, block)
        yield from best.batches(qids, id_col)
    return fn


def collect_queries(queries: DataFrame, dim: int, vec_col: str = "query_vector",
                    space: str = "l2") -> tuple[pa.Array, np.ndarray]:
    """Bring one (size-checked) query pass to the driver: ids, in their own type, and a matrix.
    A query vector that is no vector of ``dim`` finite numbers has no hits."""
    tbl = queries.select("qid", vec_col).toArrow()
    qids = tbl.column("qid").combine_chunks()
    if tbl.num_rows == 0:
        return qids, np.zeros((0, dim))
    ok, q = matrix(tbl.column(vec_col), dim)
    keep = np.isfinite(q).all(axis=1)
    if space == "cosine":
        nq = np.sqrt((np.where(keep[:, None], q, 0.0) ** 2).sum(axis=1))
        keep &= nq > 0
        q = q / np.where(keep, nq, 1.0)[:, None]
    return qids.filter(pa.array(ok)).filter(pa.array(keep)), q[keep]


def vector_search(corpus: DataFrame, queries: DataFrame, params: SearchParams = SearchParams(), *,
                  dim: int, id_col: str = "chunk_id", vec_col: str = "embedding",
                  qvec_col: str = "query_vector", tasks: int | None = None) -> DataFrame:
    """Top-k neighbours, exactly: ``qid, <id>, score, rank``. The corpus is scanned by ``tasks`` tasks at most."""
    spark = corpus.sparkSession
    n_rows = queries.count()
    row_bytes = dim * 8 + 64
    slim = corpus.select(id_col, vec_col)
    slim = slim.coalesce(tasks) if tasks else slim
    out_schema = StructType([StructField("qid", queries.schema["qid"].dataType),
                             StructField(id_col, slim.schema[id_col].dataType), StructField("score", DoubleType())])
    results = []
    passes = split_passes(queries, n_rows, row_bytes, params.max_broadcast_bytes)
    for part in passes:
        qids, q = collect_queries(part, dim, qvec_col, params.space)
        if len(qids) == 0:
            continue
        bq = spark.sparkContext.broadcast((qids, q))
        fn = _search_fn(bq, id_col, dim, params.top_k, params.space, params.query_block)
        results.append(settled(slim.mapInArrow(fn, out_schema), bq, len(passes), params.top_k, id_col))
    if not results:
        return spark.createDataFrame([], out_schema).withColumn("rank", F.lit(None).cast("bigint"))
    return top_k(reduce(DataFrame.unionByName, results), params.top_k, tiebreak=id_col)
