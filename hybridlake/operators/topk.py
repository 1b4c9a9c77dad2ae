"""Shared top-k and query-batch helpers.

``top_k`` is a ``row_number() <= k`` filter: Catalyst plans it as
``WindowGroupLimit`` (partial, before the exchange) + exchange on the group key
+ ``WindowGroupLimit`` (final), so a group never ships more than k rows per
input partition, however many candidates it has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridlake.session import scratch_path

# Scores are compared after rounding to 9 decimals, then by id ascending: exact
# copies in a corpus tie, and this rule makes every engine pick the same rows.
SCORE_DECIMALS = 9
OUTPUT_DECIMALS = 6


def ranked(group: str, score: str | Column, tiebreak: str) -> Window:
    s = F.col(score) if isinstance(score, str) else score
    return Window.partitionBy(group).orderBy(F.round(s, SCORE_DECIMALS).desc_nulls_last(),
                                             F.col(tiebreak).asc())


def top_k(df: DataFrame, k: int, *, group: str = "qid", score: str = "score",
          tiebreak: str = "chunk_id", rank_col: str = "rank") -> DataFrame:
    r = F.row_number().over(ranked(group, score, tiebreak)).cast("bigint")
    return df.withColumn(rank_col, r).filter(F.col(rank_col) <= k)


def split_passes(queries: DataFrame, n_rows: int, row_bytes: int, max_bytes: int,
                 key: str = "qid") -> list[DataFrame]:
    """Split a query batch into passes whose broadcast stays under ``max_bytes``.

    Each pass is searched against the whole corpus; results are whole (the
    union of all passes), only the broadcast size is bounded.
    """
    passes = max(1, math.ceil(n_rows * row_bytes / max_bytes))
    if passes == 1:
        return [queries]
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(passes))
    return [queries.filter(bucket == i) for i in range(passes)]


class RunningTopK:
    """The k best hits of each query over all batches of a task.

    Held rows are at most k per query, as many that wait to be ranked, and what
    one batch adds; a task hands on k x queries rows however many batches it
    reads. ``start`` has of each query a score that its hits must reach anyway.
    """

    def __init__(self, k: int, start: np.ndarray | None = None):
        self.k, self.start, self.query, self.ids, self.score = k, start, None, None, None
        self.waiting, self.n_waiting, self._floor = [], 0, None

    def add(self, query: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        self.waiting.append((query, ids, score))
        self.n_waiting += len(query)
        if self.query is None or self.n_waiting > len(self.query) // 2:
            self.settle()

    def floor(self, n: int) -> np.ndarray | None:
        """Of queries 0..n-1 a score that a hit must reach: the k-th best ranked so far, or ``start`` where that is
        more, -inf for fewer than k; None before any."""
        if self._floor is None and self.query is not None and len(self.query):
            self._floor = np.full(n, -np.inf)
            last = np.flatnonzero(np.append(self.query[1:] != self.query[:-1], True))
            full = last[np.diff(last, prepend=-1) == self.k]
            self._floor[self.query[full]] = self.score[full]
            if self.start is not None:
                self._floor = np.maximum(self._floor, self.start)
        return self.start if self._floor is None else self._floor

    def settle(self) -> None:
        """Rank what waits together with what is held."""
        if not self.waiting:
            return
        held = [] if self.query is None else [(self.query, self.ids, self.score)]
        query, ids, score = zip(*held, *self.waiting)
        query, ids, score = np.concatenate(query), pa.concat_arrays(ids), np.concatenate(score)
        self.waiting, self.n_waiting, self._floor = [], 0, None
        place = ids.dictionary_encode()
        named = place.dictionary.to_numpy(zero_copy_only=False)
        order_of = np.empty(len(named), np.int64)
        order_of[np.argsort(named, kind="stable")] = np.arange(len(named))
        by_id = order_of[place.indices.to_numpy(zero_copy_only=False)]
        order = np.lexsort((by_id, -np.round(score, SCORE_DECIMALS), query))
        at = query[order]
        order = order[np.arange(len(at)) - np.searchsorted(at, at, side="left") < self.k]
        self.query, self.score, self.ids = query[order], score[order], ids.take(pa.array(order))

    def batches(self, qids: pa.Array, id_col: str):
        self.settle()
        if self.query is not None and len(self.query):
            yield pa.RecordBatch.from_arrays(
                [qids.take(pa.array(self.query)), self.ids, pa.array(self.score, type=pa.float64())],
                names=["qid", id_col, "score"])


def settled(hits: DataFrame, broadcast, passes: int, k: int, id_col: str) -> DataFrame:
    """A pass's hits. Of several passes each is run and written, its top k per
    query, and its broadcast dropped before the next one is made."""
    if passes == 1:
        return hits
    path = scratch_path(hits.sparkSession, "search-pass")
    top_k(hits, k, tiebreak=id_col).drop("rank").write.parquet(path)
    broadcast.destroy()
    return hits.sparkSession.read.schema(hits.schema).parquet(path)
