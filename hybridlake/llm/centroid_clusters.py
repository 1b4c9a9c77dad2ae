"""Centroid clustering (operator 11): exact k-means on integers with ns-bounds.

Vectors are stored with, per centroid, a lower bound of their distance and the
round in which it was evaluated. The centroids of all rounds are kept. A round
loosens a bound by how far its centroid lies *now* from where it lay when the
bound was evaluated - the norm of the total displacement, which is never more
than the summed drifts of the rounds between - and evaluates anew only what the
loosened bounds don't decide. Evaluations and updates are exact in integers;
the bounds are floating point and leave room for rounding.

Each round is one narrow pass that writes the vectors' new bounds, and a sum of
the vectors that changed their cluster, combined in each task before it is
shuffled. What travels through the driver is the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import discard, stored_at

#: Distances of larger components than this may not fit 64 bits; Python's integers take over.
WIDE = 1 << 27
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class ClusterParams:
    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    #: Components become ``floor(scale * x)``.
    scale: int = 1024
    #: Vectors start as centroids in the order of sha256("seed:id").
    seed: int = 3


def whole(vector: str, params: ClusterParams) -> Column:
    """The integer vector; null unless it has ``dim`` finite components."""
    real = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) == params.dim) & finite,
                  F.transform(real, lambda x: F.floor(x * F.lit(float(params.scale))).cast("long")))


def first_centroids(vectors: DataFrame, params: ClusterParams) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids; of one id, the smallest vector first."""
    name = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.col("vec_id").cast("string")), 256)
    picked = vectors.select(name.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(params.clusters)
    return [list(r["vector"]) for r in picked.collect()]


class History:
    """The centroids of all rounds so far, and how far each lies from where it was."""

    def __init__(self, rounds: list[list[list[int]]]):
        self.rounds = rounds
        self.now = rounds[-1]
        places = np.array(rounds, np.float64)  # (round, centroid, component)
        self.moved = np.sqrt(((places - places[-1]) ** 2).sum(axis=2)) * (1 + 1e-9)

    def distances(self, vectors, centroid: int):
        """Exact squared distances."""
        now = self.now[centroid]
        if vectors.dtype == object or max(map(abs, now), default=0) >= WIDE:
            return ((vectors.astype(object) - np.array(now, object)) ** 2).sum(axis=1)
        gap = vectors - np.array(now, np.int64)
        return np.einsum("ij,ij->i", gap, gap)

    def assign(self, vectors, cluster, bounds, stamps):
        """New clusters and their squared distances; ``bounds`` and ``stamps`` are brought up to date.

        ``cluster`` is -1 where a vector has never been assigned. A distance is
        evaluated for the own centroid, and for others whose bound, loosened,
        is not above it.
        """
        n, k = bounds.shape
        last = len(self.rounds) - 1
        rows = np.arange(n)
        lower = bounds - self.moved[stamps, np.arange(k)]
        upper = np.full(n, np.inf)
        best = np.full(n, -1)
        square = np.zeros(n, vectors.dtype)

        def evaluate(which, centroid):
            """Measures ``which`` rows and keeps the centroid where it is nearer, or as near with a smaller number."""
            if not len(which):
                return
            found = self.distances(vectors[which], centroid)
            root = np.sqrt(found.astype(np.float64))
            bounds[which, centroid] = root * (1 - 1e-9)
            stamps[which, centroid] = last
            nearer = (best[which] < 0) | (found < square[which]) | ((found == square[which]) & (centroid < best[which]))
            at = which[nearer]
            best[at], square[at], upper[at] = centroid, found[nearer], root[nearer] * (1 + 1e-9)

        for c in range(k):
            evaluate(rows[cluster == c], c)
        for c in range(k):
            evaluate(rows[(cluster != c) & (lower[:, c] <= upper)], c)
        return best, square


def _matrix(column: pa.Array, width: int, dtype):
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def _lists(matrix, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()),
                                    pa.array(matrix.ravel(), kind))


def assigned(state: DataFrame, history: History) -> DataFrame:
    """``state`` after one round: ``was`` is the cluster before, ``distance`` is squared."""
    k, names = len(history.now), state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(names, batch.columns))
            vectors = _matrix(columns["vector"], len(history.now[0]), np.int64)
            if np.abs(vectors).max(initial=0) >= WIDE or vectors.min(initial=0) < -WIDE:
                vectors = vectors.astype(object)
            was = columns["cluster"].to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = _matrix(columns["bounds"], k, np.float64).copy()
            stamps = _matrix(columns["stamps"], k, np.int64).copy()
            cluster, distance = history.assign(vectors, was, bounds, stamps)
            if distance.dtype == object:
                distance = np.array([min(d, LONG) for d in distance], np.int64)
            yield pa.RecordBatch.from_arrays(
                [columns["vec_id"], columns["vector"], pa.array(cluster, pa.int32()), pa.array(was, pa.int32()),
                 pa.array(distance, pa.int64()), _lists(bounds, pa.float64()), _lists(stamps, pa.int16())], names=names)

    return state.mapInArrow(run, state.schema)


def moved_sums(state: DataFrame, dim: int) -> dict[tuple[int, int], int]:
    """Change of each (cluster, component)'s sum by the vectors that changed; component -1 is their number.

    Each task hands on one row for a cluster and component, whatever it reads.
    """
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("component", T.IntegerType()),
                           T.StructField("change", T.DecimalType(38, 0))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(0), dim, np.int64)
            if np.abs(vectors).max(initial=0) >= WIDE or vectors.min(initial=0) < -WIDE:
                vectors = vectors.astype(object)
            for column, sign in ((1, 1), (2, -1)):
                cluster = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(cluster[cluster >= 0]).tolist():
                    own = vectors[cluster == c]
                    change = np.append(own.sum(axis=0), len(own)).astype(object) * sign
                    sums[c] = sums[c] + change if c in sums else change
        rows = [(c, i if i < dim else -1, Decimal(int(v))) for c, row in sums.items() for i, v in enumerate(row)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), arrow)], schema=arrow)

    changed = state.where("cluster <> was").select("vector", "cluster", "was")
    found = changed.mapInArrow(run, schema).groupBy("cluster", "component").agg(F.sum("change").alias("change"))
    return {(r["cluster"], r["component"]): int(r["change"]) for r in found.collect()}  # clusters x (dim + 1) rows


def cluster(vectors: DataFrame, params: ClusterParams = ClusterParams(), id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, centroid`` of every vector that has ``dim`` finite components.

    Other rows (null or short vectors, null, NaN or infinite components) have no
    result. Repeated rows each get theirs; a null id stays null and is the last
    to become a centroid; of equal distances the centroid with the smaller
    number wins. With fewer vectors than clusters there are fewer clusters; an
    empty table gives an empty result. Components beyond a long count as the
    nearest long, and so do distances.
    """
    spark = vectors.sparkSession
    schema = T.StructType([
        T.StructField("vec_id", vectors.schema[id_col].dataType), T.StructField("vector", T.ArrayType(T.LongType())),
        T.StructField("cluster", T.IntegerType()), T.StructField("was", T.IntegerType()),
        T.StructField("distance", T.LongType()), T.StructField("bounds", T.ArrayType(T.DoubleType())),
        T.StructField("stamps", T.ArrayType(T.ShortType()))])
    source = vectors.select(F.col(id_col).alias("vec_id"), whole(vector_col, params).alias("vector")).where("vector IS NOT NULL")
    centroids = first_centroids(source, params)
    if not centroids:
        return spark.createDataFrame([], "vec_id " + schema["vec_id"].dataType.simpleString()
                                     + ", cluster int, distance long, centroid array<long>")
    k = len(centroids)
    state = source.select("vec_id", "vector", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(0).cast("long").alias(
        "distance"), F.array_repeat(F.lit(0.0), k).alias("bounds"), F.array_repeat(F.lit(0).cast("short"), k).alias("stamps"))
    state, path, rounds, sums = state.to(schema), None, [centroids], {}
    while True:
        before = path
        state, path = stored_at(assigned(state, History(rounds)), "clusters")
        if before:
            discard(spark, before)
        changes = moved_sums(state, params.dim) if len(rounds) <= params.rounds else {}
        if not changes:  # the last assignment, or one that later rounds would only repeat
            break
        for key, change in changes.items():
            sums[key] = sums.get(key, 0) + change
        rounds.append([[sums[c, i] // sums[c, -1] for i in range(params.dim)] if sums.get((c, -1)) else rounds[-1][c]
                       for c in range(k)])
    centers = spark.createDataFrame(list(enumerate(rounds[-1])), "cluster int, centroid array<long>")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(centers), "cluster").select(
        "vec_id", "cluster", "distance", "centroid")


def with_inertia(clustered: DataFrame) -> DataFrame:
    """``clustered`` with ``cluster_inertia`` and ``inertia``: distances summed over the cluster and over all."""
    each = clustered.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # one row a cluster
    total = sum(r["s"] for r in each)
    sums = clustered.sparkSession.createDataFrame([(r["cluster"], r["s"], total) for r in each],
                                                  "cluster int, cluster_inertia long, inertia long")
    return clustered.join(F.broadcast(sums), "cluster")
