"""Shared plan pieces for the registered queries: the chunk corpus built from
``documents``, the query batch built from ``benchmark``, and the search index
(built once per session and input folder, materialised in the lineage folder).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridlake.functions.vectors import dimension_ok
from hybridlake.operators.ann import IVFIndex, build_ivf
from hybridlake.operators.chunking import chunk_records
from hybridlake.operators.index import SearchIndex, build_index, embed_queries
from hybridlake.params import ChunkParams, EmbedParams, IVFParams
from hybridlake.session import scratch_path
from hybridlake.sources.tables import benchmark_queries, corpus_documents, read_table

# The driver's vectors have 64 values; the built-in encoder uses the same size
# so that its query vectors can search the given embeddings too.
DRIVER_DIM = 64
DRIVER_EMBED = EmbedParams(dim=DRIVER_DIM)

_INDEX_CACHE: dict[tuple, SearchIndex] = {}


def corpus_chunks(spark: SparkSession, sf_dir: str, chunk: ChunkParams = ChunkParams()) -> DataFrame:
    return chunk_records(corpus_documents(spark, sf_dir), params=chunk, metadata=("source", "lang"))


def encoded_queries(queries: DataFrame, embed: EmbedParams = DRIVER_EMBED,
                    text_col: str = "query_text") -> DataFrame:
    return embed_queries(queries, embed, text_col)


def driver_queries(spark: SparkSession, sf_dir: str, embed: EmbedParams = DRIVER_EMBED) -> DataFrame:
    return encoded_queries(benchmark_queries(spark, sf_dir), embed)


def driver_index(spark: SparkSession, sf_dir: str, chunk: ChunkParams = ChunkParams(),
                 embed: EmbedParams = DRIVER_EMBED) -> SearchIndex:
    key = (spark.sparkContext.applicationId, sf_dir, chunk, embed)
    if key not in _INDEX_CACHE:
        _INDEX_CACHE[key] = build_index(corpus_chunks(spark, sf_dir, chunk), dim=embed.dim, embed=embed,
                                        materialize_to=scratch_path(spark, "index"))
    return _INDEX_CACHE[key]


def own_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """An index like the driver's, to be updated in place."""
    return build_index(corpus_chunks(spark, sf_dir), dim=DRIVER_EMBED.dim, embed=DRIVER_EMBED,
                       materialize_to=scratch_path(spark, "own-index"))


#: Cells of the registered approximate searches, and how many of them a query probes.
IVF = IVFParams(n_cells=16, nprobe=8)

_IVF_CACHE: dict[tuple, IVFIndex] = {}


def given_centers(vectors: DataFrame, id_col: str, n: int, dim: int) -> np.ndarray:
    """The vectors whose ids have the smallest md5: centroids that SQL can name too."""
    order = F.md5(F.col(id_col).cast("string").cast("binary"))
    rows = vectors.where(dimension_ok("embedding", dim)).orderBy(order, id_col).limit(n).select("embedding").collect()
    return np.array([r["embedding"] for r in rows], np.float64).reshape(-1, dim)


def driver_ivf(spark: SparkSession, sf_dir: str, of: str = "embeddings", trained: bool = False) -> IVFIndex:
    """IVF index over the given vectors or the ``records`` of the driver's index, with given or trained centroids."""
    key = (spark.sparkContext.applicationId, sf_dir, of, trained)
    if key not in _IVF_CACHE:
        vectors, id_col = ((read_table(spark, sf_dir, "embeddings"), "vec_id") if of == "embeddings"
                           else (driver_index(spark, sf_dir).records, "chunk_id"))
        centers = None if trained else given_centers(vectors, id_col, IVF.n_cells, DRIVER_DIM)
        _IVF_CACHE[key] = build_ivf(vectors, IVF, dim=DRIVER_DIM, id_col=id_col, centers=centers,
                                    materialize_to=scratch_path(spark, "ivf"))
    return _IVF_CACHE[key]
