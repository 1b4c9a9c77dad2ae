"""Index build: the keyword and vector tables a search reads.

``postings(term, chunk_id, tf, dl)``, ``term_stats(term, df)``,
``corpus_stats(n_docs, avgdl)`` and the records with their vectors. Tokenising
is done once per build; with ``materialize_to`` the tables are written as
Parquet in the shared lineage folder and read back, so searches never
re-tokenise the corpus and lineage stays short.

Written postings come in blocks, one row for up to ``BLOCK_POSTINGS`` postings
of a term in the order of their BM25 contribution, with the greatest term
frequency and the least length in the block. These bound what any posting of
the block adds to a score, whatever the corpus statistics have become since.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridlake.functions.text import analyze, with_passage_prefix
from hybridlake.functions.vectors import hash_embedding, model_embedding, term_counts
from hybridlake.params import BM25Params, EmbedParams
from hybridlake.session import remove_path


@dataclass(frozen=True)
class SearchIndex:
    records: DataFrame      # chunk_id, document_name, chunk_index, text, metadata, embedding, terms
    postings: DataFrame     # term, chunk_id, tf, dl
    term_stats: DataFrame   # term, df
    corpus_stats: DataFrame  # n_docs, avgdl (one row)
    dim: int
    id_col: str = "chunk_id"
    term_buckets: int | None = None   # set when postings are laid out by term bucket
    id_buckets: int | None = None     # set when records are laid out by id bucket
    blocks: DataFrame | None = None   # term, n, max_tf, min_dl, ids, tfs, dls; what postings is read from
    root: str | None = None           # folder of the written tables
    embed: EmbedParams | None = None  # what the records were embedded with, kept for queries


def embed_records(records: DataFrame, params: EmbedParams, text_col: str = "text",
                  out_col: str = "embedding") -> DataFrame:
    """Attach ``terms`` (the analysed text, kept for keyword scoring) and the
    encoder's vector (of the prefixed text when the flag is on)."""
    with_terms = records.withColumn("terms", analyze(text_col))
    if params.encoder is not None:
        vector = model_embedding(with_passage_prefix(text_col, params.passage_prefix), params.encoder, params.dim)
        return with_terms.withColumn(out_col, vector)
    src = analyze(with_passage_prefix(text_col, True)) if params.passage_prefix else F.col("terms")
    return with_terms.withColumn(out_col, hash_embedding(src, params.dim))


def embed_queries(queries: DataFrame, params: EmbedParams, text_col: str = "query_text") -> DataFrame:
    """Attach ``query_vector``: the encoder applied to the (optionally prefixed)
    query text; the keyword leg keeps the unprefixed text."""
    src = with_passage_prefix(text_col, params.passage_prefix)
    vector = hash_embedding(analyze(src), params.dim) if params.encoder is None else model_embedding(src, params.encoder, params.dim)
    return queries.withColumn("query_vector", vector)


def build_postings(records: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(term, id, tf, dl)``. A chunk's terms all sit in its own row, so term
    frequencies are counted per row (in Arrow batches): no shuffle."""
    terms_col = F.col("terms") if "terms" in records.columns else analyze(text_col)
    terms = records.select(id_col, terms_col.alias("terms"))
    exploded = terms.select(id_col, F.size("terms").cast("int").alias("dl"),
                            F.explode(term_counts("terms")).alias("p"))
    return exploded.select(F.col("p.term").alias("term"), id_col, F.col("p.tf").alias("tf"), "dl")


# Postings and term statistics are laid out in directories by term bucket, so a
# search for a few terms reads only their buckets (partition pruning). The
# bucket count grows with the corpus: about one per CHUNKS_PER_BUCKET records.
CHUNKS_PER_BUCKET = 1000
MIN_BUCKETS, MAX_BUCKETS = 8, 4096


def bucket_count(n_records: int) -> int:
    return int(min(MAX_BUCKETS, max(MIN_BUCKETS, n_records // CHUNKS_PER_BUCKET)))


# Records are laid out by a hash bucket of their id, one bucket per this many
# input bytes, so a hit lookup reads only the buckets holding hits.
INPUT_BYTES_PER_ID_BUCKET = 64 * 1024 * 1024


def input_bytes(df: DataFrame) -> int:
    """Size of the files a DataFrame reads, as its plan knows it (no call per
    file); 0 when it reads none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    relations = (leaves.apply(i) for i in range(leaves.size()))
    return sum(int(str(r.stats().sizeInBytes())) for r in relations if r.nodeName() == "LogicalRelation")


def id_bucket_count(df: DataFrame) -> int:
    return int(min(MAX_BUCKETS, max(MIN_BUCKETS, input_bytes(df) // INPUT_BYTES_PER_ID_BUCKET)))


def term_bucket(term: str | F.Column = "term", buckets: int = MIN_BUCKETS) -> F.Column:
    t = F.col(term) if isinstance(term, str) else term
    return F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")


#: Records that a task of a scan for a query batch has at least, where all cores have some: every task searches and
#: hands on its own best for every query, however few records it has.
TASK_RECORDS = 1 << 15


def scan_tasks(index: SearchIndex) -> int:
    """Tasks that scan the records of ``index`` for a query batch, at most."""
    n = index.corpus_stats.select("n_docs").first()[0]
    cores = index.records.sparkSession.sparkContext.defaultParallelism
    return cores * max(2, -(-n // (cores * TASK_RECORDS)))  # as many for each core


def build_term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def build_corpus_stats(records: DataFrame, text_col: str = "text") -> DataFrame:
    dl = F.size(F.col("terms") if "terms" in records.columns else analyze(text_col))
    return records.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(dl).cast("double").alias("avgdl"))


#: Of records and posting blocks, the most of what a build writes.
COMPRESSION = "zstd"
#: Postings of one block.
BLOCK_POSTINGS = 128


def impact(tf: Column | str, dl: Column | str, avgdl: float, bm25: BM25Params = BM25Params()) -> Column:
    """What a posting adds to a score, but for its term's weight."""
    tf, dl = (F.col(c) if isinstance(c, str) else c for c in (tf, dl))
    return tf / (tf + F.lit(bm25.k1) * (F.lit(1.0 - bm25.b) + F.lit(bm25.b) * dl / F.lit(avgdl or 1.0)))


#: Postings of one gathered row at most, so that a batch of such rows stays small.
GATHERED_POSTINGS = 512


def gather_postings(records: DataFrame, id_col: str = "chunk_id", pack: bool = False) -> DataFrame:
    """``term, ids, tfs, dls``: the postings of ``records(id, terms)`` by term, of one Arrow batch of records each.

    A term that many records have makes a row for the batch instead of one for
    each record, so what is dealt out and sorted afterwards is far less. To be
    dealt out, lists of ids that are strings are best packed: ``term, joined,
    numbers, wide``, the ids one behind the other and each one's length, tf and
    dl in two bytes (four where ``wide``).
    """
    ints = T.ArrayType(T.IntegerType())
    packed = pack and isinstance(records.schema[id_col].dataType, T.StringType)
    columns = (("joined", T.StringType()), ("numbers", T.BinaryType()), ("wide", T.BooleanType())) if packed else (
        ("ids", T.ArrayType(records.schema[id_col].dataType)), ("tfs", ints), ("dls", ints))
    schema = T.StructType([T.StructField("term", T.StringType()), *(T.StructField(n, t) for n, t in columns)])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, terms = rb.column(0), rb.column(1)
            found = pc.dictionary_encode(pc.list_flatten(terms))
            if not len(found):
                continue
            dl = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
            code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            key, tf = np.unique(code * rb.num_rows + row, return_counts=True)
            code, row = key // rb.num_rows, key % rb.num_rows
            starts = _cuts(code, GATHERED_POSTINGS)
            offsets = np.append(starts, len(code)).astype(np.int32)
            term = found.dictionary.take(pa.array(code[starts]))
            if packed:
                own = _packed(ids.take(pa.array(row)), tf, dl[row], offsets)
            else:
                lists = (ids.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl[row], pa.int32()))
                own = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in lists]
            yield pa.RecordBatch.from_arrays([term if term.type == pa.string() else term.cast(pa.string()), *own], names=schema.names)

    return records.select(id_col, "terms").mapInArrow(fn, schema)


def _packed(ids: pa.Array, tf: np.ndarray, dl: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """``joined, numbers, wide`` of lists that begin at ``offsets``."""
    n = len(offsets) - 1
    ids = ids if ids.type == pa.string() else ids.cast(pa.string())
    ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)
    numbers = np.stack([np.diff(ends), tf, dl], axis=1)
    wide = bool(numbers.max() >= 1 << 16)
    each = 12 if wide else 6
    return [pa.StringArray.from_buffers(n, pa.py_buffer(ends[offsets]), ids.buffers()[2]),
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * each).astype(np.int32)),
                                                   pa.py_buffer(numbers.astype(np.uint32 if wide else np.uint16))]),
            pa.array(np.full(n, wide))]


def _unpacked(joined: pa.Array, numbers: pa.Array, wide: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Postings of each row of ``_packed`` lists, and their ids, tfs and dls."""
    joined, numbers = (x if x.type == t else x.cast(t) for x, t in ((joined, pa.string()), (numbers, pa.binary())))
    n, is_wide = len(joined), wide.to_numpy(zero_copy_only=False).astype(bool)
    ends = np.frombuffer(numbers.buffers()[1], np.int32, n + 1, 4 * numbers.offset)
    data = np.frombuffer(numbers.buffers()[2], np.uint8)
    if not is_wide.any():
        values = data[ends[0]:ends[-1]].view(np.uint16).reshape(-1, 3).astype(np.int32)
    else:
        values = np.concatenate([data[a:b].view(np.uint32 if w else np.uint16).reshape(-1, 3).astype(np.int32)
                                 for a, b, w in zip(ends[:-1], ends[1:], is_wide)])
    first = np.frombuffer(joined.buffers()[1], np.int32, 1, 4 * joined.offset)[0]
    at = np.append(0, np.cumsum(values[:, 0], dtype=np.int64)) + first
    ids = pa.StringArray.from_buffers(len(values), pa.py_buffer(at.astype(np.int32)), joined.buffers()[2])
    return np.diff(ends) // np.where(is_wide, 12, 6), ids, values[:, 1], values[:, 2]


def _cuts(groups: np.ndarray, most: int) -> np.ndarray:
    """Where each run of equal ``groups`` begins, and every ``most`` places within it."""
    n = len(groups)
    new = np.append(True, groups[1:] != groups[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.flatnonzero((np.arange(n) - first) % most == 0)


def single_postings(postings: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``postings(term, id, tf, dl, ...)`` in the columns of ``gather_postings``, a row each."""
    lists = {"ids": F.array(id_col), "tfs": F.array("tf"), "dls": F.array("dl")}
    return postings.select("term", *[v.alias(k) for k, v in lists.items()], *[c for c in postings.columns if c == "term_bucket"])


def build_blocks(gathered: DataFrame, id_col: str, avgdl: float, buckets: int, bm25: BM25Params = BM25Params(), gone=None) -> DataFrame:
    """Blocks of ``gathered(term_bucket, term, ids, tfs, dls)``, or of packed lists.

    With ``gone``, a broadcast list of ids, ``gathered`` are blocks that lie by
    bucket, sorted by term in each file: they aren't dealt out, and are cut
    anew without these ids.

    REBALANCE lets AQE split a hot bucket (a very common term) over several
    tasks and merge small ones; each task then cuts its sorted postings, so no
    term is gathered anywhere. It begins with a partition for each bucket:
    with fewer, every part of a split partition would write a file into each
    of its buckets, and files would grow with the square of the input.
    """
    ints = T.ArrayType(T.IntegerType())
    packed = "joined" in gathered.columns
    schema = T.StructType([
        gathered.schema["term_bucket"], gathered.schema["term"], T.StructField("n", T.IntegerType()),
        T.StructField("max_tf", T.IntegerType()), T.StructField("min_dl", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.StringType()) if packed else gathered.schema["ids"].dataType),
        T.StructField("tfs", ints), T.StructField("dls", ints)])
    lists = ("joined", "numbers", "wide") if packed else ("ids", "tfs", "dls")
    dealt = gathered.select("term_bucket", "term", *lists)
    if gone is None:
        dealt = dealt.hint("rebalance", buckets, "term_bucket")
        dealt = dealt.sortWithinPartitions("term_bucket", "term", F.col("joined") if packed else F.col("ids")[0])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n = rb.num_rows
            if not n:
                continue
            term = rb.column(1)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if packed:
                held, ids, tf, dl = _unpacked(*rb.columns[2:5])
            else:
                held = pc.list_value_length(rb.column(2)).to_numpy(zero_copy_only=False)
                ids, tf, dl = pc.list_flatten(rb.column(2)), *(
                    pc.list_flatten(rb.column(i)).to_numpy(zero_copy_only=False) for i in (3, 4))
            row = np.repeat(np.arange(n), held)
            if gone is not None:
                stays = pc.invert(pc.is_in(ids, value_set=gone.value.cast(ids.type)))
                places = stays.to_numpy(zero_copy_only=False)
                ids, tf, dl, row = ids.filter(stays), tf[places], dl[places], row[places]
                if not len(row):
                    continue
            group = np.cumsum(new)[row]
            weight = tf / (tf + bm25.k1 * ((1.0 - bm25.b) + bm25.b * dl / (avgdl or 1.0)))
            order = np.lexsort((-weight, group))  # stable: equal ones stay by row
            tf, dl, row = tf[order], dl[order], row[order]
            starts = _cuts(group[order], BLOCK_POSTINGS)
            offsets = pa.array(np.append(starts, len(order)), pa.int32())
            at = pa.array(row[starts])
            yield pa.RecordBatch.from_arrays(
                [rb.column(0).take(at), term.take(at), pa.array(np.diff(np.append(starts, len(order))), pa.int32()),
                 pa.array(np.maximum.reduceat(tf, starts), pa.int32()), pa.array(np.minimum.reduceat(dl, starts), pa.int32()),
                 *(pa.ListArray.from_arrays(offsets, x) for x in (
                     ids.take(pa.array(order)), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())))],
                names=schema.names)

    cut = dealt.mapInArrow(fn, schema)
    return cut if gone is None else cut.sortWithinPartitions("term_bucket", "term")


def postings_of(blocks: DataFrame, id_col: str) -> DataFrame:
    """``term, id, tf, dl, term_bucket`` of every posting."""
    each = blocks.select("term", "term_bucket", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    return each.select("term", F.col("p.ids").alias(id_col), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), "term_bucket")


def sum_of_stats(bucket_stats: DataFrame) -> DataFrame:
    """``n_docs, avgdl`` from each id bucket's ``n, total``."""
    n, total = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))
    return bucket_stats.agg(n.alias("n_docs"), F.when(n > 0, total / n).otherwise(0.0).cast("double").alias("avgdl"))


def write_records(records: DataFrame, path: str, id_col: str, id_buckets: int, embed: EmbedParams | None = None,
                  text_col: str = "text", mode: str = "overwrite") -> DataFrame:
    """Laid out by id bucket: rebalanced, so no bucket is a hot task; sorted by id inside for hit lookups. Records
    with their ``id_bucket`` lie by it already and aren't dealt out.

    Records without vectors are embedded by ``embed`` where they have been
    dealt to: their terms and vectors, most of a record's bytes, aren't shuffled.
    """
    laid = records
    if "id_bucket" not in records.columns:
        laid = records.withColumn("id_bucket", term_bucket(id_col, id_buckets)).hint("rebalance", "id_bucket")
    if embed is not None and "embedding" not in records.columns:
        laid = embed_records(laid, embed, text_col)
    laid = laid.select(*[c for c in laid.columns if c != "id_bucket"], "id_bucket")
    laid.sortWithinPartitions("id_bucket", id_col).write.mode(mode).option("compression", COMPRESSION).partitionBy(
        "id_bucket").parquet(path)
    return records.sparkSession.read.schema(laid.schema).parquet(path)


def write_blocks(gathered: DataFrame, root: str, id_col: str, avgdl: float, buckets: int, mode: str = "overwrite", gone=None) -> DataFrame:
    """``blocks`` below ``root``, by term bucket."""
    if "term_bucket" not in gathered.columns:
        gathered = gathered.withColumn("term_bucket", term_bucket("term", buckets))
    blocks = build_blocks(gathered, id_col, avgdl, buckets, gone=gone)
    blocks.write.mode(mode).option("compression", COMPRESSION).partitionBy("term_bucket").parquet(f"{root}/blocks")
    return gathered.sparkSession.read.schema(blocks.schema).parquet(f"{root}/blocks")


def write_term_stats(blocks: DataFrame, root: str, buckets: int) -> DataFrame:
    """``term_stats`` below ``root``, by term bucket, of written blocks."""
    stats = blocks.groupBy("term", "term_bucket").agg(F.sum("n").alias("df"))
    stats.hint("rebalance", buckets, "term_bucket").write.mode("overwrite").partitionBy("term_bucket").parquet(f"{root}/term_stats")
    return blocks.sparkSession.read.schema(stats.schema).parquet(f"{root}/term_stats")


def write_postings(gathered: DataFrame, root: str, id_col: str, avgdl: float, buckets: int) -> tuple[DataFrame, DataFrame]:
    """``blocks`` and ``term_stats`` below ``root``, by term bucket, of postings as ``gather_postings`` gives them."""
    blocks = write_blocks(gathered, root, id_col, avgdl, buckets)
    return blocks, write_term_stats(blocks, root, buckets)


def bucket_stats(records: DataFrame) -> DataFrame:
    """``id_bucket, n, total`` (records, terms) of written records: at most MAX_BUCKETS rows."""
    return records.groupBy("id_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).cast("long").alias("total"))


def build_index(records: DataFrame, *, dim: int, id_col: str = "chunk_id", text_col: str = "text",
                materialize_to: str | None = None, embed: EmbedParams | None = None) -> SearchIndex:
    """Index of ``records``; those without vectors are embedded by ``embed``."""
    bare = embed is not None and "embedding" not in records.columns
    if bare and materialize_to is None:
        records = embed_records(records, embed, text_col)
    elif "terms" not in records.columns and not bare:
        records = records.withColumn("terms", analyze(text_col))
    if materialize_to is None:
        postings = build_postings(records, id_col, text_col)
        return SearchIndex(records, postings, build_term_stats(postings),
                           build_corpus_stats(records, text_col), dim, id_col, embed=embed)
    spark = records.sparkSession
    root = materialize_to.rstrip("/")
    # One pass over the documents: clean, chunk, analyse, embed, write.
    id_buckets = id_bucket_count(records)
    r = write_records(records, f"{root}/records", id_col, id_buckets, embed, text_col)
    stats = bucket_stats(r)
    stats.coalesce(1).write.mode("overwrite").parquet(f"{root}/bucket_stats")
    n_docs, avgdl = sum_of_stats(spark.read.schema(stats.schema).parquet(f"{root}/bucket_stats")).first()
    buckets = bucket_count(n_docs)
    blocks, term_stats = write_postings(gather_postings(r, id_col, pack=True), root, id_col, avgdl, buckets)
    schemas = {name: df.schema.json() for name, df in (("records", r), ("blocks", blocks), ("term_stats", term_stats),
                                                       ("bucket_stats", stats))}
    encoder, prefix = (embed.encoder_name, embed.passage_prefix) if embed else (None, None)
    spark.createDataFrame([(dim, id_col, buckets, id_buckets, encoder, prefix, schemas)], _META).coalesce(1).write.mode(
        "overwrite").parquet(f"{root}/meta")
    return open_index(spark, root, embed)


_META = ("dim int, id_col string, term_buckets int, id_buckets int, encoder string, passage_prefix boolean, "
         "schemas map<string,string>")


def open_index(spark: SparkSession, root: str, embed: EmbedParams | None = None) -> SearchIndex:
    """The written index below ``root`` as it is now. ``embed`` must be what its records were embedded with."""
    m = spark.read.schema(_META).parquet(f"{root}/meta").first()
    if embed is not None and m["encoder"] is not None and (embed.dim, embed.encoder_name, embed.passage_prefix) != (
            m["dim"], m["encoder"], m["passage_prefix"]):
        raise ValueError(f"the index was embedded by {m['encoder']!r} (dim {m['dim']}, prefix {m['passage_prefix']}), "
                         f"not by {embed.encoder_name!r} (dim {embed.dim}, prefix {embed.passage_prefix})")

    def table(name: str) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(m["schemas"][name]))).parquet(f"{root}/{name}")

    blocks = table("blocks")
    return SearchIndex(table("records"), postings_of(blocks, m["id_col"]), table("term_stats").select("term", "df", "term_bucket"),
                       sum_of_stats(table("bucket_stats")), m["dim"], m["id_col"], m["term_buckets"], m["id_buckets"],
                       blocks, root, embed)


def drop_index(spark: SparkSession, root: str) -> bool:
    """Delete a written index if it is there; whether it was."""
    return remove_path(spark, root)


def encoder_of(index: SearchIndex, embed: EmbedParams | None) -> EmbedParams:
    """What embeds queries for ``index``: its own encoder; another one is refused."""
    if index.embed is None:
        if embed is None:
            raise ValueError("the index doesn't say how its records were embedded: give the encoder")
        return embed
    if embed is not None and (embed.dim, embed.encoder_name, embed.passage_prefix) != (
            index.embed.dim, index.embed.encoder_name, index.embed.passage_prefix):
        raise ValueError(f"queries embedded by {embed.encoder_name!r} can't search records embedded by {index.embed.encoder_name!r}")
    return index.embed
