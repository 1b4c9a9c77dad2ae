"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole input tables. Output columns are named exactly as in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridlake.functions.text import analyze, clean_text, preview
from hybridlake.functions.vectors import hash_embedding
from hybridlake.operators.ann import calibrate, ivf_search
from hybridlake.operators.chunking import chunk_records, chunk_text
from hybridlake.operators.fusion import hybrid_search, min_max
from hybridlake.operators.hits import attach_records, search_hits, split_requests
from hybridlake.operators.index import SearchIndex, drop_index, embed_records
from hybridlake.operators.keyword import keyword_search
from hybridlake.operators.knn import vector_search
from hybridlake.operators.listing import list_page, write_listing
from hybridlake.operators.maintenance import apply_update, index_one, update_index
from hybridlake.operators.page_records import ingest_pages
from hybridlake.operators.pq import PQParams, build_pq, pq_search
from hybridlake.operators.prompts import (assemble_answers, attach_context, chat_prompt, context_blocks,
                                          history_windows, tutorial_prompt)
from hybridlake.operators.rag import chat_requests, rag_prompts, rag_requests
from hybridlake.operators.requests import search_requests
from hybridlake.operators.table import (delete_by_ids, delete_by_name, delete_report, ingest_report,
                                        list_records, sample_record, upsert, validate_records)
from hybridlake.operators.topk import OUTPUT_DECIMALS
from hybridlake.params import (QUERY_TOP_K, SEARCH_TOP_K, TEMPERATURE, ChunkParams, EmbedParams, PromptParams, SearchParams)
from hybridlake.plans.corpus import (DRIVER_DIM, DRIVER_EMBED, IVF, corpus_chunks, driver_index, driver_ivf, driver_queries,
                                     own_index)
from hybridlake.session import scratch_path
from hybridlake.sources.pages import assemble_pages
from hybridlake.sources.tables import (benchmark_queries, conversation_pages, corpus_documents, messages,
                                       read_table, text_table)
from hybridlake.streaming.answers import answer_stream
from hybridlake.streaming.ingest import current_view, ingest_into_index, run_ingest

Q = Callable[[SparkSession, str], DataFrame]
SEARCH = SearchParams()                      # top_k 5, l2, min-max, weights 0.3 / 0.7
HISTORY_N = 3                                # driver conversations have <= 8 turns
LIST_LIMIT, LIST_OFFSET = 100, 10
DELETE_NAME = "src3"
ONE_ID = "one-record"
PAGE_CHUNKS = ChunkParams(chunk_size=40, overlap=10)   # driver pages are short


def _r(c: str) -> F.Column:
    return F.round(F.col(c), OUTPUT_DECIMALS).alias(c)


# -- text ---------------------------------------------------------------------

def q_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    d = text_table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", clean_text("text").alias("text"))


def q_chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    d = text_table(spark, sf, "documents", "doc_id", "text")
    return chunk_text(d, "text", ChunkParams(), keep=("doc_id",)).select(
        "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk")


def q_chunk_records(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_chunks(spark, sf).select("chunk_id", "document_name", "chunk_index", "text")


def q_analyze_terms(spark: SparkSession, sf: str) -> DataFrame:
    d = text_table(spark, sf, "documents", "text")
    return (d.select(F.explode(analyze("text")).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def q_page_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return assemble_pages(conversation_pages(spark, sf))


def q_ingest_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Paged documents to an index: records with the page of their first token, as the search finds them."""
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    done = ingest_pages(conversation_pages(spark, sf), DRIVER_EMBED, scratch_path(spark, "page-index"), PAGE_CHUNKS, created_at=stamp)
    return done.index.records.select(
        "chunk_id", "document_name", "page_number", "chunk_index", "text", F.col("metadata")["n_pages"].alias("n_pages"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), F.size("embedding").alias("embedding_dimension"))


def q_page_concat_plain(spark: SparkSession, sf: str) -> DataFrame:
    return assemble_pages(conversation_pages(spark, sf), use_fallback=False, clean=False)


# -- index --------------------------------------------------------------------

def q_postings(spark: SparkSession, sf: str) -> DataFrame:
    return driver_index(spark, sf).postings.select("term", "chunk_id", "tf", "dl")


def q_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return driver_index(spark, sf).term_stats.select("term", "df")


def q_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return driver_index(spark, sf).corpus_stats.select("n_docs", _r("avgdl"))


# -- search -------------------------------------------------------------------

def q_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = keyword_search(driver_index(spark, sf), benchmark_queries(spark, sf), SEARCH)
    return hits.select("qid", "chunk_id", _r("score"), "rank")


def _given_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select("vec_id", "embedding")


def _knn(spark: SparkSession, sf: str, space: str) -> DataFrame:
    p = SearchParams(space=space)
    hits = vector_search(_given_vectors(spark, sf), driver_queries(spark, sf), p, dim=DRIVER_DIM, id_col="vec_id")
    return hits.select("qid", "vec_id", _r("score"), "rank")


def q_knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, "l2")


def q_knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, "cosine")


def q_knn_dirty_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every third vector has a NaN, every fifth a NULL element: those are never hits, and hide none."""
    v = _given_vectors(spark, sf)
    first = (F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 5 == 0, F.lit(None))
             .otherwise(F.col("embedding")[0])).cast("float")
    dirty = F.concat(F.array(first), F.slice("embedding", 2, DRIVER_DIM))
    hits = vector_search(v.select("vec_id", dirty.alias("embedding")), driver_queries(spark, sf), SearchParams(),
                         dim=DRIVER_DIM, id_col="vec_id")
    return hits.select("qid", "vec_id", _r("score"), "rank")


def _ivf(spark: SparkSession, sf: str, trained: bool = False, **how) -> DataFrame:
    hits = ivf_search(driver_ivf(spark, sf, trained=trained), driver_queries(spark, sf), SEARCH, **how)
    return hits.select("qid", "vec_id", _r("score"), "rank")


def q_knn_ivf_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Trained centroids, every cell probed: the exact search."""
    return _ivf(spark, sf, trained=True, nprobe=IVF.n_cells)


def q_knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the cells of given centroids."""
    return _ivf(spark, sf)


def q_knn_ivf_routed(spark: SparkSession, sf: str) -> DataFrame:
    """The same search for a batch that no broadcast would hold: queries and vectors meet by cell."""
    return _ivf(spark, sf, plan="routed")


def q_knn_ivf_trained(spark: SparkSession, sf: str) -> DataFrame:
    """Cells fitted by k-means; as many probed as 0.9 of the exact neighbours need."""
    ivf = calibrate(driver_ivf(spark, sf, trained=True), recall=0.9)
    hits = ivf_search(ivf, driver_queries(spark, sf), SEARCH)
    return hits.select("qid", "vec_id", _r("score"), "rank")


def q_keyword_search_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The plan for large batches."""
    hits = keyword_search(driver_index(spark, sf), benchmark_queries(spark, sf), SEARCH, method="scan")
    return hits.select("qid", "chunk_id", _r("score"), "rank")


def q_keyword_search_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The plan for a few queries, whatever their number."""
    hits = keyword_search(driver_index(spark, sf), benchmark_queries(spark, sf), SEARCH, method="blocks")
    return hits.select("qid", "chunk_id", _r("score"), "rank")


def q_knn_pq(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of 8 bytes find candidates, exact distances rank them."""
    pq = build_pq(_given_vectors(spark, sf), PQParams(), dim=DRIVER_DIM, id_col="vec_id", materialize_to=scratch_path(spark, "pq"))
    return pq_search(pq, driver_queries(spark, sf), SEARCH).select("qid", "vec_id", _r("score"), "rank")


def q_minmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    hits = keyword_search(driver_index(spark, sf), benchmark_queries(spark, sf), SEARCH)
    return min_max(hits).select("qid", "chunk_id", _r("score"), _r("norm"), "rank")


def _hybrid(spark: SparkSession, sf: str, params: SearchParams = SEARCH) -> DataFrame:
    return hybrid_search(driver_index(spark, sf), driver_queries(spark, sf), params)


def q_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf).select("qid", "chunk_id", _r("keyword_score"), _r("vector_score"),
                                     _r("score"), "rank")


def q_hybrid_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """The vector leg probes half of the cells of the records' vectors."""
    h = hybrid_search(driver_index(spark, sf), driver_queries(spark, sf), SEARCH, ivf=driver_ivf(spark, sf, "records"))
    return h.select("qid", "chunk_id", _r("keyword_score"), _r("vector_score"), _r("score"), "rank")


def q_hybrid_raw(spark: SparkSession, sf: str) -> DataFrame:
    h = _hybrid(spark, sf, SearchParams(normalization="none"))
    return h.select("qid", "chunk_id", _r("keyword_score"), _r("vector_score"), _r("score"), "rank")


def _bound(queries: DataFrame, k: int) -> int:
    """Hits are at most top_k per query."""
    return queries.count() * k


def q_search_hits(spark: SparkSession, sf: str) -> DataFrame:
    idx = driver_index(spark, sf)
    h = search_hits(_hybrid(spark, sf), idx.records, max_rows=_bound(benchmark_queries(spark, sf), SEARCH.top_k),
                    id_buckets=idx.id_buckets)
    return h.select("qid", "rank", "chunk_id", "document_name", "text", "score",
                    F.size("metadata").alias("metadata_size"), F.col("metadata")["source"].alias("source"),
                    F.col("metadata")["lang"].alias("lang"),
                    "total", "preview", "score_3")


def q_search_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item asks for its own number of hits; some ask for too few or too many."""
    asked = driver_queries(spark, sf).withColumn("top_k", F.when(F.col("qid") % 25 != 7, F.col("qid") % 25).cast("int"))
    hits, rejected = search_requests(driver_index(spark, sf), asked)
    hits = hits.select("qid", "chunk_id", _r("score"), "rank", F.lit("").alias("reason"))
    return hits.unionByName(rejected.select("qid", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"),
                                            F.lit(0).cast("long").alias("rank"), "reason"))


def q_request_validation(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi, _ = SEARCH_TOP_K
    req = benchmark_queries(spark, sf).withColumn("top_k", F.col("qid"))
    tagged = split_requests(req, {"top_k_out_of_range": ("top_k", lo, hi)})
    return tagged.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def q_query_request_validation(spark: SparkSession, sf: str) -> DataFrame:
    """RAG requests: top_k in 1..10 and temperature in 0..2 (first failing check reported)."""
    req = (benchmark_queries(spark, sf).withColumn("top_k", F.ceil(F.col("qid") / 20))
           .withColumn("temperature", F.col("qid") / 10.0))
    tagged = split_requests(req, {"top_k_out_of_range": ("top_k", QUERY_TOP_K[0], QUERY_TOP_K[1]),
                                  "temperature_out_of_range": ("temperature", TEMPERATURE[0], TEMPERATURE[1])})
    return tagged.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


# -- records ------------------------------------------------------------------

def _doc_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as bulk-index requests, each with its given vector if any."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", "source")
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return d.join(v, "doc_id", "left")


def q_ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Some documents have no vector, and every seventh a vector that is too short."""
    batch = _doc_batch(spark, sf)
    short = F.when(F.col("doc_id") % 7 == 0, F.slice("embedding", 1, DRIVER_DIM - 1)).otherwise(F.col("embedding"))
    return ingest_report(validate_records(batch.withColumn("embedding", short), DRIVER_DIM, id_col="doc_id"))


def _revisions(spark: SparkSession, sf: str) -> DataFrame:
    """A second batch: every labelled document, its text annotated with its labels."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", "source")
    lab = read_table(spark, sf, "labels")
    note = F.concat(F.lit(" [quality="), F.col("quality").cast("string"), F.lit(" toxic="),
                    F.col("toxic").cast("string"), F.lit("]"))
    return d.join(lab, "doc_id").select("doc_id", F.concat("text", note).alias("text"), "source")


def q_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    first = read_table(spark, sf, "documents").select("doc_id", "text", "source")
    current = first.withColumns({"_batch": F.lit(0).cast("long"), "_seq": F.col("doc_id")})
    after = upsert(current, _revisions(spark, sf), 1, id_col="doc_id", seq_col="doc_id")
    return after.select("doc_id", "text", "source", F.col("_batch").alias("batch"))


def q_upsert_in_batch_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """One batch brings three versions of every document, in no order: the last by ``version`` wins."""
    first = read_table(spark, sf, "documents").select("doc_id", "text", "source")
    current = first.withColumns({"_batch": F.lit(0).cast("long"), "_seq": F.lit(0).cast("long")})
    versions = first.withColumn("version", F.explode(F.array(*[F.lit(i).cast("long") for i in (2, 3, 1)])))
    versions = versions.withColumn("text", F.concat("text", F.lit(" v"), F.col("version").cast("string")))
    after = upsert(current, versions, 1, id_col="doc_id", seq_col="version")
    return after.select("doc_id", "text", "source", F.col("_seq").alias("version"))


def q_delete_by_id(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    return delete_by_ids(d, read_table(spark, sf, "labels").select("doc_id"), id_col="doc_id")


def q_delete_by_name(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("document_name"))
    return delete_by_name(d, DELETE_NAME)


def q_delete_report(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select(F.col("source").alias("document_name"))
    return delete_report(d, DELETE_NAME)


def q_list_documents(spark: SparkSession, sf: str) -> DataFrame:
    return list_records(driver_index(spark, sf).records, LIST_LIMIT, LIST_OFFSET, cols=("text",))


def q_list_documents_deep(spark: SparkSession, sf: str) -> DataFrame:
    """A page behind half of the records, from the listing's directory."""
    records = driver_index(spark, sf).records
    root = write_listing(records, scratch_path(spark, "listing"), cols=("text",), range_rows=500)
    return list_page(spark, root, LIST_LIMIT, records.count() // 2)


def q_document_count(spark: SparkSession, sf: str) -> DataFrame:
    return driver_index(spark, sf).records.agg(F.count(F.lit(1)).alias("n"))


def q_sample_document(spark: SparkSession, sf: str) -> DataFrame:
    recs = driver_index(spark, sf).records.select("chunk_id", "document_name", "chunk_index", "text")
    return sample_record(recs)


# -- embeddings ---------------------------------------------------------------

def q_hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    recs = corpus_chunks(spark, sf).select("chunk_id", hash_embedding(analyze("text"), DRIVER_DIM).alias("v"))
    return (recs.select("chunk_id", F.posexplode("v").alias("dim_index", "value"))
            .filter(F.col("value") != 0)
            .select("chunk_id", F.col("dim_index").cast("int").alias("dim_index"),
                    F.round(F.col("value").cast("double"), OUTPUT_DECIMALS).alias("value")))


def q_prefixed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of documents embedded with the asymmetric prefix."""
    d = text_table(spark, sf, "documents", "doc_id", "text")
    e = embed_records(d, EmbedParams(dim=DRIVER_DIM, passage_prefix=True))
    return (e.select("doc_id", F.posexplode("embedding").alias("dim_index", "value")).filter(F.col("value") != 0)
            .select("doc_id", F.col("dim_index").cast("int").alias("dim_index"),
                    F.round(F.col("value").cast("double"), OUTPUT_DECIMALS).alias("value")))


def q_embedding_preview(spark: SparkSession, sf: str) -> DataFrame:
    d = text_table(spark, sf, "documents", "doc_id", "text")
    e = d.select("doc_id", hash_embedding(analyze("text"), DRIVER_DIM).alias("v"))
    return e.select("doc_id", F.size("v").alias("embedding_dimension"),
                    *[F.round(F.col("v")[i].cast("double"), OUTPUT_DECIMALS).alias(f"e{i}") for i in range(10)])


# -- prompts ------------------------------------------------------------------

def _hits_with_text(spark: SparkSession, sf: str, hits: DataFrame, max_rows: int) -> DataFrame:
    idx = driver_index(spark, sf)
    return attach_records(hits, idx.records, ("text",), max_rows=max_rows, id_buckets=idx.id_buckets)


def q_context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    bound = _bound(benchmark_queries(spark, sf), SEARCH.top_k)
    return context_blocks(_hits_with_text(spark, sf, _hybrid(spark, sf), bound), first_label=0)


def q_history_window(spark: SparkSession, sf: str) -> DataFrame:
    return history_windows(messages(spark, sf), HISTORY_N).select("conv_id", "turn", "history")


def _user_requests(spark: SparkSession, sf: str, use_rag: bool) -> DataFrame:
    """Every user message is a request; its history is what came before it."""
    h = history_windows(messages(spark, sf), HISTORY_N)
    return (h.filter(F.col("role") == "user")
            .select(F.concat_ws(":", "conv_id", "turn").alias("qid"), "conv_id", "turn",
                    F.col("text").alias("query_text"), "history", F.lit(use_rag).alias("use_rag")))


def q_chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    req = _user_requests(spark, sf, use_rag=False)
    j = attach_context(req, None)
    return j.select("conv_id", "turn", chat_prompt("query_text", "context", "history", PromptParams()).alias("prompt"))


def q_qa_prompts(spark: SparkSession, sf: str) -> DataFrame:
    req = benchmark_queries(spark, sf)
    ctx = context_blocks(_hits_with_text(spark, sf, _hybrid(spark, sf), _bound(req, SEARCH.top_k)), first_label=1)
    j = req.join(ctx, "qid", "left")
    return j.select("qid", tutorial_prompt("query_text", F.coalesce("context", F.lit(""))).alias("prompt"))


def q_prompt_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Display of a prompt: its length and first 200 characters."""
    p = q_qa_prompts(spark, sf)
    return p.select("qid", F.length("prompt").alias("prompt_length"), preview("prompt", 200).alias("preview"))


def q_text_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Display of extracted text: its cleaned length and first 500 characters."""
    d = text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", clean_text("text").alias("t"))
    return d.select("doc_id", F.length("t").alias("text_length"), preview("t", 500).alias("preview"))


def q_rag_prompts(spark: SparkSession, sf: str) -> DataFrame:
    req = _user_requests(spark, sf, use_rag=True)
    out = rag_prompts(driver_index(spark, sf), req, DRIVER_EMBED)
    return out.select("conv_id", "turn", "prompt")


def q_answer_assembly(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    # Every turn is a fragment slot; only assistant turns carry content, so a
    # conversation without one still appears (with '') and no join is needed.
    frags = m.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"),
                     F.when(F.col("role") == "assistant", F.col("text")).alias("content"))
    return assemble_answers(frags)


def q_answer_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as fragments that arrive in two drops, every fragment of the first one twice."""
    root = scratch_path(spark, "answers")
    turn = Window.partitionBy("conv_id")
    frags = messages(spark, sf).select(
        F.col("conv_id").alias("answer_id"), (F.row_number().over(turn.orderBy("turn")) - 1).alias("seq"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("content"),
        (F.row_number().over(turn.orderBy(F.col("turn").desc())) == 1).alias("last"))
    frags = frags.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    early = F.pmod(F.xxhash64("answer_id", "seq"), F.lit(2)) == 0
    for drop in (frags.where(early), frags.where(early).withColumn("content", F.lit("repeated")).unionByName(frags.where(~early))):
        drop.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(frags.schema).parquet(f"{root}/in")
        q = (answer_stream(stream).writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    return spark.read.schema("answer_id long, answer string, complete boolean").parquet(f"{root}/out")


# -- streaming ----------------------------------------------------------------

def q_streaming_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Two drops of documents arrive one after the other; the current view
    keeps the latest version of every chunk id."""
    root = scratch_path(spark, "stream")
    src, store, ckpt = f"{root}/in", f"{root}/store", f"{root}/checkpoint"
    first = corpus_documents(spark, sf).select("doc_id", "path", "text")
    second = _revisions(spark, sf).select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "text")
    schema = first.schema

    def to_records(df: DataFrame) -> DataFrame:
        recs = chunk_records(df, keep=("_seq",))
        return recs.withColumn("embedding", hash_embedding(analyze("text"), DRIVER_DIM))

    for i, drop in enumerate((first, second)):
        drop.write.mode("overwrite").parquet(f"{src}/drop={i}")
        run_ingest(spark, f"{src}/drop=*", schema, store, ckpt, to_records)
    return current_view(spark, store).select("chunk_id", "document_name", "chunk_index", "text")


def _revised_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return _revisions(spark, sf).select("doc_id", path.alias("path"), "text")


def _search_updated(spark: SparkSession, sf: str, index: SearchIndex) -> DataFrame:
    hits = hybrid_search(index, driver_queries(spark, sf), SEARCH)
    return hits.select("qid", "chunk_id", _r("keyword_score"), _r("vector_score"), _r("score"), "rank")


def q_search_after_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Revised documents replace their chunks; the search sees the new texts and statistics."""
    batch = embed_records(chunk_records(_revised_documents(spark, sf)), DRIVER_EMBED)
    return _search_updated(spark, sf, update_index(driver_index(spark, sf), batch))


def q_search_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of a source's documents go; the search neither finds nor counts them."""
    index = driver_index(spark, sf)
    gone = index.records.where(F.col("document_name").startswith(f"{DELETE_NAME}/")).select("chunk_id")
    return _search_updated(spark, sf, update_index(index, deleted=gone))


def q_search_after_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Revised documents arrive by the stream; the search sees its current view."""
    root = scratch_path(spark, "stream")
    src, store, ckpt = f"{root}/in", f"{root}/store", f"{root}/checkpoint"
    revised = _revised_documents(spark, sf)
    revised.write.parquet(src)
    run_ingest(spark, src, revised.schema, store, ckpt,
               lambda df: embed_records(chunk_records(df, keep=("_seq",)), DRIVER_EMBED))
    return _search_updated(spark, sf, update_index(driver_index(spark, sf), current_view(spark, store)))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of every revised document, in no order; the second is the one that counts."""
    note = F.concat(F.lit(" version "), F.col("version").cast("string"))
    revised = _revised_documents(spark, sf).withColumn("version", F.explode(F.array(F.lit(2), F.lit(1))))
    return revised.withColumn("text", F.concat("text", note))


def q_update_in_batch_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """One update brings two versions of records, and some without an id or a whole vector."""
    records = embed_records(chunk_records(_versions(spark, sf), keep=("version",)), DRIVER_EMBED)
    # the second version comes twice more, without an id and with a short vector: made of the one embedding
    spoilt = F.when(F.col("version") == 2, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    batch = records.withColumn("spoilt", F.explode(spoilt)).withColumns({
        "chunk_id": F.when(F.col("spoilt") != 1, F.col("chunk_id")),
        "embedding": F.when(F.col("spoilt") == 2, F.slice("embedding", 1, 2)).otherwise(F.col("embedding"))}).drop("spoilt")
    index, _ = apply_update(own_index(spark, sf), batch, seq_col="version")
    return _search_updated(spark, sf, index)


def q_search_after_two_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Revised documents arrive, then another version of them; each drop is written into the index."""
    root = scratch_path(spark, "stream")
    versions, index = _versions(spark, sf), own_index(spark, sf)
    for version in (1, 2):
        drop = versions.where(F.col("version") == version).drop("version")
        drop.write.parquet(f"{root}/in/drop={version}")
        index = ingest_into_index(index, f"{root}/in/drop=*", drop.schema, f"{root}/checkpoint",
                                  lambda df: embed_records(chunk_records(df, keep=("_seq",)), DRIVER_EMBED))
    return _search_updated(spark, sf, index)


def q_search_after_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of a source's documents are deleted from the written index."""
    index = own_index(spark, sf)
    gone = index.records.where(F.col("document_name").startswith(f"{DELETE_NAME}/")).select("chunk_id")
    return _search_updated(spark, sf, apply_update(index, deleted=gone)[0])


def q_index_one_search(spark: SparkSession, sf: str) -> DataFrame:
    """One record is put in, with the text of the first benchmark item; the next search sees it."""
    text = benchmark_queries(spark, sf).orderBy("qid").first()["query_text"]
    index = index_one(own_index(spark, sf), {"chunk_id": ONE_ID, "document_name": "one", "chunk_index": 0, "text": text})
    return _search_updated(spark, sf, index)


def q_index_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """A written index is counted, deleted, and deleted once more."""
    index = own_index(spark, sf)
    n = index.records.count()
    dropped = [int(drop_index(spark, index.root)) for _ in range(2)]
    return spark.createDataFrame([("records", n), ("dropped", dropped[0]), ("dropped again", dropped[1])], "step string, n long")


def q_rag_requests_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Chat requests with their own top_k, temperature and switch: some retrieve, some don't, some are out of bounds."""
    req = chat_requests(messages(spark, sf), PromptParams(max_history=HISTORY_N))
    req = req.withColumns({"top_k": F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") % 12).cast("int"),
                           "temperature": F.when(F.col("conv_id") % 7 != 0, (F.col("conv_id") % 25) / 10.0),
                           "use_rag": F.when(F.col("turn") % 4 != 1, F.col("turn") % 4 < 3)})
    prompts, rejected = rag_requests(driver_index(spark, sf), req)
    columns = ("conv_id", "turn", F.col("top_k").cast("int").alias("top_k"), _r("temperature"))
    return prompts.select(*columns, "prompt", F.lit("").alias("reason")).unionByName(
        rejected.select(*columns, F.lit("").alias("prompt"), "reason"))


def q_streaming_in_batch_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of a micro-batch holds two versions of its documents, the later one behind."""
    root = scratch_path(spark, "stream")
    src, store, ckpt = f"{root}/in", f"{root}/store", f"{root}/checkpoint"
    docs = read_table(spark, sf, "documents").select("doc_id", "source")
    both = docs.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    both = both.repartitionByRange("doc_id").sortWithinPartitions("version", "doc_id")  # an id's versions are in one file
    both.write.parquet(src)
    run_ingest(spark, src, both.schema, store, ckpt, lambda df: df)
    return current_view(spark, store, id_col="doc_id").select("doc_id", "source", "version")


QUERIES: dict[str, Q] = {
    "clean_text": q_clean_text,
    "chunk_text": q_chunk_text,
    "chunk_records": q_chunk_records,
    "analyze_terms": q_analyze_terms,
    "page_assembly": q_page_assembly,
    "page_concat_plain": q_page_concat_plain,
    "ingest_pages": q_ingest_pages,
    "postings": q_postings,
    "term_stats": q_term_stats,
    "corpus_stats": q_corpus_stats,
    "keyword_search": q_keyword_search,
    "knn_l2": q_knn_l2,
    "knn_cosine": q_knn_cosine,
    "knn_ivf_all_cells": q_knn_ivf_all_cells,
    "knn_ivf": q_knn_ivf,
    "knn_ivf_routed": q_knn_ivf_routed,
    "knn_pq": q_knn_pq,
    "knn_ivf_trained": q_knn_ivf_trained,
    "keyword_search_scan": q_keyword_search_scan,
    "keyword_search_blocks": q_keyword_search_blocks,
    "hybrid_ivf": q_hybrid_ivf,
    "minmax_scores": q_minmax_scores,
    "hybrid_search": q_hybrid_search,
    "hybrid_raw": q_hybrid_raw,
    "search_hits": q_search_hits,
    "search_requests": q_search_requests,
    "request_validation": q_request_validation,
    "query_request_validation": q_query_request_validation,
    "ingest_report": q_ingest_report,
    "upsert_latest": q_upsert_latest,
    "upsert_in_batch_duplicates": q_upsert_in_batch_duplicates,
    "delete_by_id": q_delete_by_id,
    "delete_by_name": q_delete_by_name,
    "delete_report": q_delete_report,
    "list_documents": q_list_documents,
    "list_documents_deep": q_list_documents_deep,
    "document_count": q_document_count,
    "sample_document": q_sample_document,
    "hash_embedding": q_hash_embedding,
    "embedding_preview": q_embedding_preview,
    "context_blocks": q_context_blocks,
    "history_window": q_history_window,
    "chat_prompts": q_chat_prompts,
    "qa_prompts": q_qa_prompts,
    "prompt_preview": q_prompt_preview,
    "text_preview": q_text_preview,
    "rag_prompts": q_rag_prompts,
    "answer_assembly": q_answer_assembly,
    "answer_stream": q_answer_stream,
    "streaming_ingest": q_streaming_ingest,
    "streaming_in_batch_duplicates": q_streaming_in_batch_duplicates,
    "search_after_upsert": q_search_after_upsert,
    "search_after_delete": q_search_after_delete,
    "search_after_stream": q_search_after_stream,
    "search_after_two_streams": q_search_after_two_streams,
    "search_after_deletes": q_search_after_deletes,
    "update_in_batch_duplicates": q_update_in_batch_duplicates,
    "index_one_search": q_index_one_search,
    "index_lifecycle": q_index_lifecycle,
    "rag_requests_mixed": q_rag_requests_mixed,
    "knn_dirty_vectors": q_knn_dirty_vectors,
    "prefixed_embedding": q_prefixed_embedding,
}
