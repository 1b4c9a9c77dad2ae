"""Pages to chunk records with their page numbers, without a document in one row.

The chunks are those that ``assemble_pages`` and ``chunk_records`` make of the
joined, twice cleaned text; here no row, group or window holds more of a
document than a page or a chunk.

A page is cut at *safe* breaks: blanks, tabs and line breaks that follow
neither a hyphen nor the page's start. Cleaning treats what lies on either side
of one independently, so the tokens between a page's first and last safe break
are final. What is left, the head and the tail of each page, is glued to its
neighbours': from one page's last safe break to the next one's first, across
pages that have none. The numbers of tokens of these parts, added up in order,
give every token its place in the document; a chunk takes its tokens from the
parts its window overlaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridlake.functions.text import BLANK_RUN, HYPHEN_BREAK, LONE_NEWLINE, NEWLINE_RUN, record_id, record_name
from hybridlake.operators.index import SearchIndex, build_index, embed_records
from hybridlake.operators.maintenance import apply_update
from hybridlake.operators.table import validate_records
from hybridlake.params import ChunkParams, EmbedParams
from hybridlake.session import scratch_path
from hybridlake.sources.pages import page_contribution

SAFE = r"[ \t]|(?<=[^\-\n])\n++"
#: Whitespace that is stripped from both ends of a document.
EDGE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
HEAD = rf"(?s)\A(.*?(?:{SAFE}))"
TAIL = rf"(?s)\A.*(?:{SAFE})(.*)\z"


def _tokens(text: Column) -> Column:
    """Final tokens of a stretch between safe breaks: both cleanings but for the strip, split at blanks."""
    for _ in range(2):
        text = F.regexp_replace(text, HYPHEN_BREAK, "$1$2")
        text = F.regexp_replace(F.regexp_replace(text, LONE_NEWLINE, " "), NEWLINE_RUN, "\n")
        text = F.regexp_replace(text, BLANK_RUN, " ")
    return F.array_remove(F.split(text, " ", -1), "")


def _trimmed(pages: DataFrame) -> DataFrame:
    """Pages without the whitespace at both ends of their document."""
    solid = F.when(F.col("t").rlike(rf"(?s)[^\t-\r\x1c-\x20\x85\p{{Z}}]"), F.col("page_number"))
    ends = pages.groupBy("document_name").agg(F.min(solid).alias("first"), F.max(solid).alias("last"))
    held = pages.join(ends, "document_name")
    text = F.when(F.col("page_number").between(F.col("first"), F.col("last")), F.col("t")).otherwise("")
    text = F.when(F.col("page_number") == F.col("first"), F.regexp_replace(text, rf"\A{EDGE}+", "")).otherwise(text)
    text = F.when(F.col("page_number") == F.col("last"), F.regexp_replace(text, rf"(?<!{EDGE}){EDGE}++\z", "")).otherwise(text)
    return held.select("document_name", "page_number", text.alias("t"))


def page_parts(pages: DataFrame, use_fallback: bool = True) -> DataFrame:
    """``document_name, page_number, broken, head, body, tail``: a page's text by its safe breaks, ``body`` as
    tokens. A page without one is all ``head``."""
    t = F.coalesce(page_contribution(use_fallback), F.lit(""))
    cut = _trimmed(pages.select("document_name", "page_number", t.alias("t")))
    broken = F.col("t").rlike(SAFE)
    head = F.when(broken, F.regexp_extract("t", HEAD, 1)).otherwise(F.col("t"))
    tail = F.when(broken, F.regexp_extract("t", TAIL, 1)).otherwise("")
    cut = cut.select("document_name", "page_number", "t", broken.alias("broken"), head.alias("head"), tail.alias("tail"))
    body = F.substring("t", F.length("head") + 1, F.greatest(F.lit(0), F.length("t") - F.length("head") - F.length("tail")))
    return cut.withColumn("body", F.when(F.col("broken"), _tokens(body)).otherwise(F.array().cast("array<string>"))).drop("t")


def token_runs(parts: DataFrame) -> DataFrame:
    """``document_name, unit, tokens, starts``: stretches of tokens in document order by ``unit``; ``starts``
    lists (page, number of the page's first token in the stretch)."""
    order = Window.partitionBy("document_name").orderBy("page_number")
    narrow = parts.select("document_name", "page_number", "broken", "head", "tail")
    before = F.coalesce(F.sum(F.col("broken").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = narrow.withColumn("k", before)
    bodies = parts.select("document_name", "page_number", "broken", "body").where("broken")
    bodies = bodies.join(placed.select("document_name", "page_number", "k"), ["document_name", "page_number"])
    start = lambda page, at: F.struct(page.alias("page"), at.cast("int").alias("at"))
    bodies = bodies.select("document_name", (2 * F.col("k") + 1).alias("unit"), F.col("body").alias("tokens"),
                           F.array(start(F.col("page_number"), F.lit(0))).alias("starts"))
    # the page's head ends the glue that the break before it began; its tail begins the next one
    glued = placed.select("document_name", "page_number", F.explode(F.array(
        F.struct(F.col("k").alias("k"), F.lit(0).alias("side"), F.col("head").alias("text")),
        F.struct((F.col("k") + 1).alias("k"), F.lit(1).alias("side"), F.when(F.col("broken"), F.col("tail")).alias("text")))).alias("p"))
    glued = glued.where(F.col("p.text").isNotNull()).groupBy("document_name", F.col("p.k").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("page_number", "p.side", "p.text"))).alias("parts"))
    upto = lambda n: F.array_join(F.transform(F.slice("parts", 1, n), lambda x: x["text"]), "")
    starts = F.transform("parts", lambda x, i: F.struct(x["page_number"].alias("page"), F.size(_tokens(upto(i))).alias("at")))
    glued = glued.select("document_name", (2 * F.col("k")).alias("unit"), _tokens(upto(F.size("parts"))).alias("tokens"),
                         starts.alias("starts"))
    return bodies.unionByName(glued)


def page_records(pages: DataFrame, params: ChunkParams = ChunkParams(), use_fallback: bool = True,
                 created_at: Column | None = None) -> DataFrame:
    """``pages(document_name, page_number, page_text, page_error, image_texts)`` -> records ``chunk_id,
    document_name, page_number, chunk_index, text, metadata, created_at``.

    A chunk's page is the one on which its first token starts. A document
    without any text gives one empty chunk without a page; a document name loses
    ``.pdf``; ``metadata`` tells the number of pages. Page numbers order a
    document's pages and are unique in it.
    """
    spark = pages.sparkSession
    where = scratch_path(spark, "page-parts")
    page_parts(pages, use_fallback).write.parquet(f"{where}/parts")
    parts = spark.read.parquet(f"{where}/parts")
    token_runs(parts).withColumn("n", F.size("tokens").cast("long")).write.parquet(f"{where}/runs")
    runs = spark.read.parquet(f"{where}/runs")
    numbers = Window.partitionBy("document_name").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("document_name", "unit", "n").withColumn("offset", F.coalesce(F.sum("n").over(numbers), F.lit(0)))
    placed = runs.where("n > 0").drop("n").join(offsets.where("n > 0"), ["document_name", "unit"])
    size, step = F.lit(params.chunk_size), F.lit(params.step)
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - size) / step) + 1)
    pieces = placed.withColumn("chunk_index", F.explode(F.sequence(first, F.floor((F.col("offset") + F.col("n") - 1) / step))))
    begin = F.col("chunk_index") * step - F.col("offset")  # of the chunk, in the stretch
    at = F.greatest(F.lit(0), begin).cast("int")
    own = F.slice("tokens", at + 1, (F.least(begin + size, F.col("n")) - at).cast("int"))
    page = F.when(begin >= 0, F.array_max(F.transform(F.filter("starts", lambda s: s["at"] <= begin), lambda s: s["page"])))
    pieces = pieces.select("document_name", "chunk_index", page.alias("page"),
                           F.struct((F.col("offset") + at).alias("at"), F.array_join(own, " ").alias("text")).alias("piece"))
    chunks = pieces.groupBy("document_name", "chunk_index").agg(
        F.max("page").alias("page_number"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    chunks = chunks.withColumn("text", F.array_join(F.transform("pieces", lambda p: p["text"]), " "))
    counted = parts.groupBy("document_name").agg(F.count(F.lit(1)).cast("string").alias("n_pages"))
    whole = counted.join(chunks, "document_name", "left")
    name = record_name("document_name")
    index = F.coalesce("chunk_index", F.lit(0)).cast("int")
    return whole.select(record_id(name, index).alias("chunk_id"), name.alias("document_name"),
                        F.col("page_number").cast("int").alias("page_number"), index.alias("chunk_index"),
                        F.coalesce("text", F.lit("")).alias("text"),
                        F.create_map(F.lit("n_pages"), F.col("n_pages")).alias("metadata"),
                        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"))


@dataclass(frozen=True)
class Ingested:
    index: SearchIndex
    report: DataFrame     # status, reason, n
    rejected: DataFrame   # records that weren't taken, with their reason


def ingest_pages(pages: DataFrame, embed: EmbedParams, into: SearchIndex | str, params: ChunkParams = ChunkParams(),
                 use_fallback: bool = True, created_at: Column | None = None) -> Ingested:
    """Pages to a searchable index: chunk, embed, check, write.

    ``into`` is a folder for a new index, or a written index whose records of
    the same ids are replaced.
    """
    spark = pages.sparkSession
    where = scratch_path(spark, "page-records")
    records = embed_records(page_records(pages, params, use_fallback, created_at), embed)
    validate_records(records, embed.dim).write.parquet(where)  # embedded once
    checked = spark.read.parquet(where)
    good = checked.where("status = 'accepted'").drop("status", "reason")
    report = checked.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(into, str):
        index = build_index(good, dim=embed.dim, embed=embed, materialize_to=into)
    else:
        index, _ = apply_update(into, good)
    return Ingested(index, report, checked.where("status = 'rejected'").drop("status"))
