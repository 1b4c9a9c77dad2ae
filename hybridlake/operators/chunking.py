"""Document -> chunk records (clean, window, name, id, optional prefix)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridlake.functions.text import chunk_windows, clean_again, clean_text, record_id, record_name, tokens
from hybridlake.params import ChunkParams


def chunk_text(df: DataFrame, text_col: str = "text", params: ChunkParams = ChunkParams(),
               keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: ``*keep, chunk_index, chunk`` (the chunker cleans its input)."""
    toks = df.select(*keep, tokens(clean_text(text_col)).alias("_toks"))
    return toks.select(*keep, F.posexplode(chunk_windows("_toks", params)).alias("chunk_index", "chunk"))


def chunk_records(docs: DataFrame, *, path_col: str = "path", text_col: str = "text",
                  params: ChunkParams = ChunkParams(), extracted: bool = True,
                  keep: tuple[str, ...] = (), metadata: tuple[str, ...] = ()) -> DataFrame:
    """``docs(path, text)`` -> ``chunk_id, document_name, chunk_index, text, metadata``.

    ``extracted=True`` means ``text`` is raw extracted text: it is cleaned once
    as extraction does, then the chunker cleans again (so paragraph newlines
    become spaces, as in the reference pipeline). Rows with a NULL text produce
    no chunks. The stored text never has the asymmetric prefix: it is added
    where texts are embedded (``EmbedParams.passage_prefix``). The columns in
    ``metadata`` are carried as text in the records' ``metadata`` map.
    """
    carried = [x for c in metadata for x in (F.lit(c), F.col(c).cast("string"))]
    fields = F.create_map(*carried).cast("map<string,string>").alias("metadata")
    once = docs.select(*keep, fields, record_name(path_col).alias("document_name"), clean_text(text_col).alias("_c1"))
    cleaned = clean_again("_c1") if extracted else F.col("_c1")
    toks = once.select(*keep, "metadata", "document_name", tokens(cleaned).alias("_toks"))
    out = toks.select(
        *keep,
        "metadata",
        "document_name",
        F.posexplode(chunk_windows("_toks", params)).alias("chunk_index", "text"),
    ).select(
        *keep,
        record_id("document_name", "chunk_index").alias("chunk_id"),
        "document_name",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "text",
        "metadata",
    )
    return out

