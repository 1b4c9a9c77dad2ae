"""Page-text assembly: pages -> one text per document (with OCR fallback)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridlake.functions.text import clean_text


def page_contribution(use_fallback: bool = True):
    """Text a page adds to its document.

    With fallback: an errored page adds nothing (and is not OCR'd); extracted
    text is used when non-empty (a lone space counts as text); otherwise the
    OCR texts of its images are concatenated in order, failed images (NULL)
    adding nothing. Without fallback: the extracted text as is.
    """
    text = F.col("page_text")
    ocr = F.coalesce(F.array_join(F.col("image_texts"), ""), F.lit(""))
    if not use_fallback:
        return F.when(F.col("page_error"), F.lit("")).otherwise(F.coalesce(text, F.lit("")))
    return (F.when(F.col("page_error"), F.lit(""))
            .when(text.isNotNull() & (text != ""), text)
            .otherwise(ocr))


def assemble_pages(pages: DataFrame, documents: DataFrame | None = None, *,
                   use_fallback: bool = True, clean: bool = True) -> DataFrame:
    """``pages(document_name, page_number, page_text, page_error, image_texts)``
    -> ``(document_name, text)``: pages joined in page order with no separator,
    then cleaned. ``documents(document_name)`` lists documents that must appear
    even with zero pages (they get ``''``).

    One group per document: a document's pages are bounded by the document
    itself, which must fit in one row as the output text anyway.
    """
    parts = pages.select("document_name", "page_number",
                         page_contribution(use_fallback).alias("t"))
    agg = parts.groupBy("document_name").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "t"))).alias("p"))
    joined = agg.select("document_name", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))
    if documents is not None:
        joined = (documents.select("document_name").distinct()
                  .join(joined, "document_name", "left")
                  .select("document_name", F.coalesce("text", F.lit("")).alias("text")))
    if clean:
        joined = joined.withColumn("text", clean_text("text"))
    return joined
