"""Chunks from pages: the chunks of the assembled document, and the page of each."""

import random

from pyspark.sql import functions as F

from hybridlake.functions.text import clean_text
from hybridlake.operators.chunking import chunk_records
from hybridlake.operators.keyword import keyword_search
from hybridlake.operators.page_records import ingest_pages, page_records
from hybridlake.params import ChunkParams, EmbedParams
from hybridlake.session import scratch_path
from hybridlake.sources.pages import assemble_pages

SCHEMA = "document_name string, page_number int, page_text string, page_error boolean, image_texts array<string>"
PARTS = ["a", "bb", "word", "x-", "-", "\n", "\n\n", " ", "  ", "\t", "-\n", "-\n\n", "é", "_1", " ", "\x1c", "\r", "(", ".", "中"]


def random_pages(seed, n_docs):
    rng = random.Random(seed)
    rows = []
    for d in range(n_docs):
        for p in range(rng.randint(1, 6)):
            text = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 12, 40])))
            rows.append((f"d{d}.pdf", p * 3 + 1, text, rng.random() < .05, ["ocr ", None, "x-\n"] if rng.random() < .3 else []))
    return rows


def test_chunks_are_those_of_the_assembled_text(spark):
    params = ChunkParams(chunk_size=4, overlap=1)
    pages = spark.createDataFrame(random_pages(5, 400), SCHEMA).repartition(5)
    docs = assemble_pages(pages, clean=False).withColumnRenamed("document_name", "path")
    expected = {r.chunk_id: (r.document_name, r.chunk_index, r.text) for r in chunk_records(docs, params=params).collect()}
    rows = page_records(pages, params).collect()
    got = {r.chunk_id: (r.document_name, r.chunk_index, r.text) for r in rows}
    assert len(rows) == len(got)
    assert got == expected


def test_a_chunk_s_page_is_where_its_first_token_starts(spark):
    params = ChunkParams(chunk_size=2, overlap=0)
    rows = [("a.pdf", 1, "one two exam-\n", False, []), ("a.pdf", 2, "ple four five", False, []),
            ("a.pdf", 3, "teen six", False, []), ("a.pdf", 4, "", False, []), ("a.pdf", 5, "", False, ["\nseven", None, " eight"]),
            ("a.pdf", 9, " nine ", False, []), ("b", 1, "  ", False, []), ("b", 2, " ", False, []),
            ("c", 4, "\n", False, []), ("c", 6, "late", False, []), ("e", 1, "gone", True, ["never read"])]
    out = {r.chunk_id: (r.page_number, r.text, r.metadata["n_pages"]) for r in page_records(
        spark.createDataFrame(rows, SCHEMA), params).collect()}
    assert out == {"a_0": (1, "one two", "6"), "a_1": (1, "example four", "6"), "a_2": (2, "fiveteen six", "6"),
                   "a_3": (5, "seven eight", "6"), "a_4": (9, "nine", "6"), "b_0": (None, "", "2"), "c_0": (6, "late", "2"),
                   "e_0": (None, "", "1")}


def test_pages_of_random_texts(spark):
    """Against the number of tokens of all that comes before a page, cleaned twice."""
    params = ChunkParams(chunk_size=3, overlap=1)
    plain = [r for r in PARTS if r not in (" ", "\x1c", "\r")]  # whose strip would move counts
    rng = random.Random(9)
    rows = [(f"d{d}", p, "".join(rng.choice(plain) for _ in range(rng.choice([0, 2, 9]))), False, [])
            for d in range(200) for p in range(5)]
    prefixes = [(d, p, "".join(r[2] for r in rows if r[0] == d and r[1] < p)) for d, p, *_ in rows]
    twice = spark.createDataFrame(prefixes, "d string, p int, t string").withColumn("c", clean_text(clean_text("t")))
    before = {(r.d, r.p): len(r.c.split(" ")) if r.c else 0 for r in twice.collect()}
    for r in page_records(spark.createDataFrame(rows, SCHEMA), params).collect():
        first = r.chunk_index * params.step
        if r.text:
            assert r.page_number == max(p for p in range(5) if before[r.document_name, p] <= first), r


def test_a_large_document_spreads(spark):
    rng = random.Random(2)
    rows = [("big", p, " ".join(f"w{rng.randint(0, 999)}" for _ in range(200)) + ("" if p % 3 else " "), False, []) for p in range(600)]
    rows += [("none", p, "x" * 50, False, []) for p in range(50)]  # no break at all: one token
    pages = spark.createDataFrame(rows, SCHEMA).repartition(8)
    docs = assemble_pages(pages, clean=False).withColumnRenamed("document_name", "path")
    expected = sorted((r.chunk_id, r.text) for r in chunk_records(docs).collect())
    assert sorted((r.chunk_id, r.text) for r in page_records(pages).collect()) == expected


def test_the_ingest_job(spark):
    embed = EmbedParams(dim=8)
    rows = [("a.pdf", 1, "apples and", False, []), ("a.pdf", 2, " pears", False, []), (None, 1, "nobody", False, [])]
    pages = spark.createDataFrame(rows, SCHEMA)
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp")
    done = ingest_pages(pages, embed, scratch_path(spark, "t-pages"), created_at=stamp)
    queries = spark.createDataFrame([(1, "pears")], "qid long, query_text string")
    assert [r.chunk_id for r in keyword_search(done.index, queries).collect()] == ["a_0"]
    record = done.index.records.where("chunk_id = 'a_0'").first()
    assert (record.page_number, record.metadata, str(record.created_at)) == (1, {"n_pages": "2"}, "2024-05-06 07:08:09")
    again = ingest_pages(spark.createDataFrame([("a.pdf", 1, "plums", False, [])], SCHEMA), embed, done.index)
    assert keyword_search(again.index, queries).count() == 0 and again.index.records.where("document_name = 'a'").count() == 1
    assert sum(r.n for r in again.report.collect()) == 1
