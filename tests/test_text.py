"""Cleaning, chunking, naming and analysis: hand-made fixtures and properties
checked against a small pure-Python model of the reference semantics."""

import itertools
import math
import random
import time

import pytest

from hybridlake.functions.text import analyze, clean_again, clean_text, record_id, record_name, tokens
from hybridlake.operators.chunking import chunk_records, chunk_text
from hybridlake.params import ChunkParams


# -- pure-Python model written from the definitions ---------------------------

def is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def model_clean(t: str) -> str:
    """Character by character: join hyphen breaks, unwrap lines, squeeze blanks, strip."""
    joined, at, used = [], 0, 0  # used: where the last joined word ended
    while at < len(t):
        if t[at:at + 2] == "-\n" and at > used and is_word(t[at - 1]) and is_word(t[at + 2:at + 3] or "-"):
            at += 2
            while at < len(t) and is_word(t[at]):
                joined.append(t[at])
                at += 1
            used = at
        else:
            joined.append(t[at])
            at += 1
    lines = []
    for newline, run in itertools.groupby(joined, lambda c: c == "\n"):
        run = list(run)
        lines.extend([" " if len(run) == 1 else "\n"] if newline else run)
    out = []
    for c in lines:
        blank = c in " \t"
        if not (blank and out and out[-1] == " "):
            out.append(" " if blank else c)
    return "".join(out).strip()


def model_chunks(t: str, size: int, overlap: int) -> list[str]:
    words = model_clean(t).split(" ")
    return [" ".join(words[i * (size - overlap):][:size]) for i in range(math.ceil(len(words) / (size - overlap)))]


def _one(spark, col_expr, value):
    return spark.createDataFrame([(value,)], "t string").select(col_expr.alias("o")).first()["o"]


@pytest.mark.parametrize("raw,expected", [
    ("exam-\nple", "example"),
    ("a-\nb-\nc", "ab- c"),
    ("p1\n\np2", "p1\np2"),
    ("a \t b", "a b"),
    (" x ", "x"),
    (" x ", "x"),
    ("\u001cx\u001c", "x"),
    ("é-\nx", "é- x"),
    ("", ""),
])
def test_clean_fixtures(spark, raw, expected):
    assert _one(spark, clean_text("t"), raw) == expected
    assert model_clean(raw) == expected


def test_clean_twice_turns_paragraphs_into_spaces(spark):
    assert _one(spark, clean_text(clean_text("t")), "p1\n\np2") == "p1 p2"
    assert _one(spark, clean_again(clean_text("t")), "p1\n\np2") == "p1 p2"


def test_clean_null_is_null_not_error(spark):
    assert _one(spark, clean_text("t"), None) is None


ALPHABET = ["a", "b", "Z", "9", "_", "-", "\n", "\n", " ", " ", "\t", " ", " ", "\u001c", "\r",
            "́", "é", "ß", "İ", "\u0085", ".", "　"]


def _random_strings(n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 24))) for _ in range(n)]


def test_clean_matches_python_model_on_random_strings(spark):
    strings = _random_strings(3000)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, t string")
    got = {r.i: r.o for r in df.select("i", clean_text("t").alias("o")).collect()}
    bad = [(strings[i], got[i], model_clean(strings[i])) for i in got if got[i] != model_clean(strings[i])]
    assert not bad[:5]


def test_clean_again_equals_second_full_pass(spark):
    strings = _random_strings(3000, seed=11)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, t string")
    c1 = df.select("i", clean_text("t").alias("c1"))
    rows = c1.select("i", clean_text("c1").alias("full"), clean_again("c1").alias("fast"),
                     clean_text(clean_text("c1")).alias("third")).collect()
    assert all(r.full == r.fast for r in rows)
    assert all(r.full == r.third for r in rows)  # clean^3 = clean^2
    assert all("\n" not in r.full for r in rows)


@pytest.mark.parametrize("n_tokens,expected", [(0, 1), (200, 1), (300, 2), (301, 2), (401, 3), (1000, 5)])
def test_chunk_count(spark, n_tokens, expected):
    text = " ".join(f"w{i}" for i in range(n_tokens))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = chunk_text(df, "text", ChunkParams(300, 100), keep=("id",)).orderBy("chunk_index").collect()
    assert len(rows) == expected == max(1, math.ceil(n_tokens / 200))
    assert [r.chunk for r in rows] == model_chunks(text, 300, 100)


def test_tail_chunk_contained_and_empty_text(spark):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, text), (2, "")], "id long, text string")
    rows = chunk_text(df, "text", ChunkParams(), keep=("id",)).orderBy("id", "chunk_index").collect()
    assert [r.id for r in rows] == [1, 1, 2]
    assert rows[1].chunk in rows[0].chunk
    assert rows[2].chunk == ""


def test_overlap_must_be_smaller_than_size():
    with pytest.raises(ValueError):
        ChunkParams(100, 100)
    with pytest.raises(ValueError):
        ChunkParams(100, 150)


def test_chunks_reconstruct_tokens(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["x", "y", "zz", "q1"]) for _ in range(1234))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = chunk_text(df, "text", ChunkParams(50, 10), keep=("id",)).orderBy("chunk_index").collect()
    toks = []
    for i, r in enumerate(rows):
        part = r.chunk.split(" ")
        toks.extend(part if i == 0 else part[10:])
    assert toks == text.split(" ")


def test_record_name_and_id(spark):
    df = spark.createDataFrame([("a.pdf", 2), ("x.pdf.pdf", 0)], "p string, i int")
    out = df.select(record_id(record_name("p"), "i").alias("o")).collect()
    assert [r.o for r in out] == ["a_2", "x_0"]


def test_chunk_records_pipeline_cleans_twice(spark):
    df = spark.createDataFrame([(1, "docs/a.pdf", "p1\n\np2 exam-\nple")], "doc_id long, path string, text string")
    rows = chunk_records(df).collect()
    assert [(r.chunk_id, r.document_name, r.chunk_index, r.text) for r in rows] == [("docs/a_0", "docs/a", 0, "p1 p2 example")]


def test_analyze(spark):
    assert _one(spark, analyze("t"), "Hello, wörld_2 -- x") == ["hello", "wörld_2", "x"]
    assert _one(spark, analyze("t"), "  ") == []
    assert _one(spark, tokens("t"), "") == [""]


def test_passage_prefix_on_store_and_embed(spark):
    from hybridlake.functions.vectors import hash_embedding
    from hybridlake.operators.index import embed_queries, embed_records
    from hybridlake.params import EmbedParams

    docs = spark.createDataFrame([(1, "d/a.pdf", "alpha beta")], "doc_id long, path string, text string")
    plain = chunk_records(docs)
    assert plain.first().text == "alpha beta"  # the prefix is embedded, never stored
    on = embed_records(plain, EmbedParams(dim=8, passage_prefix=True)).first()
    off = embed_records(plain, EmbedParams(dim=8)).first()
    want = spark.createDataFrame([("passage: alpha beta",)], "t string").select(
        hash_embedding(analyze("t"), 8).alias("v")).first().v
    assert list(on.embedding) == list(want) and list(off.embedding) != list(want)
    assert on.terms == ["alpha", "beta"]  # the keyword side keeps the unprefixed text
    q = spark.createDataFrame([(0, "alpha beta")], "qid long, query_text string")
    qv = embed_queries(q, EmbedParams(dim=8, passage_prefix=True)).first()
    assert list(qv.query_vector) == list(want) and qv.query_text == "alpha beta"


def test_spread_only_widens_narrow_scans(spark):
    from hybridlake.sources.tables import spread
    cores = spark.sparkContext.defaultParallelism
    narrow = spark.range(100).coalesce(1)
    wide = spark.range(0, 1000, numPartitions=cores * 2)
    assert spread(narrow).rdd.getNumPartitions() == cores
    assert "Exchange" not in spread(wide)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["x" * 5_000_000, "a" + "\u00a0" * 5_000_000 + "b", "-\n" * 500_000, "ab-\n" * 300_000])
def test_cleaning_takes_linear_time(spark, text):
    df = spark.createDataFrame([(text[:1000],), (text,)], "t string").select(clean_text("t").alias("o"))
    began = time.perf_counter()
    short, whole = (r.o for r in df.collect())
    assert time.perf_counter() - began < 60
    assert short == model_clean(text[:1000]) and whole == model_clean(text)


def test_words_by_the_word_boundary_rules(spark):
    cases = {
        "Don't stop, it’s 3.14 or 1,000;5 a.b.c": ["don't", "stop", "it’s", "3.14", "or", "1,000;5", "a.b.c"],
        "हिन्दी में": ["हिन्दी", "में"], "cafe\u0301s naïve": ["cafe\u0301s", "naïve"],
        "snake_case _x __ a_": ["snake_case", "_x", "a_"], "漢字かな カタカナ ab漢c": ["漢", "字", "か", "な", "カタカナ", "ab", "漢", "c"],
        "end. 'quoted' a:b 1:2 a.1 1.a x-y 5.": ["end", "quoted", "a:b", "1", "2", "a", "1", "1", "a", "x", "y", "5"],
        "e.g. U.S.A. l·l a..b 1,,2": ["e.g", "u.s.a", "l·l", "a", "b", "1", "2"], "": [], " \u0301 ! ": [], "x\u0301'y\u0301": ["x\u0301'y\u0301"],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", analyze("t").alias("w")).collect()
    assert {list(cases)[r.i]: list(r.w) for r in rows} == cases


def test_words_are_those_of_the_oracle(spark):
    import duckdb

    from hybridlake.plans.oracle import terms

    rng = random.Random(4)
    parts = ["a", "Bc", "é", "e\u0301", "9", "10", "_", "'", "’", ".", ":", "·", ",", ";", " ", "-", "漢", "か", "न्", "\n", "\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = {r.i: list(r.w) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", analyze("t").alias("w")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INT, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", list(enumerate(texts)))
    expected = dict(con.execute(f"SELECT i, {terms('t')} FROM x").fetchall())
    assert got == expected
