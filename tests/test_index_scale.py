"""What an index build deals out, and how many files it leaves."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hybridlake.functions import vectors
from hybridlake.operators import index as index_module
from hybridlake.operators import keyword, knn
from hybridlake.operators.index import (_packed, _unpacked, build_index, build_postings, embed_records, gather_postings,
                                        input_bytes)
from hybridlake.operators.maintenance import apply_update, update_index
from hybridlake.operators.topk import RunningTopK
from hybridlake.params import EmbedParams
from hybridlake.session import scratch_path


def corpus(spark, n=1500, parts=16):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(600)]
    weight = [1 / (i + 1) for i in range(600)]
    rows = [(f"c{i:05d}", " ".join(rng.choices(vocab, weight, k=rng.randint(5, 90)))) for i in range(n)]
    rows += [("empty", ""), ("null", None)]
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(parts)


@pytest.fixture
def conf(spark):
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_gathered_postings_are_the_postings_in_few_rows(spark, monkeypatch):
    records = embed_records(corpus(spark, 400, 2), EmbedParams(dim=8))
    wanted = sorted(tuple(r) for r in build_postings(records).collect())
    for most in (512, 7):
        monkeypatch.setattr(index_module, "GATHERED_POSTINGS", most)
        rows = gather_postings(records).collect()
        assert sorted((r.term, i, t, d) for r in rows for i, t, d in zip(r.ids, r.tfs, r.dls)) == wanted
        assert max(len(r.ids) for r in rows) <= most and (most < 512 or len(rows) < len(wanted) / 5)


def test_packed_postings_are_the_same_in_fewer_bytes(spark):
    ids = pa.array(["a", "", "é/\n\0x", "src/1_0", "b" * 300, "c"]).slice(1)
    tf, dl = np.array([1, 2, 70_000, 4, 5]), np.array([9, 8, 7, 300, 65_535])
    wide = pa.RecordBatch.from_arrays(_packed(ids, tf, dl, np.array([0, 2, 5], np.int32)), names=["a", "b", "c"])
    slim = pa.RecordBatch.from_arrays(_packed(ids.slice(3), tf[3:], dl[3:], np.array([0, 1, 2], np.int32)), names=["a", "b", "c"])
    both = pa.Table.from_batches([wide, slim]).combine_chunks().to_batches()[0]
    for rows, at, n in ((wide, [0, 1, 2, 3, 4], [2, 3]), (slim, [3, 4], [1, 1]), (both, [0, 1, 2, 3, 4, 3, 4], [2, 3, 1, 1]),
                        (both.slice(1), [2, 3, 4, 3, 4], [3, 1, 1]), (both.slice(2), [3, 4], [1, 1])):
        held, found, tfs, dls = _unpacked(*rows.columns)
        assert (list(held), found.to_pylist(), list(tfs), list(dls)) == (n, ids.take(pa.array(at)).to_pylist(), list(tf[at]), list(dl[at]))
    records = embed_records(corpus(spark, 400, 2), EmbedParams(dim=8))
    sizes = []
    for packed in (False, True):
        path = scratch_path(spark, "t-packed")
        gather_postings(records, pack=packed).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
        sizes.append(input_bytes(spark.read.parquet(path)))
    assert sizes[1] < 0.8 * sizes[0], sizes


def test_files_of_the_posting_blocks_follow_buckets_not_their_square(spark, conf, monkeypatch):
    monkeypatch.setattr(index_module, "CHUNKS_PER_BUCKET", 25)
    for key, value in {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "48k",
                       "spark.sql.files.maxPartitionBytes": "24k", "spark.sql.files.openCostInBytes": "1k"}.items():
        conf(key, value)
    root = scratch_path(spark, "t-files")
    index = build_index(embed_records(corpus(spark), EmbedParams(dim=8)), dim=8, materialize_to=root)
    files = sum(f.endswith(".parquet") for _, _, names in os.walk(f"{root.removeprefix('file://').removeprefix('file:')}/blocks") for f in names)
    assert index.term_buckets == 60
    assert 0 < files <= 3 * 60, files


def test_records_are_embedded_after_they_are_dealt_out(spark):
    embed = EmbedParams(dim=8)
    bare = build_index(corpus(spark, 300), dim=8, embed=embed, materialize_to=scratch_path(spark, "t-bare"))
    whole = build_index(embed_records(corpus(spark, 300), embed), dim=8, embed=embed, materialize_to=scratch_path(spark, "t-whole"))
    rows = lambda index: sorted(map(str, index.records.select("chunk_id", "text", "terms", "embedding", "id_bucket").collect()))
    assert rows(bare) == rows(whole) and bare.records.columns[-1] == "id_bucket"
    stats = lambda index: (sorted(map(tuple, index.term_stats.select("term", "df").collect())), tuple(index.corpus_stats.first()))
    assert stats(bare) == stats(whole)
    assert build_index(corpus(spark, 20), dim=8, embed=embed).records.where(F.size("embedding") == 8).count() == 21


def test_a_row_without_terms_leaves_the_vector_before_it_alone(spark, monkeypatch):
    terms = pa.array([["a", "b"], None, [], ["c"] * 5, ["a"]], pa.list_(pa.string()))
    whole = vectors.hash_vectors_arrow(terms, 8)
    assert [v and len(v) for v in whole.to_pylist()] == [8, None, 8, 8, 8]
    monkeypatch.setattr(vectors, "SLICE_TERMS", 2)  # slices change nothing
    assert vectors.hash_vectors_arrow(terms, 8).equals(whole)
    monkeypatch.setattr(vectors, "SLICE_ELEMENTS", 8)
    assert vectors.hash_vectors_arrow(terms.slice(1), 8).equals(whole.slice(1))


def test_a_batch_of_vectors_is_scored_in_bounded_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    held = knn.Candidates(pa.array([f"v{i:03d}" for i in range(300)]), pa.array(list(rng.normal(size=(300, 4)))), 4, "l2")
    queries, seen, found = rng.normal(size=(50, 4)), [], []
    scores = knn._scores
    monkeypatch.setattr(knn, "_scores", lambda q, *a: seen.append(len(q) * 300) or scores(q, *a))
    for cells in (1 << 21, 1500):
        monkeypatch.setattr(knn, "SCORE_CELLS", cells)
        seen.clear()
        best = RunningTopK(3)
        knn.local_hits(best, held, queries, np.arange(50), "l2", 3, 1024)
        found.append((best.query.tolist(), best.ids.to_pylist()))
        assert max(seen) <= cells and len(seen) == (1 if cells > 15000 else 10)
    assert found[0] == found[1]


def test_many_candidates_are_scored_by_record(spark, monkeypatch):
    """Not by a row for each candidate pair and term."""
    index = build_index(corpus(spark, 400), dim=8, embed=EmbedParams(dim=8), materialize_to=scratch_path(spark, "t-many"))
    queries = index.records.where("chunk_id < 'c00040'").select("chunk_id", F.col("text").alias("query_text")).withColumn("qid", F.col("chunk_id"))
    key = lambda df: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    expected = key(keyword.keyword_search(index, queries.select("qid", "query_text"), method="join"))
    assert key(keyword.keyword_search(index, queries.select("qid", "query_text"), method="blocks")) == expected
    monkeypatch.setattr(keyword, "JOIN_MAX_CANDIDATES", 0)
    scored = []
    monkeypatch.setattr(keyword, "score_pairs", lambda index, pairs, *a, f=keyword.score_pairs: scored.append(pairs.count()) or f(index, pairs, *a))
    assert key(keyword.keyword_search(index, queries.select("qid", "query_text"), method="blocks")) == expected
    assert len(scored) == 1  # the pairs of the first bound only

def test_a_view_reads_the_batch_once(spark):
    index = build_index(corpus(spark, 60), dim=8, embed=EmbedParams(dim=8), materialize_to=scratch_path(spark, "t-view"))
    computed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        computed.add(1)
        return text

    batch = spark.createDataFrame([("c00001", "new words w1"), ("c00099", "w2 w2")], "chunk_id string, text string")
    batch = embed_records(batch.withColumn("text", counted.asNondeterministic()("text")), EmbedParams(dim=8))
    view = update_index(index, batch)
    hits = keyword.keyword_search(view, spark.createDataFrame([(1, "new w2")], "qid long, query_text string")).collect()
    assert {"c00001", "c00099"} <= {r.chunk_id for r in hits} and view.corpus_stats.first()["n_docs"] == 63
    assert {r.term: r.df for r in view.term_stats.where("term in ('new', 'words')").collect()} == {"new": 1, "words": 1}
    assert computed.value == 2


def test_an_update_is_put_in_place_without_another_shuffle(spark, monkeypatch):
    index = build_index(corpus(spark, 200), dim=8, embed=EmbedParams(dim=8), materialize_to=scratch_path(spark, "t-place"))
    dealt = []
    monkeypatch.setattr(type(index.records), "hint", lambda self, *a, f=type(index.records).hint: dealt.append(a) or f(self, *a))
    updated, _ = apply_update(index, deleted=index.records.where("chunk_id < 'c00100'").select("chunk_id"))
    assert sum(a[0] == "rebalance" for a in dealt) == 3  # records, blocks and term statistics, once each
    assert updated.records.count() == 102 and updated.corpus_stats.first()["n_docs"] == 102
    terms = {r.chunk_id: list(r.terms or ()) for r in updated.records.select("chunk_id", "terms").collect()}
    held = sorted((r.term, i) for r in updated.blocks.collect() for i in r.ids)
    assert held == sorted((t, i) for i, ts in terms.items() for t in set(ts))
