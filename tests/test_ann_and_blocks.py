"""Cell-routed vector search, block-max keyword search, encoders and requests."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridlake.operators.ann import build_ivf, calibrate, ivf_search, n_cells_for
from hybridlake.operators.fusion import hybrid_search
from hybridlake.operators.index import build_index, embed_queries, embed_records, open_index
from hybridlake.operators.keyword import block_max_candidates, keyword_search, query_terms
from hybridlake.operators.knn import vector_search
from hybridlake.operators.rag import chat_requests, rag_prompts, rag_requests
from hybridlake.params import EmbedParams, IVFParams, PromptParams, SearchParams
from hybridlake.plans.corpus import driver_index, driver_queries
from hybridlake.session import scratch_path

from conftest import SF_CHECK, SF_SMALL


def clustered(rng, n, dim=8, k=12):
    middles = rng.normal(size=(k, dim))
    return (middles[rng.integers(0, k, n)] + rng.normal(scale=.15, size=(n, dim))).astype(np.float32)


def tables(spark, v, q):
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)], "qid string, query_vector array<float>")
    return corpus.repartition(4), queries


def hits(df):
    return sorted((r.qid, r.rank, r[1], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("space", ["l2", "cosine"])
def test_both_plans_give_what_the_probed_cells_hold(spark, space):
    rng = np.random.default_rng(3)
    v, q = clustered(rng, 900), clustered(rng, 60)
    v[5] = 0
    corpus, queries = tables(spark, v, q)
    corpus = corpus.unionByName(spark.createDataFrame([(9000, [float("nan")] * 8), (9001, [1.0])], corpus.schema))
    queries = queries.unionByName(spark.createDataFrame([("bad", [float("inf")] * 8), ("short", [1.0])], queries.schema))
    params = SearchParams(top_k=5, space=space, cell_rows=40, cell_queries=7)  # cells and their queries are split
    ivf = build_ivf(corpus, IVFParams(n_cells=12, nprobe=3), dim=8, id_col="vec_id", space=space)
    cells = {r.vec_id: r.cell for r in ivf.vectors.select("vec_id", "cell").collect()}
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)
    a, b = (unit(v.astype(float)), unit(q.astype(float))) if space == "cosine" else (v.astype(float), q.astype(float))
    expected = []
    for i in range(len(q)):
        near = np.argsort(((ivf.centers - b[i]) ** 2).sum(1), kind="stable")[:3]
        held = [j for j in range(len(v)) if cells.get(j) in near]
        score = {j: (1 + a[j] @ b[i]) / 2 if space == "cosine" else 1 / (1 + ((a[j] - b[i]) ** 2).sum()) for j in held}
        best = sorted(held, key=lambda j: (-round(score[j], 9), j))[:5]
        expected += [(f"q{i}", r + 1, j) for r, j in enumerate(best)]
    for plan in ("broadcast", "routed"):
        found = hits(ivf_search(ivf, queries, params, plan=plan))
        assert [h[:3] for h in found] == sorted(expected), plan
    assert (5 in cells) == (space == "l2") and 9000 not in cells


def test_every_cell_probed_is_the_exact_search_in_both_plans(spark):
    rng = np.random.default_rng(4)
    corpus, queries = tables(spark, clustered(rng, 400), clustered(rng, 30))
    ivf = build_ivf(corpus, IVFParams(), dim=8, id_col="vec_id", materialize_to=scratch_path(spark, "t-ivf"))
    assert len(ivf.centers) == 20  # the square root of the number of vectors
    exact = hits(vector_search(corpus, queries, SearchParams(), dim=8, id_col="vec_id"))
    for plan in ("broadcast", "routed"):
        assert hits(ivf_search(ivf, queries, SearchParams(), nprobe=20, plan=plan)) == exact
    assert ivf_search(ivf, queries.limit(0), SearchParams(), plan="broadcast").count() == 0
    assert ivf_search(ivf, queries.limit(0), SearchParams(), plan="routed").count() == 0
    empty = build_ivf(corpus.limit(0), IVFParams(), dim=8, id_col="vec_id")
    assert ivf_search(empty, queries, SearchParams()).count() == 0


def test_the_number_of_cells_grows_and_stays_within_its_bytes():
    assert n_cells_for(10_000, 64, IVFParams()) == 100
    assert n_cells_for(10 ** 12, 1024, IVFParams(max_center_bytes=8 * 1024 * 500)) == 500
    assert n_cells_for(3, 64, IVFParams(n_cells=16)) == 3


def test_calibrated_probes_reach_the_recall(spark):
    vecs = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").select("vec_id", "embedding")
    ivf = calibrate(build_ivf(vecs, IVFParams(n_cells=16, nprobe=1), dim=64, id_col="vec_id"), recall=.9, every=5)
    assert .9 <= ivf.recall <= 1 and 1 <= ivf.nprobe <= 16
    queries = vecs.where("vec_id % 7 = 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    params = SearchParams(top_k=10)
    exact = {(r.qid, r.vec_id) for r in vector_search(vecs, queries, params, dim=64, id_col="vec_id").collect()}
    found = {(r.qid, r.vec_id) for r in ivf_search(ivf, queries, params).collect()}
    assert len(found & exact) / len(exact) >= .85  # other queries than those it was calibrated on


def test_hybrid_with_all_cells_is_the_exact_hybrid(spark):
    index, queries = driver_index(spark, SF_SMALL), driver_queries(spark, SF_SMALL)
    ivf = build_ivf(index.records, IVFParams(n_cells=9, nprobe=9), dim=64, id_col="chunk_id")
    key = lambda df: sorted((r.qid, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert key(hybrid_search(index, queries, ivf=ivf)) == key(hybrid_search(index, queries))
    with pytest.raises(ValueError):
        hybrid_search(index, queries, ivf=replace(ivf, dim=8))


# ---- block-max pruning

def zipf_corpus(spark, n=1500):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(800)]
    weight = [1 / (i + 1) for i in range(800)]
    rows = [(f"c{i:05d}", " ".join(rng.choices(vocab, weight, k=rng.randint(5, 120)))) for i in range(n)]
    rows += [("dup-a", rows[3][1]), ("dup-b", rows[3][1]), ("none", ""), ("rare", "onlyhere w1 w2")]
    records = embed_records(spark.createDataFrame(rows, "chunk_id string, text string"), EmbedParams(dim=8))
    queries = [(i, " ".join(rng.choices(vocab, weight, k=rng.randint(1, 25)))) for i in range(60)]
    queries += [(100, "onlyhere"), (101, "nothing at all"), (102, rows[3][1]), (103, "w0"), (104, "")]
    return (build_index(records, dim=8, materialize_to=scratch_path(spark, "t-blocks")),
            spark.createDataFrame(queries, "qid long, query_text string"))


def test_block_max_gives_the_hits_of_the_other_plans(spark):
    index, queries = zipf_corpus(spark)
    for k in (1, 5, 40):
        params = SearchParams(top_k=k)
        expected = hits(keyword_search(index, queries, params, method="join"))
        assert hits(keyword_search(index, queries, params, method="blocks")) == expected
        assert hits(keyword_search(index, queries, params, method="scan")) == expected
        tiny = SearchParams(top_k=k, max_broadcast_bytes=20_000)  # several passes
        assert k != 5 or hits(keyword_search(index, queries, tiny, method="blocks")) == expected


def test_block_max_scores_few_pairs(spark):
    index, queries = zipf_corpus(spark)
    params = SearchParams(top_k=5)
    left = block_max_candidates(index, query_terms(queries), params).candidates.count()
    qterms = query_terms(queries)
    pairs = qterms.join(index.postings, "term").select("qid", "chunk_id").distinct().count()
    assert left < pairs / 3, (left, pairs)


def test_blocks_hold_every_posting_once_with_its_bounds(spark):
    index, _ = zipf_corpus(spark)
    rows = index.blocks.collect()
    assert all(r.n == len(r.ids) <= 128 and r.max_tf == max(r.tfs) and r.min_dl == min(r.dls) for r in rows)
    held = sorted((r.term, i, t, d) for r in rows for i, t, d in zip(r.ids, r.tfs, r.dls))
    terms = {r.chunk_id: list(r.terms) for r in index.records.select("chunk_id", "terms").collect()}
    assert held == sorted((t, i, ts.count(t), len(ts)) for i, ts in terms.items() for t in set(ts))
    assert {(r.term, r.df) for r in index.term_stats.collect()} == {
        (t, sum(t in ts for ts in terms.values())) for t in {x for ts in terms.values() for x in ts}}


def test_an_empty_index_is_written_and_read(spark):
    records = embed_records(spark.createDataFrame([], "chunk_id string, text string"), EmbedParams(dim=8))
    index = build_index(records, dim=8, materialize_to=scratch_path(spark, "t-empty"))
    queries = spark.createDataFrame([(1, "a b")], "qid long, query_text string")
    for method in ("blocks", "join", "scan"):
        assert keyword_search(index, queries, method=method).count() == 0
    assert index.corpus_stats.first()["n_docs"] == 0


# ---- encoders, and requests with their own parameters

def letters_encoder():
    class Letters:
        """Counts of a, e, i and the length, whatever the batch."""

        def encode(self, texts):
            return np.array([[t.count("a"), t.count("e"), t.count("i"), len(t)] for t in texts], np.float32)

    return EmbedParams(dim=4, encoder=Letters, encoder_name="letters")  # workers get the class itself, not this module's name


def test_a_supplied_encoder_goes_with_its_index(spark):
    letters = letters_encoder()
    texts = ["a banana", "eel", "pita", "iiii", "aaaa eeee"] * 30
    rows = spark.createDataFrame([(f"c{i:03d}", t, "d") for i, t in enumerate(texts)], "chunk_id string, text string, document_name string")
    root = scratch_path(spark, "t-encoder")
    index = build_index(embed_records(rows, letters), dim=4, embed=letters, materialize_to=root)
    requests = spark.createDataFrame([("q", "eel", "", True), ("off", "eel", "", False)],
                                     "qid string, query_text string, history string, use_rag boolean")
    out = {r.qid: r.prompt for r in rag_prompts(index, requests).collect()}
    assert "Document 0:\neel\n" in out["q"] and "Document 0" not in out["off"]
    found = embed_queries(requests.limit(1), letters).first()["query_vector"]
    assert list(found) == [0.0, 2.0, 0.0, 3.0]
    with pytest.raises(ValueError):
        rag_prompts(index, requests, EmbedParams(dim=4))
    with pytest.raises(ValueError):
        open_index(spark, root, EmbedParams(dim=4))
    assert open_index(spark, root, letters).embed == letters
    with pytest.raises(ValueError):
        EmbedParams(dim=4, encoder=letters.encoder)  # has no name


def test_requests_have_their_own_parameters(spark):
    index = driver_index(spark, SF_SMALL)
    text = driver_queries(spark, SF_SMALL).orderBy("qid").first()["query_text"]
    rows = [("one", 1, .5, True), ("ten", 10, 2.0, True), ("default", None, None, None), ("off", 4, 0.0, False),
            ("none", 0, .5, True), ("many", 11, .5, True), ("hot", 3, 2.1, True), ("cold", 3, -.1, True)]
    requests = spark.createDataFrame([(q, text, "", u, k, t) for q, k, t, u in rows],
                                     "qid string, query_text string, history string, use_rag boolean, top_k int, temperature double")
    prompts, rejected = rag_requests(index, requests)
    blocks = {r.qid for r in prompts.collect()}
    assert blocks == {"one", "ten", "default", "off"}
    shown = {r.qid: sum(f"Document {i}:" in r.prompt for i in range(12)) for r in prompts.collect()}
    assert shown == {"one": 1, "ten": 10, "default": 3, "off": 0}
    assert {r.qid: r.temperature for r in prompts.collect()}["default"] == .7
    assert {r.qid: r.reason for r in rejected.collect()} == {
        "none": "top_k_out_of_range", "many": "top_k_out_of_range", "hot": "temperature_out_of_range", "cold": "temperature_out_of_range"}
    with pytest.raises(ValueError):
        rag_prompts(index, requests, search=SearchParams(top_k=11))


def test_chat_requests_look_back_as_far_as_they_may(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(8)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.turn: r.history for r in chat_requests(messages, PromptParams(max_history=2)).collect()}
    assert set(out) == {1, 3, 5, 7} and out[7] == "User: m5\nAssistant: m6\n" and out[1] == "Assistant: m0\n"
