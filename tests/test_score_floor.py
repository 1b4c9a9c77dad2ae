"""Pairs that can't reach a query's k-th score so far are passed over, and no hit is lost by it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hybridlake.operators import keyword as kw
from hybridlake.operators import knn
from hybridlake.operators.index import SearchIndex, build_index
from hybridlake.operators.keyword import bm25_scores, keyword_search_batch, query_terms
from hybridlake.operators.knn import Candidates, local_hits
from hybridlake.operators.topk import RunningTopK, top_k
from hybridlake.params import BM25Params, EmbedParams, SearchParams
from hybridlake.session import scratch_path


@pytest.mark.parametrize("space", ["l2", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_few_vectors_are_scored_in_full(monkeypatch, space, scale):
    rng = np.random.default_rng(3)
    n, dim, k = 12_000, 16, 4
    v = rng.normal(size=(n, dim)).astype(np.float32) * np.float32(scale)
    v[5000:5040] = v[17]                      # exact copies: equal scores go by id
    v[::977, 3] = np.nan
    q = np.concatenate([rng.normal(size=(60, dim)) * scale, v[17:18].astype(np.float64)])
    ids = [f"id{i:05d}" for i in rng.permutation(n)]
    if space == "cosine":
        q = q / np.sqrt((q * q).sum(1))[:, None]
    scored = []
    full = knn._scores
    monkeypatch.setattr(knn, "_scores", lambda qb, qn2, v, *a: scored.append(len(qb) * len(v)) or full(qb, qn2, v, *a))
    best, rows = RunningTopK(k), np.arange(len(q))
    held = []
    for at in range(0, n, 3000):
        lists = pa.array([x.tolist() for x in v[at:at + 3000]], pa.list_(pa.float32()))
        held.append(Candidates(pa.array(ids[at:at + 3000]), lists, dim, space))
        local_hits(best, held[-1], q, rows, space, k, 1024)
    if scale == 1.0 or space == "cosine":  # by l2 the far ones all round to a score of 0, and only their ids tell them apart
        assert sum(scored) < 0.2 * n * len(q)
    assert best.floor(len(q)).shape == (len(q),)
    found = {}
    for b in best.batches(pa.array(rows), "id"):
        for r in b.to_pylist():
            found.setdefault(r["qid"], []).append((round(r["score"], 9), r["id"]))
    names = np.concatenate([h.ids.to_numpy(zero_copy_only=False) for h in held])
    for i, x in enumerate(q):
        s = np.concatenate([np.where(h.valid, full(x[None], (x * x).sum()[None], h.v, h.norm2, space)[0], -1.0) for h in held])
        assert sorted(found[i], key=lambda h: (-h[0], h[1])) == sorted(zip(np.round(s, 9), names), key=lambda h: (-h[0], h[1]))[:k]


def test_batch_search_equals_the_join_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(400)])
    share = 1.0 / np.arange(1, 401)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    rows = [(f"c{i:04d}", text(int(rng.integers(1, 60)))) for i in range(1500)]
    rows += [(f"d{i:04d}", rows[7][1]) for i in range(60)] + [("e", "onlyhere"), ("f", "")]
    records = spark.createDataFrame(rows, "chunk_id string, text string").coalesce(2)
    index: SearchIndex = build_index(records.withColumn("embedding", F.array(F.lit(0.0))), dim=1)
    queries = spark.createDataFrame([(i, text(12)) for i in range(80)] + [(80, rows[7][1]), (81, "onlyhere"), (82, "absent")],
                                    "qid long, query_text string")
    monkeypatch.setattr(kw, "BLOCK_CELLS", 4000)
    params = SearchParams(top_k=4)
    want = top_k(bm25_scores(index, query_terms(queries), params), 4)
    got = keyword_search_batch(index, queries, params)
    as_rows = lambda df: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 7)) for r in df.collect())
    assert as_rows(got) == as_rows(want)


def zipf_texts(rng, n, vocab=300, least=5, most=40):
    share = 1.0 / np.arange(1, vocab + 1)
    return [[f"w{i}" for i in rng.choice(vocab, int(rng.integers(least, most)), p=share / share.sum())] for _ in range(n)]


def query_weights(rng, n_queries, vocab=300):
    per_query = [np.sort(rng.choice(vocab, 12, replace=False, p=(p := 1.0 / np.arange(1, vocab + 1)) / p.sum())) for _ in range(n_queries)]
    term = np.concatenate(per_query).astype(np.int32)  # word i is the commoner, the less i is
    return kw.QueryWeights(pa.array([f"w{i}" for i in range(vocab)]), pa.array(np.arange(n_queries)), np.arange(n_queries + 1) * 12,
                           term, np.log(2.0 + term))


def batch_of(names, texts):
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts, pa.list_(pa.string()))], names=["id", "terms"])


@pytest.mark.parametrize("cells", [1 << 23, 128 * 100])
def test_queries_pass_over_common_words_and_lose_no_hit(monkeypatch, cells):
    monkeypatch.setattr(kw, "BLOCK_CELLS", cells)
    monkeypatch.setattr(kw, "LONG_LIST", 20)
    monkeypatch.setattr(kw, "DENSE_TERMS", 128)
    monkeypatch.setattr(kw, "QUERY_GROUP", 7)
    rng, bm25, k, avgdl = np.random.default_rng(8), BM25Params(), 3, 20.0
    texts = zipf_texts(rng, 1200) + [[], None]
    texts += [texts[5]] * 30                                   # exact copies: equal scores go by id
    names = [f"id{i:05d}" for i in rng.permutation(len(texts))]
    q = query_weights(rng, 40)
    batches = [batch_of(names[i:i + 500], texts[i:i + 500]) for i in range(0, len(texts), 500)]
    expected = {}
    for i in range(40):
        scores = []
        for name, text in zip(names, texts):
            s = sum(w * tf / (tf + bm25.k1 * (1.0 - bm25.b + bm25.b * len(text) / avgdl))
                    for t, w in zip(q.term[12 * i:12 * i + 12], q.w[12 * i:12 * i + 12]) if (tf := (text or []).count(f"w{t}")))
            if s:
                scores.append((-round(s, 9), name))
        expected[i] = [(name, -s) for s, name in sorted(scores)[:k]]
    some = batches[1]
    floor = kw.local_scores([some], q, k, bm25, avgdl, 64).floor(40)
    summed, bincount = [], np.bincount
    for start, first in ((None, 16), (None, None), (floor, None)):
        summed.clear()
        monkeypatch.setattr(kw.np, "bincount", lambda *a, **b: summed.append(len(a[0]) if len(a) > 1 else 0) or bincount(*a, **b))
        best = kw.local_scores(batches, kw.replace(q, floor=start), k, bm25, avgdl, first)
        monkeypatch.setattr(kw.np, "bincount", bincount)
        found = {}
        for b in best.batches(q.qids, "id"):
            for r in b.to_pylist():
                found.setdefault(r["qid"], []).append((r["id"], round(r["score"], 9)))
        assert {i: sorted(h, key=lambda x: (-x[1], x[0])) for i, h in found.items()} == expected
    postings = sum(len(set(text or []) & {f"w{t}" for t in q.term[12 * i:12 * i + 12]}) for i in range(40) for text in texts)
    assert 0 < sum(summed) < 0.6 * postings, (sum(summed), postings)


def test_a_batch_starts_from_the_scores_of_some_records(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(f"c{i:04d}", " ".join(t)) for i, t in enumerate(zipf_texts(rng, 900))]
    records = spark.createDataFrame(rows, "chunk_id string, text string").repartition(12)
    index = build_index(records, dim=4, embed=EmbedParams(dim=4), materialize_to=scratch_path(spark, "t-first"))
    queries = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(zipf_texts(rng, 150))], "qid long, query_text string")
    params, bounds = SearchParams(top_k=4), []
    want = top_k(bm25_scores(index, query_terms(queries), params), 4)
    monkeypatch.setattr(kw, "first_bounds", lambda *a, f=kw.first_bounds: bounds.append(f(*a)) or bounds[-1])
    as_rows = lambda df: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 7)) for r in df.collect())
    assert as_rows(keyword_search_batch(index, queries, params)) == as_rows(want)
    least = {r.qid: r.score for r in want.where("rank = 4").collect()}
    assert len(bounds) == 1 and np.isfinite(bounds[0]).mean() > 0.9 and len(bounds[0]) == 150
    assert max(bounds[0]) <= max(least.values()) + 1e-9
