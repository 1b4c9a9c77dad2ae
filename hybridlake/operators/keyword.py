"""Keyword leg: BM25 over the postings tables (OR over query terms, top-k).

score(q, d) = sum_t qtf(t) * ln(1 + (N - df + 0.5) / (df + 0.5))
                      * tf / (tf + k1 * (1 - b + b * dl / avgdl))

Three plans give the same hits. Over written postings a few queries are
answered by block-max pruning (``block_max_candidates``): only records that
can reach a query's top k are scored, from their terms. Without blocks the
query terms (small, size-checked) are broadcast and joined to ``term_stats``
and ``postings``. Large batches scan the records (``keyword_search_batch``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hybridlake.functions.text import analyze
from hybridlake.operators.index import SearchIndex, build_postings, impact, scan_tasks, term_bucket
from hybridlake.operators.knn import _first_k
from hybridlake.operators.topk import SCORE_DECIMALS, RunningTopK, settled, split_passes, top_k
from hybridlake.params import BM25Params, SearchParams
from hybridlake.session import lineage_dir

# Budget per (query, term) row of the broadcast side.
QUERY_TERM_BYTES = 96


def query_terms(queries: DataFrame, text_col: str = "query_text") -> DataFrame:
    return (queries.select("qid", F.explode(analyze(text_col)).alias("term"))
            .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))


def bm25_scores(index: SearchIndex, qterms: DataFrame, params: SearchParams) -> DataFrame:
    """Unranked (qid, id, score) for every document sharing a term with its query."""
    k1, b = params.bm25.k1, params.bm25.b
    stats = index.corpus_stats
    n = stats.select(F.col("n_docs").cast("double")).scalar()
    avgdl = stats.select("avgdl").scalar()
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = (F.broadcast(qterms).join(index.term_stats, "term")
               .select("qid", "term", (F.col("qtf") * idf).alias("w")))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    parts = (F.broadcast(weights).join(index.postings, "term")
             .select("qid", index.id_col, (F.col("w") * F.col("tf") / (F.col("tf") + norm)).alias("s")))
    return parts.groupBy("qid", index.id_col).agg(F.sum("s").alias("score"))


#: Postings of all query terms up to which the join's one pass beats the steps of pruning.
JOIN_MAX_PAIRS = 2_000_000
#: Terms of a query, and for each of them blocks, that give the first bound of its k-th score.
PROBE_TERMS = 8
#: Pairs of a query, for each hit wanted, that are scored in full for that bound.
LIKELY = 4
#: Scores are compared after rounding to 9 decimals; bounds leave room for that.
SLACK = 1e-6


@dataclass(frozen=True)
class Pruned:
    """What block-max pruning leaves of a query batch."""

    weights: DataFrame      # qid, term, w
    candidates: DataFrame   # qid, id: every hit of the top k is among them


def _written(df: DataFrame) -> DataFrame:
    lineage_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def block_max_candidates(index: SearchIndex, qterms: DataFrame, params: SearchParams) -> Pruned:
    """The (query, record) pairs that may be among a query's top k.

    A term's *reach* in a query is its weight times the greatest contribution
    of its blocks. (1) The best block of each query's farthest-reaching terms
    gives partial scores; the best of them are scored in full, and the k-th
    greatest is a bound that the top k must reach. (2) Terms whose reaches together stay below the bound can't make a
    hit by themselves; of the others, only blocks that reach the bound with all
    other terms of the query are read. (3) Pairs that stay below it with all
    that is left go. Every bound holds for any corpus statistics.
    """
    id_col = index.id_col
    n, avgdl = index.corpus_stats.select(F.col("n_docs").cast("double"), "avgdl").first()
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = _written(F.broadcast(qterms).join(index.term_stats, "term").select("qid", "term", (F.col("qtf") * idf).alias("w")))
    terms = F.broadcast(weights.select("term").distinct())
    heads = index.blocks.select("term", "max_tf", "min_dl").join(terms, "term", "left_semi")
    greatest = heads.groupBy("term").agg(F.max(impact("max_tf", "min_dl", avgdl, params.bm25)).alias("top"))
    of_query = Window.partitionBy("qid")
    reach = weights.join(F.broadcast(greatest), "term").withColumn("reach", F.col("w") * F.col("top"))
    reach = reach.withColumn("all", F.sum("reach").over(of_query)).withColumn(
        "place", F.row_number().over(of_query.orderBy(F.col("reach").desc(), "term"))).withColumn(
        "below", F.sum("reach").over(of_query.orderBy(F.col("reach").asc(), F.col("term").desc())))
    reach = _written(reach)

    def postings_in(blocks: DataFrame, *keep: str) -> DataFrame:
        """``qid, *keep, id, s`` of every posting of blocks that are joined to (query, term) rows."""
        each = blocks.select("qid", "w", *keep, F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return each.select("qid", *keep, F.col("p.ids").alias(id_col),
                           (F.col("w") * impact("p.tfs", "p.dls", avgdl, params.bm25)).alias("s"))

    probe = reach.where(F.col("place") <= PROBE_TERMS).select("qid", "term", "w")
    probed = F.broadcast(probe.select("term").distinct())
    whole = F.struct("ids", "tfs", "dls")
    best = index.blocks.join(probed, "term", "left_semi").groupBy("term").agg(
        F.max_by(whole, impact("max_tf", "min_dl", avgdl, params.bm25)).alias("b")).select("term", "b.*")
    first = postings_in(F.broadcast(probe).join(best, "term")).groupBy("qid", id_col).agg(F.sum("s").alias("s"))
    kth = lambda score: F.row_number().over(of_query.orderBy(F.col(score).desc()))
    likely = _written(first.withColumn("r", kth("s")).where(F.col("r") <= LIKELY * params.top_k).select("qid", id_col))
    full = score_pairs(index, likely, weights, avgdl, params)
    bound = full.withColumn("r", kth("score")).where(F.col("r") == params.top_k).select("qid", (F.col("score") - SLACK).alias("bound"))
    needed = reach.join(F.broadcast(bound), "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    needed = needed.where(F.col("below") >= F.col("bound"))  # the others can't reach it, all together
    # what the terms left out may add to a pair, and what other terms may add to a block
    left_out = F.col("all") - F.sum("reach").over(of_query)
    needed = _written(needed.select("qid", "term", "w", "bound", left_out.alias("rest"), (F.col("all") - F.col("reach")).alias("others")))
    reaching = F.broadcast(needed).join(index.blocks, "term").where(
        F.col("w") * impact("max_tf", "min_dl", avgdl, params.bm25) + F.col("others") >= F.col("bound"))
    scored = postings_in(reaching, "rest", "bound").groupBy("qid", id_col).agg(F.sum("s").alias("s"), F.first("rest").alias("rest"), F.first("bound").alias("bound"))
    candidates = scored.where(F.col("s") + F.col("rest") >= F.col("bound")).select("qid", id_col)
    return Pruned(weights, _written(candidates))


def score_pairs(index: SearchIndex, pairs: DataFrame, weights: DataFrame, avgdl: float, params: SearchParams) -> DataFrame:
    """``qid, id, score`` of (query, record) pairs that are written already, from the records' terms."""
    id_col = index.id_col
    small = pairs.count() * QUERY_TERM_BYTES <= params.max_broadcast_bytes
    wanted = pairs.select(id_col).distinct()
    records = index.records
    if index.id_buckets:
        buckets = [r[0] for r in wanted.select(term_bucket(id_col, index.id_buckets)).distinct().collect()]
        records = records.where(F.col("id_bucket").isin(buckets))
    held = records.select(id_col, "terms").join(F.broadcast(wanted) if small else wanted, id_col, "left_semi")
    held = build_postings(held, id_col).join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
    scored = held.join(F.broadcast(pairs) if small else pairs, id_col).join(F.broadcast(weights), ["qid", "term"])
    return scored.groupBy("qid", id_col).agg(F.sum(F.col("w") * impact("tf", "dl", avgdl, params.bm25)).alias("score"))


#: Candidate pairs up to which joining them to their records' terms beats scoring those records against the batch.
JOIN_MAX_CANDIDATES = 100_000


def block_max_search(index: SearchIndex, qterms: DataFrame, params: SearchParams) -> DataFrame:
    """Scores of the candidates.

    Long queries of common words leave many pairs, and a row for each pair and
    term of its record would be many times more. Then the candidates' records
    are scored against all queries of the batch, in matrices: that scores
    further pairs, which changes no top k, and no more than a scan would.
    """
    pruned = block_max_candidates(index, qterms, params)
    if pruned.candidates.count() <= JOIN_MAX_CANDIDATES:
        avgdl = index.corpus_stats.select("avgdl").first()[0]
        return score_pairs(index, pruned.candidates, pruned.weights, avgdl, params)
    wanted = _written(pruned.candidates.select(index.id_col).distinct())
    records = index.records
    if wanted.count() * QUERY_TERM_BYTES <= params.max_broadcast_bytes:
        records = records.join(F.broadcast(wanted), index.id_col, "left_semi")
    return keyword_search_batch(replace(index, records=records), qterms, params, qterms=qterms).drop("rank")


def keyword_search(index: SearchIndex, queries: DataFrame, params: SearchParams = SearchParams(),
                   text_col: str = "query_text", method: str = "auto") -> DataFrame:
    """Top-k BM25 hits: ``qid, <id>, score, rank``. No shared term, no hit.

    ``method``: ``"blocks"`` (block-max pruning over written postings),
    ``"join"`` (query terms joined to the postings; both read only the term
    buckets of the query terms, best for a few queries), ``"scan"``
    (partition-local scoring over the records' terms: best for large batches),
    or ``"auto"`` (by the number of query-term rows and of their postings).
    """
    qterms = query_terms(queries, text_col)
    n_rows = qterms.count()
    if method == "scan" or (method == "auto" and n_rows > JOIN_MAX_QUERY_TERMS and "terms" in index.records.columns):
        return keyword_search_batch(index, queries, params, text_col, qterms, n_rows)
    if method == "blocks" and index.blocks is None:
        raise ValueError("the index has no posting blocks: write it first (build_index, materialize_to)")
    if index.term_buckets:
        # A few queries: read only the term buckets they touch (partition pruning).
        buckets = [r[0] for r in qterms.select(term_bucket("term", index.term_buckets)).distinct().collect()]
        keep = lambda df: df if df is None else df.filter(F.col("term_bucket").isin(buckets))
        index = replace(index, postings=keep(index.postings), term_stats=keep(index.term_stats), blocks=keep(index.blocks))
    if method == "auto":
        pairs = F.broadcast(qterms).join(index.term_stats, "term").agg(F.sum("df")).first()[0] or 0
        method = "blocks" if index.blocks is not None and pairs > JOIN_MAX_PAIRS else "join"
    passes = split_passes(qterms, n_rows, QUERY_TERM_BYTES, params.max_broadcast_bytes)
    score = block_max_search if method == "blocks" else bm25_scores
    scored = reduce(DataFrame.unionByName, [score(index, p, params) for p in passes])
    return top_k(scored, params.top_k, tiebreak=index.id_col)


# -- batch path: partition-local exact scoring --------------------------------
#
# With many or long queries almost every (query, chunk) pair shares a term, and
# the join above materialises all of them. For such batches the query-term
# weights (size-checked) are broadcast instead, and every records partition
# computes the exact BM25 of its chunks against all queries, a block of rows at
# a time, emitting only its local top-k per query. Nothing but top-k rows
# leaves a task.
#
# Most pairs share common words only. Of a query's terms, from the commonest
# on, those that can't reach its k-th score so far even all together are passed
# over: a hit has one of the others, so only the postings of these are summed
# for all rows, and the rows that may still reach that score are scored in
# full. The first scores come from some records against which the queries are
# searched beforehand (``first_bounds``); the best of any records bound the best of all.

# Query-term rows above which the batch path is used (a few dozen queries).
JOIN_MAX_QUERY_TERMS = 4096
# Budget per (query, term) row of the batch path's broadcast: code, weight, and a share of the vocabulary.
SCAN_TERM_BYTES = 32
# Cells (common terms x records) of the table a task holds of a block of records, and its terms.
BLOCK_CELLS = 1 << 23
DENSE_TERMS = 128
# Postings of a term in a block that are added by themselves; shorter lists of a query go together.
LONG_LIST = 128
# Share of its score so far that the terms a query passes over may reach: with less, fewer records stay to be scored in full.
PASSED = 0.6
# Queries whose postings are looked up at a time, and hits of a block that wait to be ranked.
QUERY_GROUP = 1024
GATHERED = 1 << 20
# Records of the first bounds, at most, and how many others there are for each of them.
FIRST_RECORDS, FIRST_SHARE = 1 << 14, 32


@dataclass(frozen=True)
class QueryWeights:
    """One query pass: the weights of query ``i`` at ``indptr[i]`` to ``indptr[i + 1]``, its commonest term first."""

    vocab: pa.Array
    qids: pa.Array
    indptr: np.ndarray
    term: np.ndarray
    w: np.ndarray
    floor: np.ndarray | None = None   # of each query a score that its hits reach

    def fields(self) -> tuple:
        """What a broadcast holds: a worker knows this class from the function it runs only."""
        return self.vocab, self.qids, self.indptr, self.term, self.w, self.floor

    def part(self, lo: int, hi: int) -> QueryWeights:
        a, b = self.indptr[lo], self.indptr[hi]
        return replace(self, qids=self.qids.slice(lo, hi - lo), indptr=self.indptr[lo:hi + 1] - a, term=self.term[a:b], w=self.w[a:b])


def _blocks_of(batches: Iterable[pa.RecordBatch], vocab: pa.Array, most: int, first: int) -> Iterator[tuple]:
    """``ids, lengths, keys`` of ``first`` records, then four times as many and so on, ``most`` at most: a key is
    term * ``most`` + row, once for each place where a record has a term of ``vocab``."""
    held, n, size = [], 0, min(first, most)
    whole = lambda: (pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2)))
    for big in batches:
        at = 0
        while at < big.num_rows:
            rb = big.slice(at, size - n)
            lengths = pc.fill_null(pc.list_value_length(rb.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(rb.column(1))
            j = pc.index_in(flat, value_set=vocab if vocab.type == flat.type else vocab.cast(flat.type))
            rows = np.repeat(np.arange(n, n + rb.num_rows), lengths)[j.is_valid().to_numpy(zero_copy_only=False)]
            held.append((rb.column(0), lengths, j.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) * most + rows))
            at, n = at + rb.num_rows, n + rb.num_rows
            if n == size:
                yield whole()
                held, n, size = [], 0, min(most, 4 * size)
    if n:
        yield whole()


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[i]`` to ``starts[i] + counts[i]`` of every i, one behind the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def local_scores(batches: Iterable[pa.RecordBatch], q: QueryWeights, k: int, bm25: BM25Params, avgdl: float, first: int | None = None) -> RunningTopK:
    """The k best records (id, terms) of each query by BM25, in blocks of ``first`` records and more."""
    most = max(1, BLOCK_CELLS // DENSE_TERMS)
    nq, best = len(q.qids), RunningTopK(k, q.floor)
    for ids, lengths, keys in _blocks_of(batches, q.vocab, most, first or most):
        if not len(keys):
            continue
        block = _Postings.of(keys, lengths, len(q.vocab), most, bm25, avgdl)
        names = ids.to_numpy(zero_copy_only=False)
        id_rank = np.empty(len(names), dtype=np.int64)
        id_rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        floor = best.floor(nq)
        need = np.full(nq, -np.inf) if floor is None else floor - SLACK
        found, n_found = [], 0
        for lo in range(0, nq, QUERY_GROUP):
            hi = min(nq, lo + QUERY_GROUP)
            for i, rows, scores in _reaching(block, q.part(lo, hi), need[lo:hi], k):
                found.append((np.full(len(rows), lo + i), rows, scores))
                n_found += len(rows)
            if found and (n_found > GATHERED or hi == nq):
                qi, bi, s = (np.concatenate(x) for x in zip(*found))
                keep = _first_k(qi, bi, np.round(s, SCORE_DECIMALS), id_rank, k)
                best.add(qi[keep], ids.take(pa.array(bi[keep])), s[keep])
                found, n_found = [], 0
    return best


@dataclass(frozen=True)
class _Postings:
    """A block of records by term: the postings of term ``t`` at ``starts[t]`` to ``starts[t + 1]``."""

    starts: np.ndarray
    row: np.ndarray
    part: np.ndarray     # what a posting adds to a score, but for its term's weight
    top: np.ndarray      # a term's greatest part
    column: np.ndarray   # a common term's place in dense, -1 of others
    dense: np.ndarray    # the parts of common terms, by row

    @classmethod
    def of(cls, keys: np.ndarray, lengths: np.ndarray, terms: int, most: int, bm25: BM25Params, avgdl: float) -> _Postings:
        keys, tf = np.unique(keys, return_counts=True)
        code, row = keys // most, keys % most
        part = tf / (tf + bm25.k1 * ((1.0 - bm25.b) + bm25.b * lengths[row] / avgdl))
        held = np.bincount(code, minlength=terms)
        starts = np.append(0, np.cumsum(held))
        present = np.flatnonzero(held)
        top = np.zeros(terms)
        top[present] = np.maximum.reduceat(part, starts[present])
        common = present[np.argsort(-held[present], kind="stable")[:DENSE_TERMS]]
        column = np.full(terms, -1)
        column[common] = np.arange(len(common))
        dense = np.zeros((len(common), len(lengths)))
        for c, t in enumerate(common):
            dense[c, row[starts[t]:starts[t + 1]]] = part[starts[t]:starts[t + 1]]
        return cls(starts, row.astype(np.uint16 if most <= 1 << 16 else np.int64), part, top, column, dense)


def _reaching(block: _Postings, q: QueryWeights, need: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``query, rows, scores`` of the rows whose scores reach ``need`` of their query, and are no less than its k-th in the block."""
    nq = len(q.qids)
    of, held = np.repeat(np.arange(nq), np.diff(q.indptr)), np.diff(block.starts)[q.term]
    live = held > 0
    of, count, term, w = of[live], held[live], q.term[live], q.w[live]
    if not len(of):
        return
    start, col, reach = block.starts[term], block.column[term], w * block.top[term]
    at = np.searchsorted(of, np.arange(nq + 1))
    # the terms that are passed over: a query's first ones, common, that reach a share of its score so far all together
    summed = np.append(0.0, np.cumsum(reach))
    must = np.flatnonzero(np.append((col < 0) | (summed[1:] - summed[at[of]] >= PASSED * need[of]), True))
    split = np.minimum(at[1:], must[np.searchsorted(must, at[:-1])])
    below = summed[split] - summed[at[:-1]]
    least = np.maximum(need - below - SLACK, np.finfo(np.float64).tiny)  # SLACK is far more than sums are rounded by
    rest = np.arange(len(of)) >= split[of]
    short, long = np.flatnonzero(rest & (count <= LONG_LIST)), np.flatnonzero(rest & (count > LONG_LIST))
    short_to = np.append(0, np.cumsum(count[short]))[np.searchsorted(short, at)]
    places = _ragged(start[short], count[short])
    short_row, short_part = block.row[places], block.part[places] * np.repeat(w[short], count[short])
    long_to = np.searchsorted(long, at)
    lists = list(zip(start[long].tolist(), (start[long] + count[long]).tolist(), w[long].tolist()))
    passed = list(zip(col.tolist(), w.tolist(), reach.tolist()))
    size = int((np.diff(np.append(0, np.cumsum(count[long]))[long_to]) + np.diff(short_to)).max())
    row, part = np.empty(size, np.int64), np.empty(size)
    short_to, long_to, at, split, below = (x.tolist() for x in (short_to, long_to, at, split, below))
    for i in range(nq):
        m = short_to[i + 1] - short_to[i]
        row[:m], part[:m] = short_row[short_to[i]:short_to[i + 1]], short_part[short_to[i]:short_to[i + 1]]
        for a, b, weight in lists[long_to[i]:long_to[i + 1]]:
            end = m + b - a
            row[m:end] = block.row[a:b]
            np.multiply(block.part[a:b], weight, out=part[m:end])
            m = end
        if not m:
            continue
        score = np.bincount(row[:m], part[:m])
        rows = np.flatnonzero(score >= least[i])
        s, left = score[rows], below[i]
        for c, weight, most in reversed(passed[at[i]:split[i]]):
            if not len(rows):
                break
            s += weight * block.dense[c][rows]
            left -= most
            keep = s >= need[i] - left - SLACK
            rows, s = rows[keep], s[keep]
        if len(rows) > 4 * k:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k] - SLACK
            rows, s = rows[keep], s[keep]
        if len(rows):
            yield i, rows, s


def _scan_fn(shared, id_col: str, k: int, bm25: BM25Params, avgdl: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = QueryWeights(*shared.value)
        yield from local_scores(batches, q, k, bm25, avgdl, None if q.floor is not None else FIRST_BLOCK).batches(q.qids, id_col)
    return fn


#: Records of the first block of a task without first bounds.
FIRST_BLOCK = 512


def first_records(index: SearchIndex) -> pa.RecordBatch:
    """Some records, that a search of all of them has among the others too."""
    some = index.records
    if index.id_buckets and "id_bucket" in some.columns:
        some = some.where(F.col("id_bucket") == 0)
    n = index.corpus_stats.select("n_docs").first()[0]
    held = some.select(index.id_col, "terms").limit(min(FIRST_RECORDS, 1 + n // FIRST_SHARE)).toArrow().combine_chunks().to_batches()
    return held[0] if held else None


def first_bounds(spark: SparkSession, q: QueryWeights, some: pa.RecordBatch | None, k: int, bm25: BM25Params, avgdl: float) -> np.ndarray | None:
    """Of each query its k-th score in ``some`` records, -inf for fewer. Every task has some of the queries."""
    if some is None or not len(q.qids):
        return None
    parts = max(1, min(len(q.qids) // 64, 2 * spark.sparkContext.defaultParallelism))
    cuts = [len(q.qids) * i // parts for i in range(parts + 1)]
    shared = spark.sparkContext.broadcast((q.fields(), some))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in rb.column(0).to_pylist():
                fields, held = shared.value
                own = QueryWeights(*fields).part(cuts[i], cuts[i + 1])
                floor = local_scores([held], own, k, bm25, avgdl, FIRST_BLOCK).floor(len(own.qids))
                if floor is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(cuts[i], cuts[i + 1])), pa.array(floor)], names=["at", "floor"])

    found = spark.range(0, parts, 1, parts).mapInArrow(fn, "at long, floor double").toArrow()
    shared.destroy()
    floor = np.full(len(q.qids), -np.inf)
    floor[found.column("at").to_numpy()] = found.column("floor").to_numpy()
    return floor


def _query_weights(index: SearchIndex, qterms: DataFrame, params: SearchParams) -> QueryWeights | None:
    """One (size-checked) query pass on the driver."""
    n = index.corpus_stats.select(F.col("n_docs").cast("double")).scalar()
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wt = (F.broadcast(qterms).join(index.term_stats, "term")
          .select("qid", "term", (F.col("qtf") * idf).alias("w"), "df")).toArrow()
    if wt.num_rows == 0:
        return None
    terms, known = (wt.column(c).combine_chunks().dictionary_encode() for c in ("term", "qid"))
    of = known.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((-wt.column("df").to_numpy(), of))
    indptr = np.searchsorted(of[order], np.arange(len(known.dictionary) + 1))
    return QueryWeights(terms.dictionary, known.dictionary, indptr, terms.indices.to_numpy(zero_copy_only=False).astype(np.int32)[order],
                        wt.column("w").to_numpy()[order])


def keyword_search_batch(index: SearchIndex, queries: DataFrame, params: SearchParams = SearchParams(),
                         text_col: str = "query_text", qterms: DataFrame | None = None,
                         n_rows: int | None = None) -> DataFrame:
    """Same hits as ``keyword_search`` via partition-local scoring."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = queries.sparkSession
    qterms = qterms if qterms is not None else query_terms(queries, text_col)
    n_rows = n_rows if n_rows is not None else qterms.count()
    avgdl = index.corpus_stats.select("avgdl").first()[0]
    slim = index.records.select(index.id_col, "terms").coalesce(scan_tasks(index))
    schema = StructType([StructField("qid", queries.schema["qid"].dataType), StructField(index.id_col, slim.schema[index.id_col].dataType),
                         StructField("score", DoubleType())])
    parts = []
    passes = split_passes(qterms, n_rows, SCAN_TERM_BYTES, params.max_broadcast_bytes)
    some = first_records(index)
    for p in passes:
        weights = _query_weights(index, p, params)
        if weights is None:
            continue
        bounded = replace(weights, floor=first_bounds(spark, weights, some, params.top_k, params.bm25, avgdl))
        shared = spark.sparkContext.broadcast(bounded.fields())
        hits = slim.mapInArrow(_scan_fn(shared, index.id_col, params.top_k, params.bm25, avgdl), schema)
        parts.append(settled(hits, shared, len(passes), params.top_k, index.id_col))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(None).cast("bigint"))
    return top_k(reduce(DataFrame.unionByName, parts), params.top_k, tiebreak=index.id_col)
