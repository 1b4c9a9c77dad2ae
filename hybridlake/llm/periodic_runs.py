"""Periodic run detection (operator 13) by multi-scale minimizers.

A run is a maximal stretch of words that repeats with a period. Documents of an
Arrow batch are laid end to end, each closed by a symbol of its own, so that no
repeat crosses documents, and are searched together:

* periods below ``DIRECT`` by comparing the words with themselves at each lag;
* at every scale (``least`` to twice ``least``) by window minima of k-gram
  hashes. Windows a period apart inside a run hold the same k-grams, so their
  leftmost minima lie a period apart as well. Places with equal minima, chained
  where they follow each other evenly, are paired; each pair's distance is a
  candidate period, extended both ways as far as the words agree.

Each candidate stretch is compared word by word before it counts, and of the
periods found for one stretch the smallest is the run's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import in_batches, keyed, raw_texts

#: Shortest run; a run also has two periods at least.
LEAST_LENGTH = 12
#: Periods below are found by direct lag scans.
DIRECT = 16
#: Words searched together; a longer document is searched alone.
BLOCK_WORDS = 200_000

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])

#: Bases of the stretches' hashes, one after another where two stretches collide; odd, so that powers never vanish.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(codes, base):
    """Well-spread 64-bit codes of small integers."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * base
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Polynomial hashes of every stretch of a word sequence, modulo 2**64."""

    def __init__(self, codes, base: int = BASES[0]):
        n, base = len(codes), np.uint64(base)
        self.power = np.empty(n + 1, np.uint64)
        self.power[0] = 1
        self.power[1:] = base
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(codes, base) * self.power[:n], out=self.sums[1:])

    def grams(self, k: int, end: int):
        """Place-independent hashes of the k-grams that start before ``end - k + 1``."""
        at = self.sums[k:end + 1] - self.sums[:end + 1 - k]
        return at * self.power[end - k::-1] if len(at) else at

    def equal(self, a, lag, length):
        """Whether the ``length`` words from ``a`` are those ``lag`` words later."""
        here = self.sums[a + length] - self.sums[a]
        there = self.sums[a + lag + length] - self.sums[a + lag]
        return here * self.power[lag] == there

    def reach(self, at, lag, most, step: int):
        """Words that agree at ``lag`` from ``at`` on (``step`` 1) or up to it (-1), at most ``most``."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.equal(at if step > 0 else at - middle, lag, middle)
            low, high = np.where(same & open_, middle, low), np.where(same | ~open_, high, middle - 1)


def _leftmost_minima(keys, width: int):
    """Least key of each window of ``width``: minima from both ends of blocks as long as the window."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def minimizers(grams, width: int):
    """Places of the leftmost least k-gram of each window, ascending."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    place = np.arange(len(grams), dtype=np.uint64)
    keys = ((grams * _MIX) & np.uint64(0xFFFFFFFF00000000)) | place
    found = (_leftmost_minima(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return found[np.append(True, found[1:] != found[:-1])]


def seeds(grams, places, k: int, least: int):
    """(place, lag) pairs that stand for every two equal minima ``least`` to ``2 * least - 1`` apart.

    Places of one k-gram that follow each other at one small distance form a
    chain; between two chains of equal step each lag needs one pair only, as
    its pairs lie in one stretch. Two places of one chain are a multiple of its
    step apart, which is no smallest period.
    """
    none = np.zeros(0, np.int64)
    order = np.argsort(grams[places], kind="stable")
    at, name = places[order], grams[places][order]
    if len(at) < 2:
        return none, none
    gap = np.where(name[1:] == name[:-1], at[1:] - at[:-1], 0)
    near = (gap > 0) & (gap <= k // 2)
    begins = np.ones(len(at), bool)
    begins[1:] = ~near
    begins[2:] |= near[:-1] & (gap[1:] != gap[:-1])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(at)) - 1
    step = np.where(last > first, gap[np.minimum(first, len(gap) - 1)], 0)
    low, high, chain_name = at[first], at[last], name[first]
    found_at, found_lag = [], []
    left = np.arange(len(first) - 1)
    hop = 1
    while len(left):
        right = left + hop
        # chains of one name come by place: once too far, later ones are farther
        near_by = (chain_name[left] == chain_name[right]) & (low[right] - high[left] < 2 * least)
        left, right = left[near_by], right[near_by]
        uneven = (step[left] > 0) & (step[right] > 0) & (step[left] != step[right])
        for i, j in zip(left[uneven], right[uneven]):  # short remains at the ends of a chain
            x, y = np.meshgrid(at[first[i]:last[i] + 1], at[first[j]:last[j] + 1])
            found_at.append(x.ravel())
            found_lag.append((y - x).ravel())
        a, b = left[~uneven], right[~uneven]
        by = np.maximum(np.maximum(step[a], step[b]), 1)
        nearest, farthest = low[b] - high[a], high[b] - low[a]
        skip = np.maximum(0, -(-(least - nearest) // by))
        lags = np.maximum(0, (np.minimum(farthest, 2 * least - 1) - nearest) // by - skip + 1)
        pair = np.repeat(np.arange(len(a)), lags)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(lags) - lags, lags)
        lag = nearest[pair] + (skip[pair] + within) * by[pair]
        found_at.append(np.maximum(low[a][pair], low[b][pair] - lag))
        found_lag.append(lag)
        hop += 1
        left = left[left + hop < len(first)]
    x, lag = np.concatenate(found_at or [none]), np.concatenate(found_lag or [none])
    fits = (lag >= least) & (lag < 2 * least)
    return x[fits], lag[fits]


def runs(codes, sizes, bases: tuple[int, ...] = BASES):
    """``(start, end, period)`` arrays of all runs of documents laid end to end.

    ``codes`` are the words, the documents' ``sizes`` being in descending order.
    Places are those in ``codes``; rows come by start, then period.
    """
    sizes = np.asarray(sizes, np.int64)
    n = int(sizes.sum())
    codes = np.asarray(codes, np.int64)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    starts = np.cumsum(sizes) - sizes
    # one symbol of its own behind each document
    document = np.repeat(np.arange(len(sizes)), sizes)
    apart = np.empty(n + len(sizes), np.int64)
    apart[np.arange(n) + document] = codes
    apart[starts + np.arange(len(sizes)) + sizes] = -1 - np.arange(len(sizes))
    spread = sizes + 1
    stops = np.cumsum(spread)
    found = []
    for q in range(1, DIRECT):
        least = max(LEAST_LENGTH, 2 * q) - q
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (apart[q:] == apart[:-q]).view(np.int8), [0]))))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= least
        found.append((begin[long], end[long] + q, np.full(int(long.sum()), q)))
    if sizes[0] >= 2 * DIRECT:
        prefixes = Prefixes(apart, bases[0])
        owner = np.repeat(np.arange(len(sizes)), spread)
        least = DIRECT
        while 2 * least <= sizes[0]:
            end = int(stops[np.searchsorted(-sizes, -2 * least, side="right") - 1])  # longer documents come first
            k = least // 4
            grams = prefixes.grams(k, end)
            x, lag = seeds(grams, minimizers(grams, least - k + 1), k, least)
            inside = x + lag < end
            x, lag = x[inside], lag[inside]
            same = owner[x] == owner[x + lag]
            x, lag = x[same], lag[same]
            if len(x):
                begin, stop = (stops - spread)[owner[x]], (stops - 1)[owner[x]]
                right = prefixes.reach(x, lag, stop - x - lag, 1)
                left = prefixes.reach(x, lag, x - begin, -1)
                begin, stop = x - left, x + right + lag
                long = stop - begin >= 2 * lag
                found.append((begin[long], stop[long], lag[long]))
            least *= 2
    begin, stop, period = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((period, stop, begin))
    begin, stop, period = begin[order], stop[order], period[order]
    fresh = np.ones(len(begin), bool)  # the smallest period of a stretch
    fresh[1:] = (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
    begin, stop, period = begin[fresh], stop[fresh], period[fresh]
    exact = [q < DIRECT or (np.array_equal(apart[a:b - q], apart[a + q:b]) and not (
        (a and apart[a - 1] == apart[a - 1 + q]) or (b < len(apart) and apart[b] == apart[b - q])))
        for a, b, q in zip(begin.tolist(), stop.tolist(), period.tolist())]
    if not all(exact):  # two different stretches have one hash
        return runs(codes, sizes, bases[1:])
    order = np.lexsort((period, begin))
    begin, stop, period = begin[order], stop[order], period[order]
    shift = np.searchsorted(stops, begin, side="right")  # the symbols between
    return begin - shift, stop - shift, period


def dropped(begin, stop, period, n: int):
    """Which of ``n`` words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin + period, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_tail(n: int, seed: int) -> tuple[int, int] | None:
    """(first word, period) of the tail that a planted document repeats; None leaves it as it is."""
    if seed % 10 or not n:
        return None
    g = seed // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed_col: Column | None = None) -> DataFrame:
    """``doc_id, n_words, runs, kept`` of every row: all runs by start, then period, and
    the words that no run holds after its first period, joined by a blank.

    ``seed_col``, if given, plants periodic tails first (``periodic_tail``). A
    null or empty text has no words and no runs; repeated rows each get their
    row; a null id stays null. A document is searched in one task, in memory
    that grows with its words.
    """
    source = keyed(docs, id_col, text_col)
    if seed_col is not None:
        source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                             seed_col.cast("long").alias("seed"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("kept", T.StringType())])
    arrow = to_arrow_schema(schema)

    def found(block: list[tuple]) -> Iterator[tuple]:
        """Rows of ``(doc, words, seed)``, longest first so that each scale meets the first of them only."""
        order = sorted(range(len(block)), key=lambda i: -len(block[i][1]))
        names: dict[bytes, int] = defaultdict(count().__next__)
        texts, places = [], []
        for i in order:
            _, words, seed = block[i]
            tail = periodic_tail(len(words), seed) if seed is not None else None
            if tail:
                a, p = tail
                words = words[:a] + [words[a + j % p] for j in range(len(words) - a)]
            texts.append(words)
            places.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
        sizes = np.array([len(words) for words in texts], np.int64)
        begin, stop, period = runs(np.concatenate(places), sizes)
        gone = dropped(begin, stop, period, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        cut = np.searchsorted(begin, np.append(starts, sizes.sum()))
        rows = [None] * len(block)
        for at, i in enumerate(order):
            first, end = cut[at], cut[at + 1]
            words, start = texts[at], int(starts[at])
            kept = words
            if end > first:
                keep = ~gone[start:start + len(words)]
                kept = [w for w, k in zip(words, keep.tolist()) if k]
            own = [{"start": b - start, "length": s - b, "period": p} for b, s, p in zip(
                begin[first:end].tolist(), stop[first:end].tolist(), period[first:end].tolist())]
            rows[i] = (block[i][0], len(words), own, b" ".join(kept).decode())
        yield from rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, held = [], 0
            seeded = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for doc, raw, seed in zip(batch.column(0).to_pylist(), raw_texts(batch), seeded):
                words = raw.split()  # on the six ASCII white-space characters
                if block and held + len(words) > BLOCK_WORDS:
                    yield from in_batches(found(block), arrow)
                    block, held = [], 0
                block.append((doc, words, seed))
                held += len(words)
            if block:
                yield from in_batches(found(block), arrow)

    return source.mapInArrow(run, schema)


def longest(column: str) -> Column:
    """The run with the greatest length; ties go to the smallest start, then period. Null without runs."""
    ranked = F.transform(column, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(ranked)
    return F.when(F.size(column) > 0, F.struct(best["s"].alias("start"), (-best["l"]).alias("length"),
                                               best["p"].alias("period")))


def listed(column: str) -> Column:
    """``start,length,period`` and a newline for every run."""
    return F.concat_ws("", F.transform(column, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
