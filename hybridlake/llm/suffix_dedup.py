"""Suffix-array dedup (operator 5): long repeated byte strings across a corpus.

Every string of ``min_bytes`` holds an anchor: a gram of half that length whose
rolling hash is least in its window, so equal strings have equal anchors at the
same place. Anchors with one gram form a bucket of suffixes. Contexts that
occur twice as they are need no more work; the distinct contexts of a bucket
form an enhanced suffix array, sorted by what follows the gram. A stack scan
goes through its common-prefix interval tree, whose intervals are the
right-maximal repeats, and compares the members' left contexts within each: a
repeat is maximal if its occurrences differ on both sides. Each such group is
written with all contexts it occurs in; ``repeat_groups`` lists the occurrences.
Removal takes the union of their spans, which is formed where the groups are
found and written beside them: a row for each context, however many groups it
is in. A bucket of more than
``GROUP_CONTEXTS`` different contexts is resolved by counting its strings of
``min_bytes`` instead, spread over all tasks.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import in_batches, keyed, raw_texts, stored, text_key
from hybridlake.llm.suffixes import intervals

if TYPE_CHECKING:
    import numpy as np

MIN_BYTES = 400
#: Distinct contexts of a bucket that one suffix array holds.
GROUP_CONTEXTS = 20_000
#: Members of the groups that are handed back to Spark at a time.
OUT_MEMBERS = 100_000
#: Members in one row: a larger group takes several, as readers hold thousands of rows at once.
ROW_MEMBERS = 1_000
#: Bytes hashed at a time; the blocks of a longer text overlap.
BLOCK_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _tables():
    import numpy as np

    rng = np.random.default_rng(5)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    power = lambda base: np.cumprod(np.concatenate(
        (np.ones(1, np.uint64), np.full(BLOCK_BYTES, base, np.uint64))), dtype=np.uint64)
    return value, power(np.uint64(_MULTIPLIER)), power(np.uint64(pow(_MULTIPLIER, -1, 1 << 64)))


def _sliding(values, width: int, reduce):
    """``reduce`` (minimum or maximum) over each window, by block prefixes and suffixes."""
    import numpy as np

    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, values[-1], values.dtype)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    forth = reduce.accumulate(square, axis=1).ravel()
    back = reduce.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(back[:n - width + 1], forth[width - 1:n])


def _anchors(block: bytes, gram: int, window: int):
    """Places of the grams that are least, by hash, in a window of ``window`` of them."""
    import numpy as np

    value, power, inverse = _tables()
    n = len(block) - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(value[np.frombuffer(block, np.uint8)] * power[:len(block)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * inverse[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MULTIPLIER)
    least = _sliding(h, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    highest = _sliding(np.concatenate([edge, least, edge]), window, np.maximum)
    return np.flatnonzero(highest == h)


def anchors(text: bytes, gram: int, window: int) -> list[int]:
    span = gram + window - 1
    if len(text) <= BLOCK_BYTES:
        return _anchors(text, gram, window).tolist()
    found: set[int] = set()
    for at in range(0, len(text) - span + 1, BLOCK_BYTES - span):
        found.update((at + _anchors(text[at:at + BLOCK_BYTES], gram, window)).tolist())
    return sorted(found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def anchor_table(docs: DataFrame, min_bytes: int) -> DataFrame:
    """``doc_id, key, place, gram, context`` (hashes) of every anchor of ``docs(doc_id, key, text)``."""
    gram = min_bytes // 2
    side, window = min_bytes - gram, min_bytes - gram + 1
    schema = T.StructType([docs.schema["doc_id"], T.StructField("key", T.LongType()),
                           T.StructField("place", T.LongType()), T.StructField("gram", T.LongType()),
                           T.StructField("context", T.LongType())])
    arrow = to_arrow_schema(schema)
    digest = xxhash.xxh3_64_intdigest

    def rows(batch: pa.RecordBatch):
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch)):
            for at in anchors(text, gram, window):
                before = min(at, side)
                yield (doc, key, at, _signed(digest(text[at:at + gram])),
                       _signed(digest(text[at - before:at + min_bytes], before)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(rows(batch), arrow)

    return docs.select("doc_id", "key", "text").mapInArrow(run, schema)


def _common(rows, lengths):
    """Common prefix length of each row of a padded byte matrix and the one before; 0 for the first."""
    import numpy as np

    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate(([0], np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))))


def _matrix(parts: list[bytes], width: int):
    import numpy as np

    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width), lengths


def maximal_repeats(lefts: list[bytes], rights: list[bytes], need: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, right, members) of every maximal repeat around a gram that all contexts share.

    ``lefts`` are reversed. ``left + right`` is ``need`` at least: the bytes
    that a repeat has beside the gram. Contexts count as different beyond their ends.
    What two left contexts share is the least that neighbours between them share.
    """
    import numpy as np

    right, right_len = _matrix(rights, need)
    left, left_len = _matrix(lefts, need)
    by_right = np.array(sorted(range(len(rights)), key=rights.__getitem__), np.int64)
    by_left = np.array(sorted(range(len(lefts)), key=lefts.__getitem__), np.int64)
    left_rank = np.empty(len(lefts), np.int64)
    left_rank[by_left] = np.arange(len(lefts))
    lcp = _common(right[by_right], right_len[by_right])
    left_lcp = _common(left[by_left], left_len[by_left])
    ranks_by_right = left_rank[by_right]
    # the gram itself is common to all: depths count from one, so that its interval is found too
    for depth, first, end, _ in intervals(np.append(lcp + 1, 0)[:len(lcp)] * (np.arange(len(lcp)) > 0), 1):
        depth -= 1
        least = need - depth
        if end - first == 2:
            x, y = sorted(ranks_by_right[first:end].tolist())
            common = int(left_lcp[x + 1:y + 1].min())
            if common >= least:
                yield common, depth, by_left[[x, y]]
            continue
        ranks = ranks_by_right[first:end]
        order = np.argsort(ranks)
        ranks = ranks[order]
        shared = np.zeros(len(ranks), np.int64)
        shared[1:] = np.minimum.reduceat(left_lcp[:ranks[-1] + 1], ranks[:-1] + 1)
        if shared.max() < least:
            continue
        cut = lcp[first:end] == depth  # a new child begins
        cut[0] = False
        child = np.cumsum(cut)[order]
        turns = np.flatnonzero(child[1:] != child[:-1]) + 1
        # where the members from here on are of more than one child
        other = np.append(turns, len(child))[np.searchsorted(turns, np.arange(len(child)), "right")].tolist()
        members = by_left[ranks]
        for left_depth, a, b, _ in intervals((shared + 1) * (np.arange(len(shared)) > 0), least + 1):
            if other[a] < b:
                yield left_depth - 1, depth, members[a:b]


def furthest(lefts: list[bytes], rights: list[bytes], need: int) -> list[tuple[int, int]]:
    """Of each context the (left, right) reach of its repeats, (-1, -1) if it has none.

    A second way to the union of ``maximal_repeats``, which the tests hold it
    against; no query takes it.

    The stack holds the open intervals' members by the order of their left
    contexts. When two children of an interval meet, each member of the smaller
    looks at its neighbours in the larger: whoever lies beyond shares less with
    it than with them.
    """
    import numpy as np

    right, right_len = _matrix(rights, need)
    left, left_len = _matrix(lefts, need)
    by_right = sorted(range(len(rights)), key=lambda i: rights[i])
    by_left = sorted(range(len(lefts)), key=lambda i: lefts[i])
    rank = [0] * len(lefts)
    for r, i in enumerate(by_left):
        rank[i] = r
    depths = _common(right[by_right], right_len[by_right]).tolist()
    shared = _common(left[by_left], left_len[by_left])
    reach_left, reach_right = [-1] * len(lefts), [-1] * len(lefts)  # by left rank

    def meet(a: int, b: int, depth: int) -> None:
        common = int(shared[b]) if b == a + 1 else int(shared[a + 1:b + 1].min())
        if common + depth >= need:
            for x in (a, b):
                reach_left[x], reach_right[x] = max(reach_left[x], common), max(reach_right[x], depth)

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            at = bisect(a, x)
            if at:
                meet(a[at - 1], x, depth)
            if at < len(a):
                meet(x, a[at], depth)
        a.extend(b)
        a.sort()
        return a

    stack, between = [[rank[by_right[0]]]], []
    for i, depth in zip(by_right[1:], depths[1:]):
        while between and between[-1] > depth:
            last = stack.pop()
            stack[-1] = join(stack[-1], last, between.pop())
        stack.append([rank[i]])
        between.append(depth)
    while between:
        last = stack.pop()
        stack[-1] = join(stack[-1], last, between.pop())
    return [(reach_left[r], reach_right[r]) for r in rank]


def contexts_of(docs: DataFrame, chosen: DataFrame, min_bytes: int) -> DataFrame:
    """``gram, context, contexts, check, before, after`` of ``chosen(doc_id, key, place, gram, context, contexts)``."""
    gram = min_bytes // 2
    side = min_bytes - gram
    wanted = chosen.groupBy("doc_id", "key").agg(F.collect_list(F.struct("place", "gram", "context", "contexts")).alias("at"))
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "at")
    joined = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["key"] == wanted["_key"]))
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("gram", "context", "contexts", "check")),
                           T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def rows(batch: pa.RecordBatch):
        for at, text in zip(batch.column(0).to_pylist(), raw_texts(batch)):
            for a in at:
                p = a["place"]
                yield (a["gram"], a["context"], a["contexts"], _signed(xxhash.xxh64_intdigest(text[p:p + gram], 1)),
                       text[max(0, p - side):p][::-1], text[p + gram:p + gram + side])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(rows(batch), arrow, 5_000)

    # repeated rows would bring a context twice
    return joined.dropDuplicates(["_id", "_key"]).select("at", "text").mapInArrow(run, schema)


_REACH = T.StructType([T.StructField(c, T.LongType()) for c in ("context", "left", "right")])
_GROUP = T.StructType([*(T.StructField(c, T.LongType()) for c in ("gram", "group", "left", "right")),
                       T.StructField("members", T.ArrayType(T.LongType())), T.StructField("reached", T.ArrayType(_REACH))])


def bucket_groups(gram: int, contexts: tuple[int, ...], lefts: tuple[bytes, ...], rights: tuple[bytes, ...], need: int,
                  out_members: int, row_members: int) -> Iterator[tuple]:
    """The maximal repeats of a bucket, in blocks of about ``out_members`` members for ``_group_batch``.

    A group of more than ``row_members`` takes several rows. The bucket's last
    block also has how far each context reaches in all of the groups.
    """
    import numpy as np

    names = np.array(contexts, np.int64)
    reach = np.full((2, len(names)), -1, np.int64)

    def block(held: list[tuple]) -> tuple:
        numbers, left, right, members = zip(*held)
        lengths = np.fromiter(map(len, members), np.int64, len(members))
        members = np.concatenate(members)
        for side, depths in zip(reach, (left, right)):
            np.maximum.at(side, members, np.repeat(np.array(depths, np.int64), lengths))
        return [gram] * len(held), numbers, left, right, lengths, names[members]

    held, size = [], 0
    for number, (left, right, members) in enumerate(maximal_repeats(lefts, rights, need)):
        for part in np.array_split(members, -(-len(members) // row_members)) if len(members) > row_members else [members]:
            if size >= out_members:
                yield *block(held), ()
                held, size = [], 0
            held.append((number, left, right, part.astype(np.int32)))  # a copy: else the whole interval's stay
            size += len(part)
    if held:
        last, there = block(held), np.flatnonzero(reach[0] >= 0)
        yield *last, (names[there], *reach[:, there])


def _group_batch(blocks: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """The members stay numbers of numpy's and Arrow's: there are many more of them than contexts."""
    import numpy as np

    *columns, lengths, members, reached = zip(*blocks)
    sizes = np.zeros(sum(map(len, lengths)), np.int64)
    sizes[np.cumsum(list(map(len, lengths))) - 1] = [len(r[0]) if r else 0 for r in reached]
    ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    listed, reach = schema.field("members").type, schema.field("reached").type
    sides = [np.concatenate(c) for c in zip(*filter(None, reached))] or [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([
        *(pa.array([x for part in c for x in part], pa.int64()) for c in columns),
        pa.ListArray.from_arrays(ends(np.concatenate(lengths)), pa.array(np.concatenate(members)), type=listed),
        pa.ListArray.from_arrays(ends(sizes), pa.StructArray.from_arrays(list(map(pa.array, sides)), fields=list(reach.value_type)),
                                 type=reach)], schema=schema)


def _groups_by_array(contexts: DataFrame, need: int) -> DataFrame:
    """Rows of maximal repeats, with all contexts each occurs in as ``members``; see ``bucket_groups``."""
    arrow = to_arrow_schema(_GROUP)
    columns = ["gram", "check", "context", "before", "after"]
    most, in_row = OUT_MEMBERS, ROW_MEMBERS

    def of_bucket(held: list[tuple]):
        if len(held) > 1:
            grams, _, *bucket = zip(*held)
            yield from bucket_groups(grams[0], *bucket, need, most, in_row)

    def blocks(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)):
                if held and row[:2] != held[0][:2]:
                    yield from of_bucket(held)
                    held = []
                held.append(row)
        yield from of_bucket(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in blocks(batches):
            held.append(block)
            size += len(block[-2])
            if size >= most:
                yield _group_batch(held, arrow)
                held, size = [], 0
        if held:
            yield _group_batch(held, arrow)

    dealt = contexts.select(*columns).repartition("gram").sortWithinPartitions(
        "gram", "check")
    return dealt.mapInArrow(run, _GROUP)


def _groups_by_count(contexts: DataFrame, need: int) -> DataFrame:
    """For large buckets, from the counts of all their strings: one group per string, a row for each of its contexts."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("gram", "context", "left", "high", "low")])
    arrow = to_arrow_schema(schema)
    low = (1 << 64) - 1

    def rows(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            for left in range(max(0, need - len(r["after"])), min(need, len(r["before"])) + 1):
                found = xxhash.xxh3_128_intdigest(r["before"][:left][::-1] + r["after"][:need - left], r["check"] & low)
                yield r["gram"], r["context"], left, _signed(found >> 64), _signed(found & low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(rows(batch), arrow)

    strings = stored(contexts.mapInArrow(run, schema), "bucket-strings")
    same = ["gram", "left", "high", "low"]
    twice = strings.groupBy(*same).count().where("count > 1").drop("count")
    return strings.join(twice, same).select("gram", "context", F.xxhash64("high", "low", "left").alias("group"), "left",
                                            (need - F.col("left")).alias("right"))


def buckets(docs: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """The anchors of ``docs(doc_id, key, text)`` whose gram recurs, and their distinct contexts.

    ``candidates(doc_id, key, place, gram, context, copies, contexts)``:
    ``copies`` anchors have the whole context in common, ``contexts`` different
    ones the gram. Only buckets of two contexts and more are in the second table.
    """
    found = stored(anchor_table(docs, min_bytes), "anchors")
    classes = found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("copies"))
    grams = classes.groupBy("gram").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("contexts"))
    recurrent = classes.join(grams.where("total > 1").drop("total"), "gram")
    candidates = stored(found.join(recurrent, ["gram", "context"]), "candidates")
    chosen = candidates.where("contexts > 1").dropDuplicates(["gram", "context"])
    return candidates, stored(contexts_of(docs, chosen, min_bytes), "contexts")


def maximal_groups(docs: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``candidates`` as of ``buckets``, and the groups of the buckets with different contexts.

    ``listed`` are those of ``_groups_by_array``, as they were written;
    ``counted(gram, context, group, left, right)`` has a row for each context
    that a group of a large bucket occurs in.
    """
    need = min_bytes - min_bytes // 2
    candidates, contexts = buckets(docs, min_bytes)
    listed = stored(_groups_by_array(contexts.where(F.col("contexts") <= GROUP_CONTEXTS), need), "repeat-groups")
    return candidates, listed, _groups_by_count(contexts.where(F.col("contexts") > GROUP_CONTEXTS), need)


def repeat_groups(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``gram, group, doc_id, start, end``: every occurrence of every maximal repeat, group by group.

    A group is known around one anchor; a repeat longer than the anchor's
    context appears as a chain of groups that overlap. Contexts that occur
    several times as a whole are a group of their own, numbered by their hash.
    """
    need = min_bytes - min_bytes // 2
    rows = keyed(docs, id_col, text_col).withColumn("key", text_key())
    candidates, listed, counted = maximal_groups(rows, min_bytes)
    groups = listed.select("gram", F.explode("members").alias("context"), "group", "left", "right").unionByName(counted)
    whole = candidates.where("copies > 1").select("gram", "context", F.xxhash64("context").alias("group"),
                                                  F.lit(need).cast("long").alias("left"),
                                                  F.lit(need).cast("long").alias("right")).distinct()
    return candidates.join(groups.unionByName(whole), ["gram", "context"]).select(
        "gram", "group", "doc_id", F.greatest(F.lit(0), F.col("place") - F.col("left")).alias("start"),
        (F.col("place") + min_bytes // 2 + F.col("right")).alias("end"))


def covered_spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``doc_id, key, spans``: (start, end) of the repeated bytes, unmerged; an end may lie behind the text's.

    The union of the occurrences in all groups. Those around one anchor all
    hold its gram, so theirs is a single span; where a context occurs several
    times as a whole, that group's span holds the others.
    """
    gram = min_bytes // 2
    side = min_bytes - gram
    candidates, listed, counted = maximal_groups(docs, min_bytes)
    union = listed.where(F.size("reached") > 0).select("gram", F.inline("reached")).unionByName(
        counted.groupBy("gram", "context").agg(F.max("left").alias("left"), F.max("right").alias("right")))
    span = lambda left, right: F.struct(F.greatest(F.lit(0), F.col("place") - left).alias("start"),
                                        (F.col("place") + gram + right).alias("end"))
    whole = candidates.where("copies > 1").select("doc_id", "key", span(F.lit(side), F.lit(side)).alias("span"))
    part = candidates.where("copies = 1").join(union, ["gram", "context"]).select(
        "doc_id", "key", span(F.col("left"), F.col("right")).alias("span"))
    return whole.unionByName(part).groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans"))


def merge(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        end = min(end, n)
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` of every row: the removed byte runs and the bytes left.

    A byte goes if a string of ``min_bytes`` that covers it also starts
    elsewhere. A null text is empty and loses nothing; repeated rows are repeats
    of each other like any two texts.
    """
    rows = keyed(docs, id_col, text_col).withColumn("key", text_key())
    spans = covered_spans(rows, min_bytes).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans")
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["key"] == spans["_key"]), "left")
    run_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("removed", run_type), T.StructField("kept", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def cut(batch: pa.RecordBatch):
        for doc, spans, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch)):
            runs = merge([(s["start"], s["end"]) for s in spans or ()], len(text))
            at, parts = 0, []
            for start, end in runs:
                parts.append(text[at:start])
                at = end
            kept = b"".join([*parts, text[at:]]) if runs else text
            yield doc, len(text), [{"start": a, "end": b} for a, b in runs], kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(cut(batch), arrow, 2_000)

    return joined.select("doc_id", "spans", "text").mapInArrow(run, schema)
