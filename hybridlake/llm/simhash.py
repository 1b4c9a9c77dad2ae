"""SimHash near-duplicates (operator 8): a binary-trie self-join.

Each text gets a 64-bit fingerprint. Distinct fingerprints go to one bucket
per quarter of their bits: two that differ in at most three bits agree in a
quarter, so they meet in a bucket. Within a bucket a binary trie is joined with
itself: pairs of nodes go down together, a pair's differing bits are counted,
and a pair beyond the budget is dropped with all below it. A bucket above
``SPLIT_ROWS`` is dealt out again by the quarters of its other 48 bits, by the
same argument. Buckets return spanning links, never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import in_batches, keyed, packed_rows, raw_texts, stored, text_key
from hybridlake.llm.components import connected

BITS = 64
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
#: Buckets above this many distinct fingerprints are split further.
SPLIT_ROWS = 50_000
#: Fingerprints, and node pairs, that a task holds at a time.
BLOCK_ROWS = 200_000
FRONTIER = 250_000


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS):
    """XXH64 of every shingle of a text's words, A-Z in lower case."""
    import numpy as np

    words = text.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(length) - length
    end = (start + length - 1)[width - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())),
                       np.uint64, len(end))


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; no words: zero."""
    import numpy as np

    hashes = shingle_hashes(text, width)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, fp`` (the text's hash; the 64 bits as a long) of every row."""
    source = keyed(docs, id_col, text_col).select("doc_id", text_key().alias("key"), "text")
    schema = T.StructType([source.schema["doc_id"], T.StructField("key", T.LongType()),
                           T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                                             names=["doc_id", "key", "fp"])

    return source.mapInArrow(run, schema)


def _roots(a, b, n: int):
    """Each of ``n`` labels' smallest linked label, by union of the label pairs (a, b)."""
    import numpy as np

    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], np.int64)


def trie_links(bucket, values, budget: int = MAX_DISTANCE):
    """Index pairs that link all values of a bucket within ``budget`` bits.

    ``values`` (uint64) are sorted by (bucket, value), so a trie node is a range
    of them. Neighbours in order are linked first; node pairs whose values all
    have one label by then need no further look.
    """
    import numpy as np

    n = len(values)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    close = (bucket[1:] == bucket[:-1]) & (np.bitwise_count(values[1:] ^ values[:-1]) <= budget)
    label = np.concatenate(([0], np.cumsum(~close)))
    first = np.flatnonzero(np.concatenate(([True], ~close)))  # of each label
    pairs = [np.stack([np.flatnonzero(close), np.flatnonzero(close) + 1], axis=1)]
    edge = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [n]))
    lo, hi = edge[:-1], edge[1:]
    wide = label[lo] != label[hi - 1]
    lo, hi = lo[wide], hi[wide]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    met_a, met_b = [], []
    ones_at: dict[int, np.ndarray] = {}

    def ones(depth: int):  # numbers of values before each place whose bit at this depth is 1
        if depth not in ones_at:
            bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones_at[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int32)))).astype(np.int32)
        return ones_at[depth]

    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(depth, *(x[half:] for x in (alo, ahi, blo, bhi, err))),
                      (depth, *(x[:half] for x in (alo, ahi, blo, bhi, err)))]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            met_a.append(a[near])
            met_b.append(b[near])
            rest = ~single
            alo, ahi, blo, bhi, err = (x[rest] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        count = ones(depth)
        amid = ahi - (count[ahi] - count[alo])
        bmid = bhi - (count[bhi] - count[blo])
        same = alo == blo  # a node with itself: its two halves meet once
        steps = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        apart = ~same
        steps.append(tuple(x[apart] for x in (amid, ahi, blo, bmid, err + 1)))
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*steps))
        keep = (alo < ahi) & (blo < bhi) & (err <= budget)
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        one_label = (label[alo] == label[ahi - 1]) & (label[blo] == label[bhi - 1]) & (label[alo] == label[blo])
        alo, ahi, blo, bhi, err = (x[~one_label] for x in (alo, ahi, blo, bhi, err))
        if len(alo):
            stack.append((depth + 1, alo, ahi, blo, bhi, err))
    if met_a:
        a, b = label[np.concatenate(met_a)], label[np.concatenate(met_b)]
        a, b = np.unique(np.stack([a, b], axis=1), axis=0).T if len(a) else (a, b)
        root = _roots(a, b, len(first))
        moved = np.flatnonzero(root != np.arange(len(first)))
        pairs.append(np.stack([first[root[moved]], first[moved]], axis=1))
    return np.concatenate(pairs)


def _bucket_links(rows: DataFrame, budget: int) -> DataFrame:
    """Spanning links ``a, b`` of every bucket of ``rows(k1, k2, fp)``."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def links(k1, k2, fp):
            order = np.lexsort((fp, k2, k1))
            k1, k2, fp = k1[order], k2[order], fp[order]
            new = np.concatenate(([0], np.cumsum((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
            found = fp.view(np.int64)[trie_links(new, fp, budget)]
            return zip(*(x.tolist() for x in found.T))

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            got = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, got)]
            if len(held[0]) >= BLOCK_ROWS:  # all but the last bucket, which may go on
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                end = int(np.argmax(last))
                if end:
                    yield from in_batches(links(*(x[:end] for x in held)), arrow)
                    held = [x[end:] for x in held]
        if len(held[0]):
            yield from in_batches(links(*held), arrow)

    dealt = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(run, schema)


def _part(fp, taken: list[tuple[int, int]], at: int, width: int):
    """``width`` bits from place ``at`` of the bits outside ``taken`` (low place, width), as a column."""
    bits = [i for i in range(BITS) if not any(lo <= i < lo + w for lo, w in taken)][at:at + width]
    runs: list[list[int]] = []
    for i in bits:
        if runs and runs[-1][-1] == i - 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    value, shift = F.lit(0).cast("long"), 0
    for run in runs:
        piece = F.shiftrightunsigned(fp, run[0]).bitwiseAND(F.lit((1 << len(run)) - 1))
        value, shift = value.bitwiseOR(F.shiftleft(piece.cast("long"), shift)), shift + len(run)
    return value


def links(prints: DataFrame, budget: int = MAX_DISTANCE) -> DataFrame:
    """Links ``a, b`` that join all of the distinct ``fp`` within ``budget`` bits."""
    parts = budget + 1
    width = BITS // parts
    fp = F.col("fp")
    bands = [F.struct((F.lit(i << 32).cast("long") + _part(fp, [], i * width, width)).alias("k1"),
                      F.lit(i).alias("band")) for i in range(parts)]
    rows = prints.select("fp", F.explode(F.array(*bands)).alias("_b")).select("fp", "_b.k1", "_b.band")
    # at most parts * 2^width buckets, and only those above the limit
    large = rows.groupBy("k1").count().where(F.col("count") > SPLIT_ROWS).select("k1", F.lit(True).alias("large"))
    rows = rows.join(large, "k1", "left")
    inner = (BITS - width) // parts
    sub = F.array()
    for i in range(parts):
        keys = F.array(*[F.lit((j + 1) << 32).cast("long") + _part(fp, [(i * width, width)], j * inner, inner)
                         for j in range(parts)])
        sub = F.when(F.col("band") == i, keys).otherwise(sub) if i else keys
    k2 = F.when(F.col("large"), sub).otherwise(F.array(F.lit(0).cast("long")))
    return _bucket_links(rows.select("k1", F.explode(k2).alias("k2"), "fp"), budget)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, budget: int = MAX_DISTANCE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, fp, root, component_id``: a component's smallest fingerprint and ``doc_id``.

    Null and wordless texts have fingerprint zero and are linked like any
    other. Repeated rows each get their row. A null id is never the smallest;
    a component of null ids alone has a null ``component_id``.
    """
    prints = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    known = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected(links(known.select("fp"), budget))
    grouped = known.join(roots, known["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = stored(grouped.join(ids, "root").select("fp", "root", "component_id"), "components")
    return prints.join(of_print, "fp").select("doc_id", "key", "fp", "root", "component_id")


def keep_first(docs: DataFrame, width: int = SHINGLE_WORDS, budget: int = MAX_DISTANCE, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, for each component: the one with the smallest id.

    Of several rows with that id the one with the smallest text hash stays, and
    one of repeated rows. Rows without an id come last: one of them stays where
    their component has no other.
    """
    found = near_duplicates(docs, width, budget, id_col, text_col)
    own = found.groupBy("root", "doc_id", "key").count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "count")).alias("first")
    best = stored(own.groupBy("root").agg(first).select("first.doc_id", "first.key", "first.count"), "kept-documents")
    rows = packed_rows(docs, id_col, text_col)
    kept = rows.join(best, rows["doc_id"].eqNullSafe(best["doc_id"]) & (rows["key"] == best["key"]), "left_semi")
    if not best.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "key"])
    return kept.select("row.*")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
