"""BPE encoding and decoding (operator 12) by content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` bytes cuts texts where its low bits
vanish, so equal passages are cut alike wherever they stand. Chunks that occur
twice or more, counted over all documents, are encoded once, the most frequent
of them, up to a bound in bytes, are handed to every task; other chunks are
encoded where they stand. A chunk knows only the words it holds whole, so each
join of two chunks is repaired: the text from the left chunk's last whole word
to the right one's first is encoded again, and must agree with what the chunks
have for these two words. Where it doesn't, the whole text is encoded again.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import in_batches, keyed, raw_texts

#: Bytes that the rolling hash sees.
WINDOW = 24
#: Bytes hashed together.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class ChunkParams:
    #: Low bits of the rolling hash that are zero at a cut: chunks of 2**bits bytes on average.
    bits: int = 10
    #: No cut sooner than this after the last one; a cut at the latest after that many bytes.
    least: int = 256
    most: int = 8192
    #: Bytes of shared chunks, the most frequent ones, that every task is given at most.
    shared_bytes: int = 4 << 20
    #: Pre-tokens of which a Python worker remembers the tokens, in each of two generations.
    memo_pieces: int = 150_000
    #: Longer ones are encoded each time.
    memo_chars: int = 32
    #: Text encoded together.
    block_bytes: int = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _powers(n: int):
    power = np.empty(n + 1, np.uint64)
    power[0] = 1
    power[1:] = _BASE
    return np.multiply.accumulate(power, out=power)


_POWER = _powers(BLOCK + WINDOW)
_DOWN = _POWER[::-1]


def rolling(data: bytes):
    """Hash of the ``WINDOW`` bytes before each place from ``WINDOW`` on, whatever stands around them."""
    parts = []
    for at in range(0, max(0, len(data) - WINDOW + 1), BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK + WINDOW - 1, len(data) - at), at)
        n = len(block)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _POWER[:n], out=sums[1:])
        hashed = (sums[WINDOW:] - sums[:-WINDOW]) * _DOWN[:n - WINDOW + 1]
        parts.append(hashed ^ (hashed >> np.uint64(29)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def chunks(data: bytes, params: ChunkParams = ChunkParams()) -> list[bytes]:
    """``data`` cut by content, never inside a character; empty data has no chunks."""
    n, last, found = len(data), 0, []
    marks = (np.flatnonzero((rolling(data) & np.uint64((1 << params.bits) - 1)) == 0) + WINDOW).tolist()
    for mark in [*marks, n]:
        while mark - last > params.most:
            forced = last + params.most
            while data[forced] & 0xC0 == 0x80:
                forced -= 1
            found.append(data[last:forced])
            last = forced
        if mark == n or (mark - last >= params.least and data[mark] & 0xC0 != 0x80):
            if mark > last:
                found.append(data[last:mark])
            last = mark
    return found


class Encoded(NamedTuple):
    """A chunk: the text before its first white space and after its last, and of the words between the
    first, the last, and the tokens of all; without whole words, ``first`` and ``last`` are empty."""

    head: bytes
    first: bytes
    ids: bytes
    shown: bytes
    last: bytes
    tail: bytes
    whole: bool  # whether it holds white space at all


#: White space, and characters whose lower case, normal form and class no version of the character tables disputes.
PLAIN = re.compile("[ \t\n\x0b\x0c\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0134-\u017e]*")
#: What the tokenizer's own pattern makes of them, in lower case.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]"
                   "|[^ \t\n\x0b\x0c\ra-z0-9\u00df-\u00f6\u00f8-\u017f]+")


class Pieces(dict):
    """Tokens by pre-token, ``(ids, shown)``, in two generations: what is still in use outlives a full memo."""

    def __init__(self, tokenizer, params: ChunkParams):
        super().__init__()
        self.tokenize, self.params, self.old = tokenizer.model.tokenize, params, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in set(shown)]
        self.letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, piece: str) -> tuple[bytes, bytes]:
        found = self.old.get(piece)
        if found is None:
            tokens = self.tokenize(piece if piece.isascii() else "".join([self.letter[b] for b in piece.encode()]))
            found = (array("I", [t.id for t in tokens]).tobytes(), "".join([t.value + " " for t in tokens]).encode())
        if len(piece) <= self.params.memo_chars:
            if len(self) >= self.params.memo_pieces:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Texts to ids and decoded texts. ``shown`` texts have a blank behind each token."""

    def __init__(self, path: str, params: ChunkParams):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on every core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.params, self.pieces, self.direct = params, Pieces(self.tokenizer, params), True
        words = ["One's", "3rd", "word,", "\u00c0\u0153."]
        whole, *own = (self.library(t) for t in (" \n".join(words), *words))
        if whole != tuple(map(b"".join, zip(*own))):
            raise ValueError("only tokenizers that drop white space between words are supported")
        self.direct = [self.tokens(w.encode()) for w in words] == own  # else the library encodes all there is

    def library(self, text: str) -> tuple[bytes, bytes]:
        """Ids, and the decoded text with a blank behind it unless there are none."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        shown = self.tokenizer.decode(ids, skip_special_tokens=False)
        return array("I", ids).tobytes(), shown.encode() + b" " if ids else b""

    def tokens(self, data: bytes) -> tuple[bytes, bytes]:
        """As ``library``; of plain characters by the model alone, pre-token by pre-token."""
        text = data.decode()
        if not (self.direct and PLAIN.fullmatch(text)) or any(a in data for a in self.added):
            return self.library(text)
        found = list(map(self.pieces.__getitem__, PIECE.findall(text.lower())))
        return b"".join([t[0] for t in found]), b"".join([t[1] for t in found])

    def encode_chunk(self, part: bytes) -> Encoded:
        """A chunk by the words it holds whole; only the six ASCII white-space characters part words."""
        head = tail = b""
        inner = part
        if part[0] not in SPACE:
            head = part.split(None, 1)[0]
            inner = part[len(head):]
        if not inner:
            return Encoded(part, b"", b"", b"", b"", b"", False)
        if part[-1] not in SPACE:
            tail = inner.rsplit(None, 1)[-1]
            inner = inner[:len(inner) - len(tail)]
        inner = inner.strip(SPACE)
        if not inner:
            return Encoded(head, b"", b"", b"", b"", tail, True)
        return Encoded(head, inner.split(None, 1)[0], *self.tokens(inner), inner.rsplit(None, 1)[-1], tail, True)

    def encode_texts(self, texts: list[bytes], shared: dict[bytes, Encoded]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded texts of whole texts, from their chunks and repaired joins."""
        params = self.params
        cut = [chunks(text, params) for text in texts]
        new = {part for parts in cut for part in parts if part not in shared}
        known = {part: self.encode_chunk(part) for part in new}
        get = lambda part: shared.get(part) or known[part]
        rows, windows = [], []  # a text: chunks, and between them the numbers of its repaired joins
        for parts in cut:
            row, left = [], None
            loose = b""  # text since the last whole word that no chunk holds whole
            for part in parts:
                chunk = get(part)
                if not chunk.whole:
                    loose += part
                    continue
                loose += chunk.head
                row.append((len(windows), chunk))
                windows.append((left.last if left else b"", loose, chunk.first))
                left, loose = chunk, chunk.tail
            row.append((len(windows), None))
            windows.append((left.last if left else b"", loose, b""))
            rows.append(row)
        repaired = self.repair(windows)
        for text, row in zip(texts, rows):
            if any(repaired[i] is None for i, _ in row):
                ids, shown = self.library(text.decode())
            else:
                ids = b"".join([x for i, c in row for x in (repaired[i][0], c.ids if c else b"")])
                shown = b"".join([x for i, c in row for x in (repaired[i][1], c.shown if c else b"")])
            yield ids, shown[:-1]

    def repair(self, windows: list[tuple[bytes, bytes, bytes]]) -> list[tuple[bytes, bytes] | None]:
        """Tokens of the loose text of each ``(last word before, loose text, first word behind)``; None where
        the tokens of the whole window don't agree with those of the two words."""
        found: dict[tuple[bytes, bytes, bytes], tuple[bytes, bytes] | None] = {}
        for window in {w for w in windows if w[1]}:
            ids, shown = self.tokens(b" ".join([w for w in window if w]))
            (ids_before, shown_before), (ids_behind, shown_behind) = self.tokens(window[0]), self.tokens(window[2])
            agrees = (len(ids) >= len(ids_before) + len(ids_behind) and ids.startswith(ids_before)
                      and ids.endswith(ids_behind) and shown.startswith(shown_before) and shown.endswith(shown_behind))
            found[window] = (ids[len(ids_before):len(ids) - len(ids_behind)],
                             shown[len(shown_before):len(shown) - len(shown_behind)]) if agrees else None
        return [found[w] if w[1] else (b"", b"") for w in windows]


_ENCODERS: dict[tuple[str, ChunkParams], Encoder] = {}


def encoder(path: str, params: ChunkParams) -> Encoder:
    """One per Python worker: the vocabulary is read once."""
    if (path, params) not in _ENCODERS:
        _ENCODERS[path, params] = Encoder(path, params)
    return _ENCODERS[path, params]


def blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of a batch, about ``size`` bytes of text at a time."""
    docs, held, total = [], [], 0
    for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch)):
        docs.append(doc)
        held.append(raw)
        total += len(raw)
        if total >= size:
            yield docs, held
            docs, held, total = [], [], 0
    if held:
        yield docs, held


def shared_chunks(source: DataFrame, path: str, params: ChunkParams = ChunkParams()) -> dict[bytes, Encoded]:
    """The chunks that save most bytes among those that all texts of ``source(doc_id, text)`` hold twice
    or more, encoded; ``shared_bytes`` of them at most.

    Chunks are counted by hash. The one task that is named for a chunk hands it
    on, so that what is shuffled doesn't grow with the copies.
    """
    counted = T.StructType([T.StructField(c, T.LongType()) for c in ("hash", "n", "size", "task")])
    arrow = to_arrow_schema(counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        task = TaskContext.get().partitionId()
        for batch in batches:
            own, sizes = Counter(), {}
            for raw in raw_texts(batch):
                for part in chunks(raw, params):
                    mark = xxh3_64_intdigest(part) - (1 << 63)
                    own[mark] += 1
                    sizes[mark] = len(part)
            yield from in_batches(((mark, n, sizes[mark], task) for mark, n in own.items()), arrow)

    seen = source.mapInArrow(count, counted).groupBy("hash").agg(
        F.sum("n").alias("n"), F.max("size").alias("size"), F.min("task").alias("task")).where("n > 1")
    best = seen.orderBy(F.expr("(n - 1) * size").desc(), "hash").limit(params.shared_bytes // params.least).collect()
    wanted, room = {}, params.shared_bytes
    for r in best:
        if r["size"] <= room:
            wanted[r["hash"]] = r["task"]
            room -= r["size"]
    if not wanted:
        return {}
    fields = T.StructType([T.StructField("hash", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in (
        "part", *Encoded._fields[:-1])), T.StructField("whole", T.BooleanType())])
    encoded = to_arrow_schema(fields)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        task = TaskContext.get().partitionId()
        left = {mark for mark, owner in wanted.items() if owner == task}
        for batch in batches:
            if not left:
                continue
            found = {}
            for raw in raw_texts(batch):
                for part in chunks(raw, params):
                    mark = xxh3_64_intdigest(part) - (1 << 63)
                    if mark in left:
                        found.setdefault(mark, part)
            left -= found.keys()
            own = encoder(path, params)
            yield from in_batches(((mark, part, *own.encode_chunk(part)) for mark, part in found.items()), encoded, 1_000)

    rows = source.mapInArrow(pick, fields).collect()  # shared_bytes of chunks at most
    return {bytes(r["part"]): Encoded(*(bytes(r[c]) for c in Encoded._fields[:-1]), r["whole"]) for r in rows}


def encode(docs: DataFrame, tokenizer: str | None = None, params: ChunkParams = ChunkParams(), id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every row: little-endian uint32 ids as the library gives them for the
    whole text without special tokens, and what it decodes them to.

    A null or empty text has no ids and decodes to the empty text; repeated rows
    each get their row; a null id stays null. A text is held whole by one task.
    """
    path = tokenizer or default_tokenizer()
    source = keyed(docs, id_col, text_col)
    shared = source.sparkSession.sparkContext.broadcast(shared_chunks(source, path, params))
    schema = T.StructType([source.schema["doc_id"], T.StructField("ids", T.BinaryType()),
                           T.StructField("decoded", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, params)
        for batch in batches:
            for ids, texts in blocks(batch, params.block_bytes):
                rows = ((doc, *found) for doc, found in zip(ids, own.encode_texts(texts, shared.value)))
                yield from in_batches(((doc, tokens, shown.decode()) for doc, tokens, shown in rows), arrow, 2_000)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str | None = None, params: ChunkParams = ChunkParams()) -> DataFrame:
    """``encoded(doc_id, ids)`` as ``doc_id, decoded``: what the library decodes the ids to, in batches; null ids are none."""
    path = tokenizer or default_tokenizer()
    source = encoded.select("doc_id", "ids")
    schema = T.StructType([source.schema["doc_id"], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [array("I", v or b"").tolist() for v in batch.column(1).to_pylist()]
            found = encoder(path, params).tokenizer.decode_batch(ids, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "decoded"])

    return source.mapInArrow(run, schema)
