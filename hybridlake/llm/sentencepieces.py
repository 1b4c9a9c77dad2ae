"""SentencePiece encoding and decoding (operator 1) on the tokenizers library.

The model file is parsed as a protobuf message; its pieces, scores, normaliser
settings and byte pieces are rebuilt as a ``tokenizers`` pipeline. Texts are
encoded in multithreaded batches, and what is encoded is held against the
``sentencepiece`` library itself.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import in_batches, keyed, texts

MARK = "▁"
#: Segments whose ids a Python worker remembers, in each of two generations: about 30 MB each.
MEMO_SEGMENTS = 160_000
#: Slots for hashes of segments that it has held against the reference library, and found alike; a later one takes
#: the place of an earlier one. A power of two: 16 MB, allotted once.
CHECKED_SLOTS = 1 << 21
#: Longer segments are encoded each time.
MEMO_CHARS = 64
#: Text whose segments are looked up together, and segments encoded in one batch.
BLOCK_CHARS = 1_000_000
BATCH_SEGMENTS = 4_000

# Fixed values of the model format: field numbers, piece kinds, model kinds.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BYTE_NAME = re.compile("<0x[0-9A-Fa-f]{2}>")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: whole numbers, or the bytes of anything else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at:at + size]
        at += size


@dataclass
class Model:
    """What a model file says, with the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fewer_blanks: bool = True
    escape_blanks: bool = True
    blank_suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in message(data):
            if number == PIECES:
                own = dict(message(value))
                model.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0],
                                     own.get(3, NORMAL)))
            elif number == TRAINER:
                own = dict(message(value))
                model.kind = own.get(3, UNIGRAM)
                model.byte_fallback = bool(own.get(35, 0))
                model.blank_suffix = bool(own.get(24, 0))
            elif number == NORMALIZER:
                own = dict(message(value))
                model.charsmap = own.get(2, b"")
                model.dummy_prefix = bool(own.get(3, 1))
                model.fewer_blanks = bool(own.get(4, 1))
                model.escape_blanks = bool(own.get(5, 1))
        model.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        if model.kind not in (UNIGRAM, BPE) or model.blank_suffix or not model.escape_blanks:
            raise ValueError("only unigram and BPE models that mark blanks in front are supported")
        return model

    def separable(self) -> bool:
        """No piece goes on past a mark, so that texts can be cut before each run of marks."""
        return not any(re.search(f"[^{MARK}]{MARK}", text) for text, _, kind in self.pieces if kind == NORMAL)


def normalizer(model: Model):
    """The model's own normalisation, marks included."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.fewer_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    return normalizers.Sequence(steps)


def rebuild(model: Model, segments: bool = False):
    """The ``tokenizers`` pipeline of a model; for ``segments``, that are normal and cut already, without those steps.
    It decodes either way."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, pre_tokenizers

    if model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(t, s) for t, s, _ in model.pieces], unk_id=model.unknown,
                                             byte_fallback=model.byte_fallback))
    else:
        place = {t: i for i, (t, _, kind) in enumerate(model.pieces)}
        joins = [(-score, i, text[:at], text[at:]) for i, (text, score, kind) in enumerate(model.pieces)
                 if kind == NORMAL for at in range(1, len(text)) if text[:at] in place and text[at:] in place]
        tokenizer = Tokenizer(models.BPE(place, [(a, b) for _, _, a, b in sorted(joins)], fuse_unk=True,
                                         unk_token=model.pieces[model.unknown][0], byte_fallback=model.byte_fallback))
    if not segments:
        tokenizer.normalizer = normalizer(model)
    if not segments and model.separable():
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    own = [t for t, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens([AddedToken(t, normalized=False) for t in own])
    unmark = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(unmark + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tokenizer


class Codec:
    """Encodes normal segments in batches; a memo keeps those that come often. One pipeline encodes and decodes.

    A segment is known by its key: where each begins with a mark and no step changes
    the text, the text behind that mark, else the segment itself. Keys without marks
    take half the memory, most being ASCII.
    """

    def __init__(self, path: str, threads: int):
        import numpy as np
        import sentencepiece

        # the library's own pool has a thread for each core of the machine, and takes its size once
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as file:
            self.model = Model.parse(file.read())
        self.tokenizer = rebuild(self.model, segments=True)
        self.normalizer = normalizer(self.model)
        #: What a piece stands for by itself; None for one that the pipeline decodes (bytes, unknown, control, own tokens).
        self.surface = [text.replace(MARK, " ") if kind == NORMAL and not BYTE_NAME.fullmatch(text) else None
                        for text, _, kind in self.model.pieces]
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        self.plain = not (self.model.charsmap or self.model.fewer_blanks)
        self.separable = self.model.separable()
        self.words = self.plain and self.separable and self.model.dummy_prefix
        self.runs = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.blanks = re.compile(" +[^ ]*")
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.checked = np.full(CHECKED_SLOTS, -1, np.int64)  # no string has this hash

    def normal(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        return self.normalizer.normalize_str(text)

    def segments(self, normal: str) -> list[str]:
        return self.runs.findall(normal) if self.separable else [normal] if normal else []

    def keys(self, text: str) -> list[str]:
        """The keys of a text's segments, in order."""
        if not self.words:
            return self.segments(self.normal(text))
        if not text:
            return []
        text = text.replace(MARK, " ")
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        return [run[1:] for run in self.blanks.findall(" " + text)]

    def segment(self, key: str) -> str:
        return MARK + key.replace(" ", MARK) if self.words else key

    def decode(self, ids: list[list[int]]) -> list[str]:
        """As the pipeline decodes; lists of plain pieces alone are their surfaces one behind the other."""
        surface, front = self.surface.__getitem__, " " if self.model.dummy_prefix else ""
        out, others = [], []
        for own in ids:
            try:
                out.append("".join(map(surface, own)).removeprefix(front))
            except (TypeError, IndexError):
                others.append(len(out))
                out.append("")
        if others:
            for i, text in zip(others, self.tokenizer.decode_batch([ids[i] for i in others], skip_special_tokens=False)):
                out[i] = text
        return out

    def learn(self, keys: list[str]) -> set[str]:
        """Puts the ids of segments, by the rebuilt pipeline, into the memo; those not seen before are checked.
        Returns the keys of bad ones."""
        import numpy as np

        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(list(map(self.segment, keys)), add_special_tokens=False)]
        self.memo.update((key, array("I", ids).tobytes()) for key, ids in zip(keys, encoded))
        hashes = np.fromiter(map(hash, keys), np.int64, len(keys))
        slots = hashes & (len(self.checked) - 1)
        fresh = np.flatnonzero(self.checked[slots] != hashes)
        if not len(fresh):
            return set()
        at = fresh.tolist()
        alike = self.check([keys[i] for i in at], [encoded[i] for i in at])
        good = fresh[np.array(alike, bool)]
        self.checked[slots[good]] = hashes[good]
        return {keys[i] for i, ok in zip(at, alike) if not ok}

    def check(self, keys: list[str], encoded: list[list[int]]) -> list[bool]:
        """Whether the reference library encodes segments alike, and the pipeline decodes them to their text."""
        front = 1 if self.model.dummy_prefix else 0
        surface = keys if self.words else [s[front:].replace(MARK, " ") if s[0] == MARK else s for s in keys]
        expected = self.reference.encode(surface, num_threads=self.threads)
        alike = []
        for ids, other, text, back in zip(encoded, expected, surface, self.decode(encoded)):
            if not text:  # a blank at the end; as a text of its own it would be empty
                other = [self.reference.piece_to_id(MARK)]
            alike.append(ids == other and (back == text or self.model.unknown in ids))
        return alike

    def encode_block(self, block: list[str]) -> Iterator[tuple[bytes, bool]]:
        parts = [self.keys(text) for text in block]
        used = set().union(*parts)
        if len(self.memo) > MEMO_SEGMENTS:  # what is still in use comes back from the old generation
            self.old, self.memo = self.memo, {}
        new = used.difference(self.memo)
        back = self.old.keys() & new
        self.memo.update((key, self.old[key]) for key in back)
        new = list(new.difference(back))
        memo, bad = self.memo, set(new)
        try:
            bad = set().union(*(self.learn(new[at:at + BATCH_SEGMENTS]) for at in range(0, len(new), BATCH_SEGMENTS)))
            for keys in parts:
                yield b"".join(map(memo.__getitem__, keys)), not (bad and any(k in bad for k in keys))
        finally:  # bad ones, and all of a block that wasn't checked to its end, are checked when they come again
            for key in new:
                if key in bad or len(key) > MEMO_CHARS:
                    memo.pop(key, None)


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int) -> Codec:
    """One codec per Python worker: the model is read once, and its memos, of bounded size, last as long."""
    if (path, threads) not in _CODECS:
        _CODECS[path, threads] = Codec(path, threads)
    return _CODECS[path, threads]


def encode(docs: DataFrame, model: str | None = None, threads: int = 2, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, ids, parity`` of every row: little-endian uint32 ids, and whether for each of the
    text's segments the reference library agrees and the ids decode to its normal text.

    A null text is empty and has no ids; repeated rows each get their row.
    """
    path = model or default_model()
    source = keyed(docs, id_col, text_col)
    schema = T.StructType([source.schema["doc_id"], T.StructField("ids", T.BinaryType()),
                           T.StructField("parity", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def rows(batch: pa.RecordBatch):
        ids = iter(batch.column(0).to_pylist())
        block, size = [], 0
        for text in texts(batch):
            block.append(text)
            size += len(text)
            if size > BLOCK_CHARS:
                yield from ((next(ids), *found) for found in codec(path, threads).encode_block(block))
                block, size = [], 0
        yield from ((next(ids), *found) for found in codec(path, threads).encode_block(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(rows(batch), arrow, 2_000)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None, threads: int = 2) -> DataFrame:
    """``encoded(doc_id, ids, ...)`` with ``text``, decoded in batches."""
    path = model or default_model()
    schema = T.StructType([*encoded.schema, T.StructField("text", T.StringType())])
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [array("I", v or b"").tolist() for v in batch.column(at).to_pylist()]
            found = codec(path, threads).decode(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, schema)
