"""Best-fit packing (operator 2): a plan over the length histogram.

Documents become token ids and are cut into pieces of at most ``capacity``
tokens. The number of pieces of each length (at most ``capacity`` rows) is all
that planning needs: best-fit decreasing runs over the counts and yields plan
entries "pieces of this length, from this rank to that one, go to these
sequences at this offset". Slots are found by (length, rank within the length)
for row numbers alone; ranks are counted in cells of bounded size, so no length,
however common, meets in one task. The written pieces, with their ids, are then
joined to their slots once, by row number.
"""

from __future__ import annotations

import bisect
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import in_batches, keyed, stored, texts

CAPACITY = 2048
END_ID = 0
#: Pieces ranked together in one window group.
CELL_ROWS = 4096
#: Pre-tokens of which a Python worker remembers the ids, in each of two generations: about 40 MB each.
MEMO_PIECES = 200_000
#: Longer ones are encoded each time.
MEMO_CHARS = 32

#: Blanks, line breaks and characters whose class no version of the character tables disputes.
PLAIN = re.compile("[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
#: What the tokenizer's own pattern makes of them.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+| ?[0-9]+"
                   "| ?[^ \nA-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[ \n]+(?![^ \n])|[ \n]+")

_PLAN = T.StructType([
    T.StructField("length", T.LongType()), T.StructField("first_rank", T.LongType()),
    T.StructField("end_rank", T.LongType()), T.StructField("first_sequence", T.LongType()),
    T.StructField("per_sequence", T.LongType()), T.StructField("first_offset", T.LongType())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces(dict):
    """Ids by pre-token, in two generations: what is still in use outlives a full memo."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in set(shown)]
        self.letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.blank = self.letter[32]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii() and "\n" not in piece:
                marked = piece.replace(" ", self.blank)
            else:
                marked = "".join([self.letter[b] for b in piece.encode()])
            ids = array("I", [t.id for t in self.tokenize(marked)]).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to little-endian uint32 token ids, with a memo of pre-tokens.

    A text of plain characters is cut as the tokenizer's pattern cuts it, and
    its model makes the ids of each pre-token that the memo lacks. The library
    encodes other texts whole, and those that hold an added token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # an added token, such as <|endoftext|>, is cut out before any word is
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self.tokenizer)
        probe = " One's  3rd, \n\u00c0\u0153 x-- \n"
        self.direct = self.by_pieces(probe) == self.whole(probe)  # else the library encodes all there is

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def by_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not (self.direct and PLAIN.fullmatch(text)) or any(t in text for t in self.added):
            return self.whole(text)
        return self.by_pieces(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker: the vocabulary is read once, and the memo, of bounded size, lasts as long."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = n_ids % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def tokenize(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids`` (little-endian uint32).

    A null text is an empty one: a single piece holding the end id. Repeated
    rows give repeated pieces; a null id stays null.
    """
    path = tokenizer or default_tokenizer()
    source = keyed(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode

        def rows(batch: pa.RecordBatch):
            for doc, text in zip(batch.column(0), texts(batch)):
                ids = encode(text) + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    yield doc.as_py(), i, start, length, ids[4 * start:4 * (start + length)]

        for batch in batches:
            yield from in_batches(rows(batch), arrow, 2_000)

    return source.mapInArrow(pieces, schema)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows of ``_PLAN``.

    Ranks ``first_rank .. end_rank - 1`` of a length go to consecutive
    sequences, ``per_sequence`` in each, from ``first_offset``. Sequences alike
    in their filling form a group; a step splits at most one group in three, so
    the plan's size depends on ``capacity`` alone.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    spare: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, sequences)
    rooms: list[int] = []  # sorted keys of spare
    opened = 0

    def keep(room: int, first: int, number: int) -> None:
        if number and room:
            if not spare[room]:
                bisect.insort(rooms, room)
            spare[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = spare[room].pop()
                if not spare[room]:
                    del rooms[at]
            else:
                room, first = capacity, opened
                number = math.ceil(left / (capacity // length))
                opened += number
            each = room // length
            full = min(number, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:  # the last, partly filled sequence
                plan.append((length, rank, rank + left, first + full, left, capacity - room))
                keep(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            keep(room, first + full, number - full)
    return plan


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, among them ``length``) with ``sequence_id, offset``.

    The pieces are written once to the shared folder, with a number of their
    own; histogram, ranks and slots come from that table's narrow columns.
    """
    spark = pieces.sparkSession
    # ids of four bytes are wide and alike
    table = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces", "zstd")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # <= capacity rows
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), _PLAN).withColumnRenamed("length", "_length")
    cells = spark.createDataFrame([(n, math.ceil(c / CELL_ROWS)) for n, c in counts.items()],
                                  "_n long, _cells long")
    dealt = (table.select("_row", "length").join(F.broadcast(cells), F.col("length") == F.col("_n"))
             .withColumn("_cell", F.pmod(F.xxhash64("_row"), "_cells")).drop("_n", "_cells"))
    sizes = dealt.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("length").orderBy("_cell")) - F.col("_size")
    starts = sizes.select(F.col("length").alias("_n"), F.col("_cell").alias("_c"), before.alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_cell").orderBy("_row")))
    ranked = (ranked.join(starts, (F.col("length") == F.col("_n")) & (F.col("_cell") == F.col("_c")))
              .withColumn("_rank", F.col("_before") + F.col("_rank") - 1))
    slots = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length"))
                        & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank")))
    k = F.col("_rank") - F.col("first_rank")
    slots = slots.select(
        F.col("_row").alias("_slot_row"),
        (F.col("first_sequence") + F.floor(k / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + k % F.col("per_sequence") * F.col("length")).alias("offset"))
    return table.join(slots, F.col("_row") == F.col("_slot_row")).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of every piece of every document."""
    return assign(tokenize(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed token ids, at most ``capacity`` per row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.aggregate("_p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))


def pack_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """As ``pack``, with ``ids_crc32`` of the placed ids in their stead."""
    return pack(docs, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                        "sequence_id", "offset")
