"""Quality rules on repetition (operator 4): a suffix array over each text's words.

The longest-common-prefix intervals of the array, found by a stack scan, are
the text's repeated passages; a place's longest one is its deepest interval's.
The union of the spans of those of ``repeat_words`` words or more gives the
covered fraction, the longest common prefix the longest repeat; a text is
dropped when either passes its limit. Counts of words, symbols, repeated lines
and repeated 3-word windows come from the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import in_batches, keyed, raw_texts
from hybridlake.llm.suffixes import covered, deepest, intervals, suffix_array

SYMBOLS = b"#*$%&|<>"
#: What doesn't count as a character of a word: ASCII white space and the
#: second and later bytes of a UTF-8 character.
NOT_CHARS = bytes([32, *range(9, 14), *range(128, 192)])
#: Text handled in one go, in bytes; a longer text goes alone.
BLOCK_BYTES = 2_000_000


@dataclass(frozen=True)
class RepetitionRules:
    min_words: int = 50
    window_words: int = 3
    max_window_percent: int = 50
    repeat_words: int = 10
    max_covered: float = 0.3
    max_repeat_words: int = 60


def word_codes(words: list[bytes]):
    import numpy as np

    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int32)


def measure(block: list[bytes], rules: RepetitionRules) -> Iterator[tuple]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeated words, longest repeat."""
    import numpy as np

    words = [text.split() for text in block]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    ends = np.repeat(end, size)
    places, lcp = suffix_array(word_codes([w for ws in words for w in ws]), ends)
    depth = deepest(lcp, min(rules.window_words, rules.repeat_words))
    total = len(ends)

    def in_repeats(least: int):
        deep = depth >= least
        mark = np.concatenate(([0], np.cumsum(covered(places[deep], depth[deep], total))))
        return mark[end] - mark[end - size]

    longest = np.zeros(len(block), np.int64)
    if total:
        np.maximum.at(longest, np.repeat(np.arange(len(block)), size)[places], lcp)
    windows, repeated = in_repeats(rules.window_words), in_repeats(rules.repeat_words)
    for text, *counts in zip(block, size.tolist(), windows.tolist(), repeated.tolist(), longest.tolist()):
        lines = [x for x in text.split(b"\n") if x.strip()]
        yield (counts[0], len(text.translate(None, NOT_CHARS)), len(text) - len(text.translate(None, SYMBOLS)),
               len(lines) - len(set(lines)), counts[1], counts[2], counts[3])


def blocks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def apply_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` of every row.

    A null or empty text has no words, fails the base and isn't kept. Repeated
    rows each get their row; a null id stays null.
    """
    source = keyed(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in MEASURES)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (row for block in blocks(raw_texts(batch)) for row in measure(block, rules))
            yield from in_batches(((doc, *row) for doc, row in zip(batch.column(0).to_pylist(), found)), arrow)

    n = F.col("n_words")
    failed = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_window_percent * n)
    bad = (F.col("covered_words") > rules.max_covered * n) | (F.col("longest_repeat") > rules.max_repeat_words)
    return source.mapInArrow(run, schema).withColumns({"base_failed": failed, "kept": ~failed & ~bad})


def repeats(docs: DataFrame, least: int = RepetitionRules.repeat_words, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, starts``: each text's maximal repeats of ``least`` words or more, one per row.

    ``starts`` are the word places of all occurrences. A repeat that every
    occurrence extends to the left is left out: the longer one stands for it.
    """
    source = keyed(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType),
                           T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def rows(batch: pa.RecordBatch):
        import numpy as np

        for doc, text in zip(batch.column(0).to_pylist(), raw_texts(batch)):
            codes = word_codes(text.split())
            places, lcp = suffix_array(codes, np.full(len(codes), len(codes), np.int64))
            before = np.append(codes, -1)[places - 1]  # the word to the left; none before the first
            before[places == 0] = -1
            for length, first, end, _ in intervals(lcp, least):
                left = before[first:end]
                if left[0] == -1 or (left != left[0]).any():
                    yield doc, length, sorted(places[first:end].tolist())

    return source.mapInArrow(lambda batches: (b for batch in batches for b in in_batches(rows(batch), arrow, 500)),
                             schema)
