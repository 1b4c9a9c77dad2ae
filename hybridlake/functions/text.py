"""Column expressions for text: cleaning, token windows, analysis, display.

Everything here returns a ``Column`` built from Spark built-ins, so it runs
JVM-side inside whole-stage code generation (the lambda-based array functions
are interpreted per row but never leave the JVM).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hybridlake.params import PASSAGE_PREFIX, PDF_SUFFIX, ChunkParams

# Java-regex forms of the five cleaning steps. Python's Unicode
# ``\w`` is written ``[\p{L}\p{N}_]`` and ``str.strip()`` whitespace is written
# ``[\t-\r\x1c-\x20\x85\p{Z}]``; ``\z`` (not ``$``) anchors the true end.
# A match starts at its word's or run's first character and never gives any back,
# so that long words and long runs take linear time.
HYPHEN_BREAK = r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)-\n([\p{L}\p{N}_]++)"
LONE_NEWLINE = r"(?<!\n)\n(?!\n)"
NEWLINE_RUN = r"\n+"
BLANK_RUN = r"[ \t]+"
EDGE_WHITESPACE = r"^[\t-\r\x1c-\x20\x85\p{Z}]+|(?<![\t-\r\x1c-\x20\x85\p{Z}])[\t-\r\x1c-\x20\x85\p{Z}]++\z"
# Our analyzer: lower case, then words by the published word-boundary rules: marks
# stay with their letter, ``_`` joins, an apostrophe, stop, colon or middle dot
# between letters and a stop, comma, semicolon or apostrophe between digits is part
# of the word, and ideographs and hiragana are words of their own.
SINGLE = r"[\p{IsHan}\p{IsHiragana}]"
TERM = (r"_*[\p{L}\p{N}][\p{L}\p{M}\p{N}_]*+(?:(?:(?<=[\p{L}\p{M}])['\u2019.:\u00b7](?=\p{L})"
        r"|(?<=\p{N})[.,;'\u2019](?=\p{N}))[\p{L}\p{M}\p{N}_]++)*")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(text: str | Column) -> Column:
    """Join hyphen-broken words, unwrap single newlines, squeeze runs, strip ends."""
    c = F.regexp_replace(_col(text), HYPHEN_BREAK, "$1$2")
    c = F.regexp_replace(c, LONE_NEWLINE, " ")
    c = F.regexp_replace(c, NEWLINE_RUN, "\n")
    c = F.regexp_replace(c, BLANK_RUN, " ")
    return F.regexp_replace(c, EDGE_WHITESPACE, "")


def clean_again(cleaned: str | Column) -> Column:
    """``clean_text`` applied to text that ``clean_text`` already produced.

    Such text has no newline runs, no blank runs and no edge whitespace, so the
    second pass reduces to: join hyphen breaks, turn every newline into a
    space, squeeze blanks (exactly equal to the full pass; tested against it).
    """
    c = _col(cleaned)
    again = F.regexp_replace(F.translate(F.regexp_replace(c, HYPHEN_BREAK, "$1$2"), "\n", " "), BLANK_RUN, " ")
    return F.when(F.instr(c, "\n") == 0, c).otherwise(again)


def tokens(text: str | Column) -> Column:
    """Single-space split keeping empty tokens (``''`` gives ``['']``)."""
    return F.split(_col(text), " ", -1)


def chunk_windows(toks: str | Column, params: ChunkParams = ChunkParams()) -> Column:
    """``array<string>`` of overlapping windows over a token array.

    Windows start at 0, step, 2*step, ... while start < #tokens, so the count
    is ceil(n / step); a tail window contained in its predecessor is kept and
    an empty text (tokens ``['']``) yields one empty chunk. Pass a *column*
    bound in an earlier projection: an expression would be re-evaluated inside
    the lambda once per window.
    """
    t = _col(toks)
    starts = F.sequence(F.lit(0), F.size(t) - 1, F.lit(params.step))
    return F.transform(starts, lambda s: F.array_join(F.slice(t, s + 1, params.chunk_size), " "))


def analyze(text: str | Column) -> Column:
    """Terms of a text, in order: lower-case words (``TERM``)."""
    t = F.lower(_col(text))
    apart = F.when(t.rlike(SINGLE), F.regexp_replace(t, rf"({SINGLE}\p{{M}}*)", " $1 ")).otherwise(t)
    return F.regexp_extract_all(apart, F.lit(TERM), F.lit(0))


def record_name(path: str | Column) -> Column:
    """Document name: the path with every ``.pdf`` substring removed."""
    return F.replace(_col(path), F.lit(PDF_SUFFIX), F.lit(""))


def record_id(name: str | Column, index: str | Column) -> Column:
    return F.concat_ws("_", _col(name), _col(index).cast("string"))


def with_passage_prefix(text: str | Column, enabled: bool) -> Column:
    """Optional asymmetric-embedding prefix."""
    return F.concat(F.lit(PASSAGE_PREFIX), _col(text)) if enabled else _col(text)


def preview(text: str | Column, n: int = 200) -> Column:
    """First ``n`` characters followed by ``...``."""
    return F.concat(F.substring(_col(text), 1, n), F.lit("..."))
