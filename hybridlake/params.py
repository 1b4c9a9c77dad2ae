"""Frozen parameter sets and the fixed values every engine must agree on.

Operators take one of these dataclasses instead of loose keyword arguments so
that a whole job is described by a handful of immutable values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results): window and vector
# sizes, leg weights, request bounds as (least, greatest, default), the history
# cap, the embedding prefix and the pieces of both prompts.
# ---------------------------------------------------------------------------
DEFAULT_CHUNK_SIZE = 300
DEFAULT_CHUNK_OVERLAP = 100
DEFAULT_EMBEDDING_DIM = 768
KEYWORD_WEIGHT = 0.3
VECTOR_WEIGHT = 0.7
QUERY_TOP_K = (1, 10, 3)
SEARCH_TOP_K = (1, 20, 5)
TEMPERATURE = (0.0, 2.0, 0.7)
MAX_HISTORY_MESSAGES = 1000
PASSAGE_PREFIX = "passage: "
PDF_SUFFIX = ".pdf"
CONTEXT_INTRO = "Use the following context to answer the question.\nContext:\n"
NO_CONTEXT_LINE = "No passage was found for this request; reply from general knowledge.\n"
HISTORY_HEADER = "Conversation History:\n"
USER_ROLE = "user"
USER_LABEL = "User"
ASSISTANT_LABEL = "Assistant"
TUTORIAL_PROMPT_HEAD = (
    "You are a helpful AI assistant. Use the following context to answer the question.\n"
    "If you cannot find the answer in the context, say so.\n\nContext:\n"
)
TUTORIAL_QUESTION = "\n\nQuestion: "
TUTORIAL_ANSWER = "\n\nAnswer: "

# Our own opening line for chat prompts; callers pass theirs through PromptParams.preamble.
DEFAULT_PREAMBLE = "Reply to the last message below.\n"


@dataclass(frozen=True)
class ChunkParams:
    """Token windows over cleaned text (tokens = single-space split)."""

    chunk_size: int = DEFAULT_CHUNK_SIZE
    overlap: int = DEFAULT_CHUNK_OVERLAP

    def __post_init__(self) -> None:
        if self.chunk_size <= 0:
            raise ValueError(f"chunk_size must be positive, got {self.chunk_size}")
        if not 0 <= self.overlap < self.chunk_size:
            # The reference loops forever here; we refuse the parameters.
            raise ValueError(
                f"overlap must satisfy 0 <= overlap < chunk_size, got {self.overlap} / {self.chunk_size}"
            )

    @property
    def step(self) -> int:
        return self.chunk_size - self.overlap


@dataclass(frozen=True)
class EmbedParams:
    """Embedding contract: declared dimension, the asymmetric prefix flag, and
    the encoder. ``encoder()`` makes an object with ``encode(list[str]) ->
    (n, dim)`` and is told apart by ``encoder_name``; None is the built-in
    hashing of terms."""

    dim: int = DEFAULT_EMBEDDING_DIM
    passage_prefix: bool = False
    encoder: Callable[[], object] | None = None
    encoder_name: str = "term-hashing"

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError(f"dim must be positive, got {self.dim}")
        if self.encoder is not None and self.encoder_name == "term-hashing":
            raise ValueError("name the encoder")


@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class SearchParams:
    """Top-k search and hybrid fusion.

    ``space`` is ``"l2"`` (score 1/(1+d^2)) or ``"cosine"`` (score (1+cos)/2).
    ``normalization`` is ``"min_max"`` or ``"none"`` (raw weighted mean).
    ``max_broadcast_bytes`` bounds the query batch shipped to every task; larger
    batches are searched in several passes over the corpus.
    """

    top_k: int = SEARCH_TOP_K[2]
    space: str = "l2"
    keyword_weight: float = KEYWORD_WEIGHT
    vector_weight: float = VECTOR_WEIGHT
    normalization: str = "min_max"
    bm25: BM25Params = field(default_factory=BM25Params)
    max_broadcast_bytes: int = 64 * 1024 * 1024
    query_block: int = 1024
    #: Of a routed search: vectors and queries of a cell that one task holds.
    cell_rows: int = 50_000
    cell_queries: int = 20_000

    def __post_init__(self) -> None:
        if self.top_k < 1:
            raise ValueError(f"top_k must be >= 1, got {self.top_k}")
        if self.space not in ("l2", "cosine"):
            raise ValueError(f"unknown space {self.space!r}")
        if self.normalization not in ("min_max", "none"):
            raise ValueError(f"unknown normalization {self.normalization!r}")
        if self.keyword_weight < 0 or self.vector_weight < 0 or (
            self.keyword_weight + self.vector_weight
        ) <= 0:
            raise ValueError("weights must be non-negative with a positive sum")


@dataclass(frozen=True)
class PromptParams:
    preamble: str = DEFAULT_PREAMBLE
    no_context_line: str = NO_CONTEXT_LINE
    first_label: int = 0
    max_history: int = MAX_HISTORY_MESSAGES

    def __post_init__(self) -> None:
        if self.max_history < 0:
            raise ValueError("max_history must be >= 0")


@dataclass(frozen=True)
class IVFParams:
    """``n_cells`` None: about the square root of the number of vectors. The
    centroids are broadcast, so their bytes are bounded; they are fitted on
    about ``max_train_rows`` vectors at most (every vector is assigned a cell
    and searched)."""

    n_cells: int | None = None
    nprobe: int = 8
    max_iter: int = 20
    seed: int = 7
    max_train_rows: int = 2_000_000
    max_center_bytes: int = 256 * 1024 * 1024

    def __post_init__(self) -> None:
        if self.nprobe < 1 or (self.n_cells is not None and self.nprobe > self.n_cells):
            raise ValueError("nprobe must be in 1..n_cells")
