"""Embedding functions.

The reference delegates embedding to a neural text-embedding model. No model is
available offline, so the built-in encoder is deterministic signed feature
hashing of analysed terms, L2-normalised (our design; the same md5-based rule is
written in SQL for the oracle). A caller may plug in any model through
``model_embedding`` (an iterator pandas UDF that loads the model once per
Python worker).

Both encoders run in Arrow batches: tokenisation stays JVM-side (``analyze``)
and only the term arrays cross into Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

VECTOR_TYPE = ArrayType(FloatType(), containsNull=False)


_CODE_CACHE: dict[str, tuple[int, int]] = {}
#: Terms that a worker remembers, and terms and vector elements that it works on at a time: with these bounds its
#: memory doesn't follow the vocabulary or the length of the texts in an Arrow batch.
_CODE_CACHE_MAX = 1 << 17
SLICE_TERMS, SLICE_ELEMENTS = 1 << 18, 1 << 20


def term_code(term: str) -> tuple[int, int]:
    """(bucket seed, sign) of a term: first 8 hex digits of md5, sign from the 9th."""
    code = _CODE_CACHE.get(term)
    if code is None:
        h = hashlib.md5(term.encode("utf-8")).hexdigest()
        code = (int(h[:8], 16), 1 if int(h[8], 16) < 8 else -1)
        if len(_CODE_CACHE) < _CODE_CACHE_MAX:
            _CODE_CACHE[term] = code
    return code


def hash_vectors_arrow(terms: pa.Array, dim: int) -> pa.Array:
    """Vectorised hashing encoder over one Arrow batch of ``list<string>``, a slice of it at a time."""
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    n = len(terms)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    vec = np.zeros((n, dim), np.float32)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = min(int(np.searchsorted(ends, before + SLICE_TERMS, side="right")), at + max(1, SLICE_ELEMENTS // dim))
        to = max(at + 1, to)
        vec[at:to] = _hash_rows(terms.slice(at, to - at), dim)
        at = to
    if not terms.null_count:
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(vec.ravel(), type=pa.float32()))
    valid = terms.is_valid().to_numpy(zero_copy_only=False)  # a null row has no values: else they'd go to the row before it
    offsets = np.concatenate([[0], np.cumsum(valid * dim)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vec[valid].ravel(), type=pa.float32()), mask=pa.array(~valid))


def _hash_rows(terms: pa.Array, dim: int) -> np.ndarray:
    n = len(terms)
    flat = pc.list_flatten(terms)
    if not len(flat):
        return np.zeros((n, dim), np.float32)
    parents = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = pc.dictionary_encode(flat)
    codes = np.array([term_code(t) for t in enc.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
    idx = enc.indices.to_numpy(zero_copy_only=False)
    mat = np.bincount(parents * dim + codes[idx, 0] % dim, weights=codes[idx, 1].astype(np.float64), minlength=n * dim).reshape(n, dim)
    norm = np.sqrt((mat * mat).sum(axis=1))
    return (mat / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32)


def hash_embedding(terms: str | Column, dim: int) -> Column:
    """``array<float>`` hashed bag-of-terms vector (unit length; zero for no terms)."""

    @F.arrow_udf(VECTOR_TYPE)
    def _encode(t: pa.Array) -> pa.Array:
        return hash_vectors_arrow(t, dim)

    return _encode(F.col(terms) if isinstance(terms, str) else terms)


def model_embedding(text: str | Column, encoder_factory: Callable[[], object], dim: int, batch_texts: int = 64) -> Column:
    """Embed with a caller-supplied model: ``encoder_factory()`` must return an
    object with ``encode(list[str]) -> array (n, dim)``; it is built once per
    Python worker. It is given ``batch_texts`` texts of about one length at a
    time, so that a model that pads its batches pads little."""

    @F.pandas_udf(VECTOR_TYPE)
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder_factory()
        for s in batches:
            texts = s.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out = np.zeros((len(texts), dim), np.float32)
            for at in range(0, len(order), batch_texts):
                own = order[at:at + batch_texts]
                found = np.asarray(model.encode([texts[i] for i in own]), dtype=np.float32)
                if found.shape != (len(own), dim):
                    raise ValueError(f"encoder returned shape {found.shape}, expected ({len(own)}, {dim})")
                out[own] = found
            yield pd.Series(list(out))

    return _encode(F.col(text) if isinstance(text, str) else text)


def dimension_ok(vec: str | Column, dim: int) -> Column:
    """Dimension contract: a non-null vector of exactly ``dim`` finite values."""
    v = F.col(vec) if isinstance(vec, str) else vec
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False))


TERM_COUNTS_TYPE = "array<struct<term:string,tf:int>>"


def term_counts_arrow(terms: pa.Array) -> pa.Array:
    """Per row: the distinct terms of a ``list<string>`` with their counts,
    computed for a whole Arrow batch at once (dictionary codes + ``np.unique``)."""
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    n = len(terms)
    parents = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = pc.dictionary_encode(pc.list_flatten(terms))
    v = max(len(enc.dictionary), 1)
    idx = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys, counts = np.unique(parents * v + idx, return_counts=True)
    rows = keys // v
    words = enc.dictionary.take(pa.array(keys % v, type=pa.int64()))
    if words.type != pa.string():
        words = words.cast(pa.string())
    items = pa.StructArray.from_arrays([words, pa.array(counts.astype(np.int32), type=pa.int32())],
                                       names=["term", "tf"])
    offsets = np.zeros(n + 1, dtype=np.int32)
    offsets[1:] = np.cumsum(np.bincount(rows, minlength=n))
    mask = None if terms.null_count == 0 else pa.array(~terms.is_valid().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), items, mask=mask)


def term_counts(terms: str | Column) -> Column:
    """``array<struct<term, tf>>``: term frequencies of one row's term array."""

    @F.arrow_udf(TERM_COUNTS_TYPE)
    def _count(t: pa.Array) -> pa.Array:
        return term_counts_arrow(t)

    return _count(F.col(terms) if isinstance(terms, str) else terms)
