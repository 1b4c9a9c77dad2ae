import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hybridlake.llm import packing
from llm.conftest import odd_rows, prose, table


def test_plan_is_a_gapless_packing():
    rng = random.Random(3)
    for _ in range(30):
        cap = rng.choice([7, 16, 50])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 400)))
        slots, ranks = {}, Counter()
        for length, first, end, sequence, per, offset in packing.best_fit_plan(dict(counts), cap):
            for rank in range(first, end):
                k = rank - first
                slots.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
                ranks[length, rank] += 1
        assert ranks == {(n, r): 1 for n, c in counts.items() for r in range(c)}
        for held in slots.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= cap
        # best fit decreasing needs at most 11/9 of the best, and a little
        assert len(slots) <= 11 / 9 * -(-sum(n * c for n, c in counts.items()) // cap) + 4 or min(counts) > cap // 3


def test_memo_gives_the_library_s_ids():
    encoder = packing.Encoder(packing.default_tokenizer())
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "C's", "1.5", ".", ",", "é", "\t", "中", "\U0001f642", "<|endoftext|>", "\r", "\x1c",
             "\x85", "Straße", "***", " ", "it'll", "_x"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        expected = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == expected, text


def test_added_tokens_keep_their_id():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())  # as the file has it
    encoder = packing.Encoder(packing.default_tokenizer())
    assert plain.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    for text in ("a<|endoftext|>b", "<|endoftext|>", "one two <|endoftext|>\nthree", " <|endoftext|> <|endoftext|>",
                 "<|endoftext|", "no marker here", prose(3, 40) + "<|endoftext|>" + prose(4, 40)):
        expected = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == expected, text


def test_pieces_and_sequences(spark, odd):
    rows = packing.pack(odd, capacity=64).collect()
    tokenizer = packing.Encoder(packing.default_tokenizer())
    whole = sorted(((d is None, d or 0), tokenizer.encode(t or "") + b"\0\0\0\0") for d, t in odd_rows())
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["piece"]), []).append(r)
    texts = Counter((d, ids) for d, ids in whole)
    # put the pieces of single ids together again
    for d, t in odd_rows():
        if d in (None, 2):
            continue
        ids = tokenizer.encode(t or "") + b"\0\0\0\0"
        pieces = [got[d, i][0] for i in range(-(-len(ids) // 4 // 64))]
        assert b"".join(bytes(p["ids"]) for p in pieces) == ids
        assert all(p["length"] == 64 for p in pieces[1:]) and pieces[0]["start"] == 0
    assert sum(r["length"] for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in texts.items())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:]))
        assert sum(n for _, n in held) <= 64
    packed = packing.sequences(packing.pack(odd, capacity=64)).collect()
    assert sum(len(r["ids"]) for r in packed) == 4 * sum(r["length"] for r in rows)


def test_digests_are_of_the_placed_ids(spark, odd, monkeypatch):
    tables, put = [], packing.stored
    monkeypatch.setattr(packing, "stored", lambda df, *how: tables.append(put(df, *how)) or tables[-1])
    found = packing.pack_digests(odd).collect()
    assert len(tables) == 1 and "ids" in tables[0].columns  # the query's own path writes the ids
    expected = Counter((r["doc_id"], r["piece"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in tables[0].collect())
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in found) == expected


def test_the_pipeline_returns_the_ids_it_packs(spark, odd):
    import corpus_pipeline

    packed = corpus_pipeline.STAGES[-1][1](spark, odd, "")
    rows = packed.collect()
    encode = packing.Encoder(packing.default_tokenizer()).encode
    whole = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert len(r["ids"]) == 4 * r["length"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        if r["doc_id"] not in (None, 2):  # ids of a single row
            whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    assert whole == {d: encode(t or "") + b"\0\0\0\0" for d, t in odd_rows() if d not in (None, 2)}
    parts = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        parts[r["sequence_id"]] = parts.get(r["sequence_id"], b"") + bytes(r["ids"])
    assert {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()} == parts


def test_empty_table(spark, empty):
    assert packing.pack_digests(empty).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 200])
def test_cut(n):
    pieces = packing.cut(n, 64)
    assert pieces[0][0] == 0 and sum(x for _, x in pieces) == n and all(x == 64 for _, x in pieces[1:])


def test_ranks_of_a_common_length_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 10)
    docs = table(spark, [(i, "same text here") for i in range(300)] + [(i, "other") for i in range(300, 330)])
    rows = packing.pack_digests(docs).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(rows) == len(places) == 330
