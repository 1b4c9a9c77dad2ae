import hashlib
import random
from array import array

import pytest

from hybridlake.llm import bpe_chunks, queries
from hybridlake.llm.bpe_chunks import ChunkParams, Encoder
from llm.conftest import odd_rows, prose, table

PARTS = ["a", "b", " ", "  ", "\n", "C's", "1.5", ".", ",", "é", "\t", "中", "\U0001f642", "<|endoftext|>", "\r", "\x1c", "\x85",
         "Straße", "***", " ", "it'll", "_x", "e", "́", "ΑΣ", "İ", "'", "'S", "<|", "​", "x" * 30, "Ŀ", "ŉ", "ſ", "ẞ",
         "ﬁ", "ÄÖÜß", "ø1ø", " n't", "LL'LL", " 'd", "a'Ré", "\x00", "\v", "　"]


def whole(texts, path=None):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path or bpe_chunks.default_tokenizer())
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids
        yield array("I", ids).tobytes(), plain.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("params", [ChunkParams(bits=2, least=1, most=9), ChunkParams(bits=4, least=4, most=40, memo_pieces=20),
                                    ChunkParams()])
def test_chunks_and_repaired_joins_give_the_library_s_tokens(params):
    rng = random.Random(6)
    encoder = Encoder(bpe_chunks.default_tokenizer(), params)
    assert encoder.direct
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(900)] + [prose(1, 3000), "y" * 20_000]
    found = [(ids, shown.decode()) for ids, shown in encoder.encode_texts([t.encode() for t in texts], {})]
    for text, own, expected in zip(texts, found, whole(texts)):
        assert own == expected, text


def test_cuts_follow_the_content():
    params = ChunkParams(bits=5, least=16, most=400)
    shared = prose(3, 600).encode()
    one, other = bpe_chunks.chunks(b"x" * 7 + shared, params), bpe_chunks.chunks("é or so\n".encode() * 9 + shared, params)
    assert b"".join(one) == b"x" * 7 + shared
    assert len(set(one) & set(other)) > .8 * len(one)
    text = ("é中\U0001f642" * 2000).encode()
    for part in bpe_chunks.chunks(text, params):
        assert len(part) <= 400 and part.decode()  # never inside a character
    assert bpe_chunks.chunks(b"", params) == []
    blocks = prose(8, 400_000).encode()  # more than one block of the rolling hash
    assert len(blocks) > 2 * bpe_chunks.BLOCK
    tail = blocks[bpe_chunks.BLOCK + 77:]
    assert (bpe_chunks.rolling(tail) == bpe_chunks.rolling(blocks)[bpe_chunks.BLOCK + 77:]).all()


def test_a_join_that_doesn_t_agree_falls_back_to_the_whole_text(monkeypatch):
    params = ChunkParams(bits=3, least=4, most=60)
    encoder = Encoder(bpe_chunks.default_tokenizer(), params)
    text = prose(2, 200)
    monkeypatch.setattr(encoder, "repair", lambda windows, own=encoder.repair: [None, *own(windows)[1:]])
    assert [(i, s.decode()) for i, s in encoder.encode_texts([text.encode()], {})] == list(whole([text]))
    broken = Encoder(bpe_chunks.default_tokenizer(), params)
    monkeypatch.setattr(broken, "tokens", lambda data, own=broken.tokens: own(data.replace(b" ", b"x", 1)))
    assert None in broken.repair([(b"one", b"two", b"three")])


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        Encoder(public_tokenizers.path("byte_bpe_50k.json"), ChunkParams())


def test_shared_chunks_are_handed_out_once_and_used(spark, monkeypatch):
    passage = prose(12, 1500)
    rows = [(i, prose(100 + i, 50) + "\n" + passage) for i in range(6)] + [(9, prose(77, 700))]
    docs = table(spark, rows).repartition(3)
    params = ChunkParams(bits=8, least=64)
    shared = bpe_chunks.shared_chunks(docs.select("doc_id", "text"), bpe_chunks.default_tokenizer(), params)
    held = sum(map(len, shared))
    assert .8 * len(passage) < held <= len(passage) + 10
    small = ChunkParams(bits=8, least=64, shared_bytes=1000)
    assert 0 < sum(map(len, bpe_chunks.shared_chunks(docs.select("doc_id", "text"), bpe_chunks.default_tokenizer(), small))) <= 1000
    encoder = Encoder(bpe_chunks.default_tokenizer(), params)
    encoded = []
    monkeypatch.setattr(encoder, "encode_chunk", lambda part, own=encoder.encode_chunk: encoded.append(part) or own(part))
    found = [(i, s.decode()) for i, s in encoder.encode_texts([t.encode() for _, t in rows], shared)]
    assert found == list(whole([t for _, t in rows]))
    assert not set(encoded) & set(shared)
    got = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in bpe_chunks.encode(docs, params=params).collect()}
    assert got == dict(zip([i for i, _ in rows], found))


def test_the_query_and_odd_rows(spark, odd, empty, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = [t or "" for _, t in odd_rows()]
    expected = [(d, len(ids) // 4, sha(ids), sha(shown.encode())) for (d, _), (ids, shown) in zip(odd_rows(), whole(texts))]
    got = queries.op12_bpe(spark, str(tmp_path))
    assert dict(got.dtypes)["n_tokens"] == "bigint"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert bpe_chunks.encode(empty).count() == 0
    encoded = bpe_chunks.encode(odd)
    assert sorted(r["decoded"] for r in bpe_chunks.decode(encoded).collect()) == sorted(r["decoded"] for r in encoded.collect())
