"""Operators 1, 5, 7 and 8 and the pipeline: whole tables against brute force."""

import hashlib
import random
import struct
from array import array
from collections import Counter

import corpus_pipeline
import numpy as np
import xxhash
from pyspark.sql import functions as F

from hybridlake.llm import components, line_templates, secrets, sentencepieces, simhash, suffix_dedup
from llm.conftest import WORDS, odd_rows, prose, table


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# ---- operator 1

def field(number, kind, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    head = varint(number << 3 | kind)
    return head + (varint(value) if kind == 0 else varint(len(value)) + value if kind == 2 else value)


def unigram_model(tmp_path):
    """A small model written by hand: byte pieces, letters and a few words with scores."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [(c, -6.0 - i / 10, 1) for i, c in enumerate("▁abcdefghijklmnopqrstuvwxyz.,")]
    pieces += [("▁the", -2.0, 1), ("the", -3.0, 1), ("▁he", -2.5, 1), ("ing", -2.2, 1), ("▁sing", -4.1, 1), ("re", -3.3, 1)]
    data = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k))
                    for t, s, k in pieces)
    data += field(2, 2, field(3, 0, 1) + field(35, 0, 1))
    data += field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    return str(path)


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "he", "sing", "ing", " ", "  ", "\n", "a", "z", ".", "é", "中", "\U0001f642", "▁", "X", "\t", "\0"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_unigram_scores_and_byte_fallback(tmp_path):
    codec = sentencepieces.Codec(unigram_model(tmp_path), 1)
    assert codec.model.kind == sentencepieces.UNIGRAM and codec.model.byte_fallback
    for text, (ids, parity) in zip(random_texts(1, 2000), codec.encode_block(random_texts(1, 2000))):
        assert array("I", ids).tolist() == codec.reference.encode(text), text
        assert parity


def test_plain_pieces_are_decoded_as_the_pipeline_does():
    import random

    codec = sentencepieces.Codec(sentencepieces.default_model(), 1)
    rng, n = random.Random(4), len(codec.model.pieces)
    lists = [[rng.randrange(n) for _ in range(rng.randint(0, 12))] for _ in range(4000)] + [[i] for i in range(n)] + [[n + 7], [n - 1, n + 7]]
    expected = codec.tokenizer.decode_batch(lists, skip_special_tokens=False)
    assert codec.decode(lists) == expected
    plain = [own for own in lists if all(i < n and codec.surface[i] is not None for i in own)]
    assert len(plain) > 0.9 * len(lists)
    codec.tokenizer = None  # plain pieces don't need it
    assert codec.decode(plain) == [text for own, text in zip(lists, expected) if all(i < n and codec.surface[i] is not None for i in own)]


def test_bpe_parity_and_round_trip():
    codec = sentencepieces.Codec(sentencepieces.default_model(), 2)
    block = random_texts(2, 2000) + [prose(i, 80) for i in range(20)]
    for text, (ids, parity) in zip(block, codec.encode_block(block)):
        assert array("I", ids).tolist() == codec.reference.encode(text) and parity, text
        back, = codec.decode([array("I", ids).tolist()])
        assert back == text.replace("▁", " ")


def test_keys_stand_for_the_segments(tmp_path):
    for path in (sentencepieces.default_model(), unigram_model(tmp_path)):
        codec = sentencepieces.Codec(path, 1)
        for text in [*random_texts(6, 3000), "", " ", "  ", " a", "a ", "a  b", "▁", " ▁a▁ b "]:
            assert [codec.segment(k) for k in codec.keys(text)] == codec.segments(codec.normal(text)), text


def test_memos_are_small():
    import tracemalloc

    codec = sentencepieces.Codec(sentencepieces.default_model(), 1)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) + "," for _ in range(40_000)]
    tracemalloc.start()
    for at in range(0, len(words), 5_000):
        for _ in codec.encode_block([" ".join(words[at:at + 5_000])]):
            pass
    used, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(codec.memo) >= 39_000 and used < 230 * len(codec.memo)


def test_bad_segments_are_told_each_time():
    codec = sentencepieces.Codec(sentencepieces.default_model(), 1)

    class Other:
        def encode(self, texts, num_threads, put=codec.reference.encode):
            return [[1] if t in ("odd", "x" * 100) else ids for t, ids in zip(texts, put(texts, num_threads=num_threads))]

        def piece_to_id(self, piece):
            return 1

    codec.reference = Other()
    block = ["an odd word", "a plain word", "a blank at the end ", "x" * 100]
    for _ in range(3):
        assert [ok for _, ok in codec.encode_block(block)] == [False, True, False, False]
    next(codec.encode_block(["so odd", "odd too"]))  # not read to its end
    assert [ok for _, ok in codec.encode_block(["odd", "too"])] == [False, True]


def test_encode_and_decode_tables(spark, odd, empty):
    coded = sentencepieces.encode(odd)
    rows = sentencepieces.decode(coded).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((d, (t or "").replace("▁", " ")) for d, t in odd_rows())
    assert all(r["parity"] for r in rows)
    assert sentencepieces.encode(empty).count() == 0


# ---- operator 5

def removed(texts, least):
    seen = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    for t in texts:
        runs = []
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + least
                else:
                    runs.append([i, i + least])
        yield [tuple(r) for r in runs]


def got_runs(docs, least):
    return Counter((r["doc_id"], tuple((s["start"], s["end"]) for s in r["removed"]), r["n_bytes"], hashlib.sha256(
        bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(docs, least).collect())


def expected_runs(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    out = Counter()
    for (doc, _), text, runs in zip(rows, texts, removed(texts, least)):
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + text[at:a], b
        out[doc, tuple(runs), len(text), hashlib.sha256(kept + text[at:]).hexdigest()] += 1
    return out


def test_repeats_around_a_gram():
    rng = random.Random(2)
    for turn in range(800):
        need, alphabet = rng.randint(2, 8), [b"a", b"ab", b"abc\0"][turn % 3]
        part = lambda: bytes(rng.choice(alphabet) for _ in range(rng.choice([need, need, rng.randint(0, need)])))
        held = list({(part(), part()) for _ in range(rng.randint(2, 12))})
        if len(held) < 2:
            continue
        lefts, rights = zip(*held)
        reach, groups = [(-1, -1)] * len(held), set()
        for i in range(len(held)):
            for j in range(len(held)):
                a, b = common(lefts[i], lefts[j]), common(rights[i], rights[j])
                if i != j and a + b >= need:
                    reach[i] = (max(reach[i][0], a), max(reach[i][1], b))
                    groups.add((a, b, frozenset(k for k in range(len(held)) if common(lefts[i], lefts[k]) >= a
                                                and common(rights[i], rights[k]) >= b)))
        assert suffix_dedup.furthest(list(lefts), list(rights), need) == reach
        found = {(a, b, frozenset(m)) for a, b, m in suffix_dedup.maximal_repeats(list(lefts), list(rights), need)}
        assert groups <= found


def test_contexts_are_compared_once(monkeypatch):
    """However deep the intervals lie in each other, bytes are compared for each context's two sides alone."""
    rng, seen = random.Random(12), []
    rights = ["a" * i + "b" * 30 for i in range(30)] * 4
    lefts = ["".join(rng.choice("ab") for _ in range(30)) for _ in rights]
    held = sorted({(a.encode(), b[:30].encode()) for a, b in zip(lefts, rights)})
    lefts, rights = zip(*held)
    monkeypatch.setattr(suffix_dedup, "_common", lambda rows, lengths, f=suffix_dedup._common: seen.append(len(rows)) or f(rows, lengths))
    found = list(suffix_dedup.maximal_repeats(lefts, rights, 30))
    assert len(found) > 20 and sum(seen) == 2 * len(held)
    expected = {(a, b, frozenset(k for k in range(len(held)) if common(lefts[i], lefts[k]) >= a and common(rights[i], rights[k]) >= b))
                for i in range(len(held)) for j in range(i) for a, b in [(common(lefts[i], lefts[j]), common(rights[i], rights[j]))]
                if a + b >= 30}
    assert expected <= {(a, b, frozenset(m)) for a, b, m in found}


def corpus_rows():
    passage = prose(90, 120)
    rng = random.Random(4)
    rows = [(i, prose(100 + i, 40) + passage[rng.randint(0, 300):len(passage) - rng.randint(0, 300)] + prose(300 + i, 30))
            for i in range(25)]
    near = prose(91, 150)
    for i in range(25, 45):
        at = rng.randint(0, len(near) - 1)
        rows.append((i, near[:at] + "#" + near[at + 1:]))
    return rows + [(45, near), (46, near), (47, "é" * 500), (48, "é" * 600 + "z"), (49, prose(92, 60) * 3)] + odd_rows()


def test_suffix_dedup_against_brute_force(spark, monkeypatch, empty):
    rows = corpus_rows()
    docs = table(spark, rows).repartition(4)
    assert got_runs(docs, 400) == expected_runs(rows, 400)
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", 3)  # larger buckets are counted
    assert got_runs(docs, 400) == expected_runs(rows, 400)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_texts_have_the_anchors_of_their_parts(monkeypatch):
    text = prose(5, 4000).encode()
    whole = suffix_dedup.anchors(text, 200, 201)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    assert suffix_dedup.anchors(text, 200, 201) == whole
    assert all(any(a <= p <= a + 200 for p in whole) for a in range(len(text) - 399))


def test_groups_list_all_occurrences(spark):
    passage = prose(93, 80)
    rows = [(i, prose(400 + i, 20) + passage + prose(500 + i, 20)) for i in range(6)]
    found = suffix_dedup.repeat_groups(table(spark, rows)).groupBy("gram", "group").agg(
        F.collect_set(F.struct("doc_id", "start", "end")).alias("at")).collect()
    assert any(len(r["at"]) == 6 for r in found)
    by_id = dict(rows)
    for r in found:
        assert len({by_id[o["doc_id"]].encode()[o["start"]:o["end"]] for o in r["at"]}) == 1 and len(r["at"]) > 1


def test_removed_bytes_are_the_union_of_the_groups(spark, monkeypatch):
    passage = prose(93, 80)
    rows = [(i, prose(400 + i, 20) + passage + prose(500 + i, 20)) for i in range(6)]
    rows += [(i, r) for n, r in enumerate((prose(600, 20) + passage, prose(601, 20) + passage)) for i in (10 + n, 20 + n)]
    tables = {}

    def stored(df, name, put=suffix_dedup.stored):
        return tables.setdefault(name, put(df, name))

    monkeypatch.setattr(suffix_dedup, "stored", stored)
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["removed"]] for r in suffix_dedup.remove_repeats(
        table(spark, rows)).collect()}
    groups = tables["repeat-groups"].collect()  # written on the query's own path
    assert groups and all(len(set(r["members"])) == len(r["members"]) > 1 for r in groups)
    monkeypatch.undo()
    spans, texts = {}, {}
    by_id = {i: t.encode() for i, t in rows}
    for r in suffix_dedup.repeat_groups(table(spark, rows)).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        texts.setdefault((r["gram"], r["group"]), []).append(by_id[r["doc_id"]][r["start"]:r["end"]])
    assert found == {i: suffix_dedup.merge(spans.get(i, []), len(t)) for i, t in by_id.items()}
    assert all(len(set(t)) == 1 < len(t) for t in texts.values())  # different contexts of a gram are different groups


def test_reach_is_written_beside_the_groups(spark, monkeypatch):
    """Removal reads a row for each context, not the groups' members; large groups take several rows."""
    passage = prose(95, 160)
    rng = random.Random(8)
    rows = [(i, prose(700 + i, 20) + passage[rng.randint(0, 200):len(passage) - rng.randint(0, 200)] + prose(800 + i, 20))
            for i in range(30)]
    tables = {}

    def stored(df, name, put=suffix_dedup.stored):
        return tables.setdefault(name, put(df, name))

    monkeypatch.setattr(suffix_dedup, "stored", stored)
    monkeypatch.setattr(suffix_dedup, "OUT_MEMBERS", 10)  # a bucket's groups come in several batches
    monkeypatch.setattr(suffix_dedup, "ROW_MEMBERS", 4)
    found = suffix_dedup.remove_repeats(table(spark, rows))
    read = found._jdf.queryExecution().executedPlan().toString()
    assert "reached" in read and "members" not in read
    assert Counter((r["doc_id"], tuple((s["start"], s["end"]) for s in r["removed"]), r["n_bytes"], hashlib.sha256(
        bytes(r["kept"])).hexdigest()) for r in found.collect()) == expected_runs(rows, 400)
    union, reached, sizes = {}, {}, Counter()
    for r in tables["repeat-groups"].collect():
        assert 0 < len(r["members"]) <= 4
        sizes[r["gram"], r["group"]] += len(r["members"])
        for context in r["members"]:
            left, right = union.get((r["gram"], context), (0, 0))
            union[r["gram"], context] = max(left, r["left"]), max(right, r["right"])
        for x in r["reached"]:
            assert (r["gram"], x["context"]) not in reached
            reached[r["gram"], x["context"]] = x["left"], x["right"]
    assert reached == union and max(sizes.values()) > 4


# ---- operator 7

def test_templates_with_variable_fields_go(spark):
    rows = [(i, f"{prose(i, 30)}\nPage {i} of 99 printed by {WORDS[i]} {WORDS[i + 5]} for the archive only\n{prose(i + 50, 20)}")
            for i in range(20)]
    same = "\n".join(f"line number {w} stays where it is {w}" for w in WORDS[:6])
    rows += [(i, same) for i in range(30, 40)]  # copies are one text: nothing recurs
    out = {r["doc_id"]: r for r in line_templates.drop_boilerplate(table(spark, rows), count_col="lost").collect()}
    by_id = dict(rows)
    assert out[0]["text"] == by_id[0] and out[0]["lost"] == 0  # the first keeps its line
    for i in range(1, 20):
        assert out[i]["text"] == "\n".join(x for x in by_id[i].split("\n") if not x.startswith("Page")), i
    assert all(out[i]["text"] == same for i in range(30, 40))


def left_in(spark, rows):
    return {r["doc_id"]: r["text"] for r in line_templates.drop_boilerplate(table(spark, rows)).collect()}


def test_numeric_tables_stay(spark):
    rng = random.Random(8)
    number = lambda: rng.choice(["%d", "%.2f", ".%d", "%d%%"]) % rng.randint(1, 99)
    rows = [(i, "\n".join([prose(i, 20), *(" ".join(number() for _ in range(4)) for _ in range(12)),
                           *(f"total {number()} {number()} {number()} {number()}" for _ in range(3))])) for i in range(10)]
    assert left_in(spark, rows) == dict(rows)  # templates without constant tokens say nothing


def test_rarer_variants_go_with_the_frequent_one(spark):
    kinds = ["Sports"] * 40 + ["Health"] * 4 + ["Travel"]
    line = "Read more about our {} section today"
    rows = [(i, f"{prose(i, 30)}\n{line.format(kind)}\nunique {WORDS[i % 30]} text {prose(900 + i, 3)}")
            for i, kind in enumerate(kinds)]
    out = left_in(spark, rows)
    assert out[0] == rows[0][1]
    for i, text in rows[1:]:
        assert out[i] == text.replace(line.format(kinds[i]) + "\n", ""), i


def test_long_lines_go_from_two_texts_on(spark):
    words = prose(31, 60).replace("\n", " ")
    rows = [(i, f"{prose(i, 20)}\n{words}") for i in (3, 1, 2)]
    rows += [(i, f"{prose(i, 20)}\nshort lines in two texts stay") for i in (4, 5)]
    assert left_in(spark, rows) == {**dict(rows), 2: prose(2, 20), 3: prose(3, 20)}
    blanks = [(1, words + "\nx"), (2, words.replace(" ", " \t ") + "\ny")]  # white space doesn't tell lines apart
    assert left_in(spark, blanks) == {1: words + "\nx", 2: "y"}


def test_taking_lines_away_is_linear(spark):
    import time

    lines = [f"the same list of names {a}{b}{c} for everyone" for a in WORDS for b in WORDS for c in WORDS[:20]]
    many = "\n".join(lines[:40_000])
    began = time.time()
    out = left_in(spark, [(i, f"{many}\n{prose(i, 12)}") for i in range(6)])
    assert time.time() - began < 60  # one look at all dropped lines for every line took minutes
    assert all(out[i] == prose(i, 12) for i in range(1, 6)) and len(out[0]) > len(many)


def test_line_dedup_on_odd_rows(spark, odd, empty):
    out = line_templates.drop_boilerplate(odd)
    assert out.columns == odd.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()) == Counter(odd_rows())
    assert line_templates.drop_boilerplate(empty).count() == 0


# ---- operator 8

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)][:len(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_pairs(prints, budget=3):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_trie_join_links_what_all_pairs_link():
    rng = np.random.default_rng(1)
    for _ in range(100):
        base = rng.integers(0, 1 << 63, rng.integers(1, 6), dtype=np.uint64)
        values = base[rng.integers(0, len(base), rng.integers(2, 120))]
        for _ in range(rng.integers(0, 6)):
            flip = np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64)
            values = values ^ np.where(rng.random(len(values)) < 0.6, flip, np.uint64(0))
        values = np.unique(values)
        pairs = simhash.trie_links(np.zeros(len(values), int), values)
        assert len(pairs) < len(values)
        assert simhash._roots(pairs[:, 0], pairs[:, 1], len(values)).tolist() == by_pairs(values.tolist())


def test_near_duplicates_against_all_pairs(spark, odd, monkeypatch):
    rng = random.Random(7)
    rows = odd_rows()
    for i in range(100, 160):
        words = prose(i % 6, 300).split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = by_pairs(prints)
    least = {}
    for (doc, _), g in zip(rows, groups):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    expected = Counter((doc, "%016x" % p, least.get(g)) for (doc, _), p, g in zip(rows, prints, groups))
    for split in (simhash.SPLIT_ROWS, 2):  # with and without split buckets
        monkeypatch.setattr(simhash, "SPLIT_ROWS", split)
        found = simhash.near_duplicates(table(spark, rows).repartition(3))
        assert Counter(tuple(r) for r in found.select(
            "doc_id", simhash.hex_fingerprint(), "component_id").collect()) == expected
    kept = simhash.keep_first(table(spark, rows))
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == odd.columns and set(ids) == set(least.values()) | ({None} if None in {
        least.get(g) for g in groups} else set()) and max(ids.values()) == 1


def test_every_component_keeps_one_row(spark):
    alone = [prose(700 + i, 80) for i in range(8)]  # unrelated texts, no two in one component
    rows = [(None, t) for t in alone[:5]] + [(1, alone[5]), (1, alone[6]), (1, alone[6]), (2, alone[6]), (3, alone[7]),
                                             (None, alone[7])]
    assert len(set(by_pairs([plain_fingerprint(t) for t in alone]))) == len(alone)
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_first(table(spark, rows).repartition(3)).collect())
    assert kept == Counter([(None, t) for t in alone[:5]] + [(1, alone[5]), (1, alone[6]), (3, alone[7])])


def test_no_documents(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 199), (5, 5)]
    found = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(100, 180)} == {100} and found[200] == 199


# ---- the pipeline

def test_each_stage_decides_as_its_operator(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == docs.columns, name
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] == counts[2] >= counts[3] == counts[4] > 0
    prints = [plain_fingerprint(r["text"]) for r in docs.collect()]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert len(set(prints)) >= len(prints) - 2  # the scan changes texts after the near duplicates went
    assert not any(s[0] in ("access", "hex") for r in docs.collect() for s in secrets.base_spans(r["text"])[0])
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_stages_take_odd_and_no_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf).persist()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
