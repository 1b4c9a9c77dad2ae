"""Operators 3, 4, 6, 9 and 10: one row in, one row out."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from hybridlake.llm import fingerprints, quality_model, quality_rules, secrets, toxicity
from llm.conftest import odd_rows, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, width):
    seen = Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    inside = [False] * len(words)
    for i in range(len(words) - width + 1):
        if seen[tuple(words[i:i + width])] > 1:
            inside[i:i + width] = [True] * width
    return sum(inside)


def test_quality_rules_against_brute_force(spark, odd):
    rules = quality_rules.RepetitionRules()
    got = Counter(tuple(r) for r in quality_rules.apply_rules(odd).collect())
    expected = Counter()
    for doc, text in odd_rows():
        words = WORD.findall(text or "")
        n = len(words)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        longest = next((w - 1 for w in range(1, n + 2) if not any(
            c > 1 for c in Counter(tuple(words[i:i + w]) for i in range(n - w + 1)).values())), 0) if n < 1000 else None
        windows, repeated = covered(words, 3), covered(words, rules.repeat_words)
        failed = n < 50 or 100 * windows > 50 * n
        if longest is None:
            longest = next(r["longest_repeat"] for r in quality_rules.apply_rules(odd).where(F.col("doc_id") == doc).collect())
        kept = not failed and repeated <= rules.max_covered * n and longest <= rules.max_repeat_words
        expected[(doc, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
                  windows, repeated, longest, failed, kept)] += 1
    assert got == expected


def test_repeats_have_all_occurrences(spark):
    passage = prose(40, 15).replace("\n", " ")
    text = f"{prose(41, 20)} {passage} {prose(42, 20)} {passage} {prose(43, 5)} {passage}"
    rows = quality_rules.repeats(table(spark, [(1, text)]), 12).collect()
    words = text.split()
    whole = [r for r in rows if len(r["starts"]) == 3]
    assert len(whole) == 1
    assert {tuple(words[s:s + whole[0]["n_words"]]) for s in whole[0]["starts"]} == {tuple(passage.split())}


def test_secrets_against_plain_patterns(spark, odd):
    found = {(r["doc_id"], r["b"]) for r in secrets.scan(odd).select("doc_id", secrets.joined("base").alias("b")).collect()}
    expected = set()
    for doc, text in odd_rows():
        t = text or ""
        assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
        spans = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        expected.add((doc, ",".join("%s:%d:%d" % s for s in spans)))
    assert found == expected


def test_automaton_keeps_a_format():
    import random

    rng = random.Random(1)
    hexes = Counter(secrets.shape("a1" + "".join(rng.choice("0123456789abcdef") for _ in range(38))) for _ in range(500))
    learnt = secrets.learn(hexes)
    assert len(learnt.arcs) == 41  # every place is a state of its own: only the last may end
    assert learnt.log_likelihood("x" * 40) > -1e-6 > learnt.log_likelihood("x" * 16)
    keys = Counter(secrets.shape("S1" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(18))) for _ in range(500))
    numbers = Counter(secrets.shape("".join(rng.choice("0123456789") for _ in range(16))) for _ in range(500))
    known = secrets.learn(keys)
    formats = secrets.Formats(secrets.SecretParams(), {"access": known}, {"access": min(
        known.log_likelihood(s) / (len(s) + 1) for s in keys)}, secrets.learn(numbers))
    assert formats.accepts("SKA1B2C3D4E5F6G7H8I9") and not formats.accepts("1234567812345678")


def test_likelihoods_are_those_of_the_merged_tree():
    """Counts of a brute-force walk: what went through each state of the automaton, sample by sample."""
    import math
    import random

    rng = random.Random(3)
    samples = Counter("".join(rng.choice("ab") * rng.choice([2, 4]) + rng.choice("-.") for _ in range(rng.randint(1, 4)))
                      for _ in range(400))
    learnt = secrets.learn(samples)
    assert learnt == secrets.learn(dict(samples)) and sum(samples.values()) == 400
    through, ended, used = Counter(), Counter(), Counter()
    for sample, n in samples.items():
        state = 0
        for symbol in sample:
            through[state] += n
            used[state, symbol] += n
            state = learnt.arcs[state][symbol][0]
        through[state] += n
        ended[state] += n
    for sample in [*samples, "aa", "zz", ""]:
        state, total = 0, 0.0
        for symbol in sample:
            p = used[state, symbol] / through[state] if used[state, symbol] else learnt.unseen
            total += math.log(p)
            state = learnt.arcs[state][symbol][0] if used[state, symbol] else None
        stop = ended[state] / through[state] if state is not None else 0
        assert abs(total + math.log(max(stop, learnt.unseen)) - learnt.log_likelihood(sample)) < 1e-9


def test_rare_shapes_count_as_well(spark):
    """What a share of 1 in 20 leaves out of the states is in the counts of a brute-force walk."""
    import random

    rng = random.Random(8)
    samples = Counter({"xxxx-dd": 300, "xxxx-ddd": 200})
    samples.update("".join(rng.choice("xd-U") for _ in range(rng.randint(1, 9))) for _ in range(150))
    params = secrets.SecretParams(min_share=0.05, quantile=0.1)
    learnt, least = secrets.learn_shapes(spark.createDataFrame(list(samples.items()), "shape string, n long").repartition(4), "t-shapes", params)
    total = sum(samples.values())
    first = secrets.tally({s: n for s, n in samples.items() if n >= 0.05 * total}, params.alpha)
    targets, used, ended = first.targets(), Counter(), Counter()
    for sample, n in samples.items():
        for state, symbol in first.walk(sample, targets):
            if symbol is None:
                ended[state] += n
            else:
                used[state, symbol] += n
    assert sum(ended.values()) == total
    for state, arcs in enumerate(learnt.arcs):
        through = ended[state] + sum(n for (s, _), n in used.items() if s == state)
        assert {c: p for c, (_, p) in arcs.items()} == {c: n / through for (s, c), n in used.items() if s == state}
        assert learnt.stop[state] == ended[state] / max(1, through)
    assert all(learnt.log_likelihood(s) > len(s) * -12 for s in samples) and "U" in learnt.arcs[0]
    each = sorted((learnt.log_likelihood(s) / (len(s) + 1), n) for s, n in samples.items())
    upto = [sum(n for _, n in each[:i + 1]) for i in range(len(each))]
    assert abs(least - next(v for (v, _), at in zip(each, upto) if at > 0.1 * total)) < 1e-12
    only_rare = spark.createDataFrame([("x" * i, 1) for i in range(1, 40)], "shape string, n long")
    assert "x" in secrets.learn_shapes(only_rare, "t-shapes", params)[0].arcs[0]
    assert secrets.learn_shapes(only_rare.limit(0), "t-shapes", params) is None


def test_new_formats_are_added_and_redacted(spark):
    import random

    rng = random.Random(2)
    key = lambda: "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16))
    rows = [(i, f"{prose(i, 20)} AKIA{key()} {prose(i + 500, 5)} card {rng.randint(10 ** 15, 10 ** 16 - 1)}") for i in range(300)]
    rows.append((1000, f"plain {prose(9, 5)} ASIA{key()} end"))
    rows.append((1001, None))
    docs = table(spark, rows)
    spans = {r["doc_id"]: r["s"] for r in secrets.scan(docs).select("doc_id", secrets.joined("spans").alias("s")).collect()}
    assert spans[1000].startswith("format:") and spans[1001] == ""
    assert all("format" not in spans[i] for i in range(300))  # the card numbers stay
    out = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert out[1000]["text"].endswith("[SECRET] end") and out[1001]["text"] is None and out[1000]["key"] == 7
    assert all("AKIA" not in out[i]["text"] for i in range(300))


def test_formats_learnt_from_assignments_are_found_elsewhere(spark):
    """Recall and false spans: keys that are labelled beside their names, and others in running text."""
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda: "k_" + "".join(rng.choice(letters) for _ in range(24))
    host = lambda: f"mail{rng.randint(0, 9)}.example.com"
    rows = [(i, f"{prose(i, 20)}\npassword: {key()}\n{prose(i, 8)} see {host()} and {rng.randint(10 ** 15, 10 ** 16 - 1)}"
             f" or src/main/module{i}.py") for i in range(200)]
    loose = [(1000 + i, f"{prose(i, 15)} log in with {key()} {prose(i, 4)} {host()}") for i in range(40)]
    spans = {r["doc_id"]: r["s"] for r in secrets.scan(table(spark, rows + loose)).select(
        "doc_id", secrets.joined("spans").alias("s")).collect()}
    assert sum("format:" in spans[i] for i, _ in loose) >= 38  # a key may lack one of the three classes
    assert not any("format:" in spans[i] for i, _ in rows)  # hosts, numbers and paths stay


def test_many_spans_in_one_text_take_linear_time():
    import random
    import time

    rng = random.Random(6)
    words = []
    for i in range(60_000):
        words += ["%040x" % rng.getrandbits(160), "mail%d.example.com" % (i % 10)]
    began = time.time()
    base, tokens = secrets.base_spans(" ".join(words))
    assert len(base) == len(tokens) == 60_000 and time.time() - began < 10
    found = [("a", 0, 5, ""), ("b", 2, 30, ""), ("c", 8, 9, "")]
    assert secrets.apart([("t", 9, 12, ""), ("t", 30, 40, ""), ("t", 25, 31, "")], found) == [("t", 30, 40, "")]


def test_fingerprints_of_edited_and_next_texts(spark):
    rows = [(i, prose(i, 60)) for i in range(40)] + [(40, None), (41, ""), (None, "a b c"), (3, prose(3, 60))]
    got = fingerprints.edited_likeness(table(spark, rows).repartition(5)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    following = {}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        following.setdefault(doc, []).append((text or "", after or ""))
    assert len(got) == len(rows)
    for r in got:
        options = []
        for text, after in following[r["doc_id"]]:
            cut = len(text) // 4
            options.append(text[:len(text) - cut] + after[:cut])
        assert r["edited"] in options
    sure = [r for r in got if r["n_chars"] > 300]
    assert all(r["near_edited"] > r["near_next"] for r in sure if r["doc_id"] not in (3, 2))
    assert {r["near_edited"] for r in got if r["doc_id"] in (40, 41)} == {1.0}


def test_sketches_merge_and_keep_the_threshold(spark):
    a, b = prose(70, 400), prose(71, 900)
    row = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, both string").select(
        *(fingerprints.sketch(F.col(c)).alias(c) for c in ("a", "b", "both")),
        fingerprints.shingles(F.col("both")).alias("all")).select(
        "*", fingerprints.merged(F.col("a"), F.col("b")).alias("merged"),
        fingerprints.containment(F.col("a"), F.col("both")).alias("inside")).first()
    limit = -(1 << 63) + (1 << 64) // fingerprints.ONE_IN
    assert row["both"] == sorted({h for h in row["all"] if h < limit})
    assert len(set(row["merged"]) ^ set(row["both"])) <= fingerprints.SHINGLE_WORDS  # shingles across the seam
    assert row["inside"] == 1.0
    tiny = spark.createDataFrame([("x y",), ("",), ("x y z",)], "t string").select(fingerprints.sketch(F.col("t")).alias("s"))
    assert [len(r["s"]) for r in tiny.collect()] == [1, 0, 1]


def test_one_row_operators_on_odd_rows(spark, odd, empty, labels):
    n = len(odd_rows())
    for docs, rows in ((odd, n), (empty, 0)):
        scored = quality_model.classify(docs, labels).collect()
        assert len(scored) == rows and all(0 <= r["score"] <= 1 for r in scored)
        assert len(toxicity.classify(docs, labels).collect()) == rows
        assert len(quality_rules.apply_rules(docs).collect()) == rows
        assert len(secrets.scan(docs).collect()) == rows
        assert len(fingerprints.edited_likeness(docs).collect()) == rows
    kept = quality_model.keep_good(odd, labels)
    assert kept.columns == odd.columns


def test_held_out_rows(spark):
    import zlib

    ids = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", quality_model.held_out())
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in ids.collect())


def test_classifiers_hold_on_rows_they_have_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out")
    right = scored.where("predicted = quality").count() / scored.count()
    assert right >= 0.95


def test_isotonic_rises_and_keeps_the_mean():
    values, weights = [0.0, 0.4, 0.2, 0.9, 0.5, 1.0], [1, 2, 2, 1, 3, 1]
    rising = quality_model.isotonic(values, weights)
    assert rising == sorted(rising)
    assert abs(sum(v * w for v, w in zip(values, weights)) - sum(v * w for v, w in zip(rising, weights))) < 1e-9


def test_chain_feeds_earlier_links(spark):
    rows = [(i, prose(i, 25) + (" vileness" if i % 4 == 0 else "") + (" scornful" if i % 8 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0), int(i % 4 == 0)) for i in range(400)], "doc_id long, scorn int, toxic int")
    model = toxicity.fit(table(spark, rows), labels, ["scorn", "toxic"])
    assert len(model.links[1]) == len(model.links[0]) + 1  # one more input: the first link's probability
    p = model.probabilities([t for _, t in rows])
    assert all((x > 0.5) == (i % 8 == 0) and (y > 0.5) == (i % 4 == 0) for i, (x, y) in enumerate(p.tolist()))
    assert hashlib.sha256(repr(model.links[0]).encode()).hexdigest() == hashlib.sha256(
        repr(toxicity.fit(table(spark, rows), labels, ["scorn", "toxic"]).links[0]).encode()).hexdigest()
