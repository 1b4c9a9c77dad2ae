import hashlib
import random
import re
import zlib

import numpy as np

from hybridlake.llm import periodic_runs, queries
from llm.conftest import odd_rows, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch for every period, the smallest period of each stretch."""
    best, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best[i, j + q] = min(q, best.get((i, j + q), q))
            i = j
    return sorted(((a, b, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def sequence(rng):
    kind, n = rng.randrange(7), rng.randrange(260)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:  # few words other than one
        return [rng.randrange(3) if rng.random() < .1 else 0 for _ in range(n)]
    if kind == 2:  # two small-period stretches out of step: a run for every odd period
        return ([0, 1] * rng.randrange(1, 60) + [0]) * rng.randrange(1, 4)
    if kind == 3:
        unit = [rng.randrange(50) for _ in range(rng.randrange(1, 90))]
        return [rng.randrange(50) for _ in range(rng.randrange(30))] + unit * rng.randrange(1, 4) + unit[:rng.randrange(len(unit))]
    if kind == 4:  # Fibonacci word
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b
    if kind == 5:  # no overlaps at all, and the hash of a doubling sequence
        t = [0]
        while len(t) < n:
            t = t + [1 - x for x in t]
        return t
    unit = [0] * rng.randrange(1, 80) + [rng.randrange(5) for _ in range(rng.randrange(20))]
    return unit * rng.randrange(1, 4) + unit[:rng.randrange(len(unit))]


def test_runs_are_those_of_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        docs = sorted((sequence(rng) for _ in range(rng.randrange(1, 8))), key=lambda d: -len(d))
        found = periodic_runs.runs([x for d in docs for x in d], [len(d) for d in docs])
        expected, at = [], 0
        for d in docs:
            expected += [(a + at, b + at, q) for a, b, q in brute_runs(d)]
            at += len(d)
        assert list(zip(*(part.tolist() for part in found))) == sorted(expected, key=lambda r: (r[0], r[2]))


def test_colliding_hashes_are_noticed(monkeypatch):
    words = [0, 1, 2, 3] * 20 + list(range(40))
    monkeypatch.setattr(periodic_runs, "_mixed", lambda codes, base: codes.astype(np.uint64) * np.uint64(0)
                        if base == periodic_runs.BASES[0] else codes.astype(np.uint64) * base)
    found = periodic_runs.runs(words, [len(words)])
    assert list(zip(*(part.tolist() for part in found))) == brute_runs(words)


def expected_row(doc, text):
    """The registered query's row, from the rule."""
    words = WORD.findall(text or "")
    n = len(words)
    if doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    kept = sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    if not best:
        return doc, 0, None, None, None, None, sha(""), kept
    a, b, q = best
    return doc, len(found), a, b - a, q, 1000 * (b - a) // q, sha(listed), kept


def many_rows():
    planted = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0]
    return ([r for r in odd_rows() if r[0] != 9] + [(i, prose(i, 40 + i % 90)) for i in planted]
            + [(planted[0], ""), (20, "a b " * 40 + "c\v d\x1ce f " * 9), (21, " \n" + "é " * 12)])


def test_the_query_gives_what_the_rule_says(spark, tmp_path):
    rows = many_rows()
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
                                "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected_row(*r) for r in rows), key=repr)


def test_long_texts_and_empty_tables(spark, odd, empty):
    assert periodic_runs.detect(empty).count() == 0
    unit = prose(5, 3000)
    long = table(spark, [(1, " ".join([unit] * 9)), (2, "x " * 300_000)])
    found = {r["doc_id"]: r for r in periodic_runs.detect(long).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 9 * len(unit.split()), len(unit.split()))]
    assert found[1]["kept"].split() == unit.split()
    assert [tuple(r) for r in found[2]["runs"]] == [(0, 300_000, 1)] and found[2]["kept"] == "x"
    assert {r["doc_id"]: r["n_words"] for r in periodic_runs.detect(odd).collect()}[4] == 0
