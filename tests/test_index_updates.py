"""Updates that are written into an index: whole results, touched buckets only, replays."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from hybridlake.operators import maintenance
from hybridlake.operators.index import build_index, embed_records, open_index
from hybridlake.operators.keyword import keyword_search
from hybridlake.operators.maintenance import apply_update, index_one, update_index
from hybridlake.operators.table import upsert
from hybridlake.params import EmbedParams, SearchParams
from hybridlake.session import scratch_path
from hybridlake.streaming.ingest import ingest_into_index

DIM = 8
EMBED = EmbedParams(dim=DIM)
SCHEMA = "chunk_id string, text string, document_name string, v long"


def records(spark, rows):
    return embed_records(spark.createDataFrame(rows, SCHEMA), EMBED)


def built(spark, rows):
    return build_index(records(spark, [(i, t, "d", 0) for i, t in rows]).drop("v"), dim=DIM, embed=EMBED,
                       materialize_to=scratch_path(spark, "t-update"))


def state(index):
    """Everything a search reads, as plain values."""
    stats = index.corpus_stats.first()
    return (sorted((r.chunk_id, r.text, tuple(r.terms), tuple(r.embedding)) for r in index.records.select(
                "chunk_id", "text", "terms", "embedding").collect()),
            sorted(map(tuple, index.postings.select("term", "chunk_id", "tf", "dl").collect())),
            sorted((r.term, r.df) for r in index.term_stats.select("term", "df").collect()),
            (stats.n_docs, round(stats.avgdl, 9)))


BASE = [(f"c{i}", f"word{i} shared text number{i % 7}") for i in range(40)]


def test_an_update_leaves_what_a_build_of_the_final_records_gives(spark):
    index = built(spark, BASE)
    batch = [("c3", "first version", "d", 1), ("c3", "second version wins", "d", 2), ("new", "word1 brand new", "d", 1),
             ("c5", "again shared", "d", 1), (None, "no id", "d", 9), ("notext", None, "d", 9)]
    short = records(spark, [("short", "short vector", "d", 3)]).withColumn("embedding", F.slice("embedding", 1, 2))
    gone = spark.createDataFrame([("c7",), ("c3",), ("unknown",), (None,)], "chunk_id string")
    expected = state(built(spark, [r for r in BASE if r[0] not in ("c3", "c5", "c7")] + [
        ("c3", "second version wins"), ("new", "word1 brand new"), ("c5", "again shared")]))
    lazy = update_index(index, records(spark, batch).unionByName(short), gone, seq_col="v")
    assert state(lazy) == expected
    changed, rejected = apply_update(index, records(spark, batch).unionByName(short), gone, seq_col="v")
    assert state(changed) == expected
    assert sorted((r.chunk_id or "", r.reason) for r in rejected.collect()) == [
        ("", "missing_id"), ("notext", "missing_text"), ("short", "bad_dimension")]
    again, _ = apply_update(changed, records(spark, batch), gone, seq_col="v")  # a replay changes nothing
    assert state(again) == expected == state(open_index(spark, index.root, EMBED))
    queries = spark.createDataFrame([(1, "second version"), (2, "word3"), (3, "shared"), (4, "first")], "qid long, query_text string")
    for method in ("blocks", "join", "scan"):
        found = keyword_search(again, queries, SearchParams(top_k=3), method=method).collect()
        assert {r.chunk_id for r in found if r.qid == 1} == {"c3"} and not [r for r in found if r.qid in (2, 4)], method
        assert len([r for r in found if r.qid == 3]) == 3


def test_deleting_all_empties_the_index(spark):
    index = built(spark, BASE[:5])
    changed, _ = apply_update(index, deleted=index.records.select("chunk_id"))
    assert state(changed) == ([], [], [], (0, 0.0))
    changed, _ = apply_update(changed, records(spark, [("c1", "back again", "d", 1)]))
    assert state(changed) == state(built(spark, [("c1", "back again")]))


def test_rows_of_one_id_need_an_order(spark):
    index = built(spark, BASE[:3])
    twice = records(spark, [("c1", "a", "d", 1), ("c1", "b", "d", 2)])
    for update in (update_index, apply_update):
        with pytest.raises(ValueError):
            update(index, twice)
    with pytest.raises(ValueError):
        apply_update(update_index(index, records(spark, [("c1", "a", "d", 1)])), deleted=index.records.select("chunk_id"))


def files(root, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/{name}")
            for f in names if f.startswith("part-")}


def test_only_touched_buckets_are_read_and_rewritten(spark):
    index = built(spark, BASE)
    root = re.sub("^file:/*", "/", index.root)
    before = {name: files(root, name) for name in ("records", "blocks", "term_stats")}
    apply_update(index, records(spark, [("c3", "one", "d", 1)]))
    touched = {}
    for name, old in before.items():
        new = files(root, name)
        same = {f for f in old if new.get(f) == old[f]}
        touched[name] = {re.search(r"bucket=(\d+)", f).group(1) for f in (old.keys() | new.keys()) - same}
        assert same, name  # the other buckets' files are the same ones
    assert len(touched["records"]) == 1
    # the terms of the old text and of the new one
    assert len(touched["blocks"]) <= 6 and touched["blocks"] == touched["term_stats"]


def test_one_record_is_searchable_at_once(spark):
    index = index_one(built(spark, BASE), {"chunk_id": "x", "document_name": "d", "text": "unheard of"})
    queries = spark.createDataFrame([(1, "unheard")], "qid long, query_text string")
    assert [r.chunk_id for r in keyword_search(index, queries).collect()] == ["x"]
    assert index.records.where("chunk_id = 'x'").first()["embedding"] is not None
    with pytest.raises(ValueError):
        index_one(index, {"chunk_id": "y", "document_name": "d", "text": None})


def test_streams_into_an_index_and_their_replays(spark):
    index, root = built(spark, BASE), scratch_path(spark, "t-stream")
    embed = lambda df: embed_records(df, EMBED)
    schema = spark.createDataFrame([], SCHEMA).schema
    for n, rows in enumerate([[("c1", "one", "d", 1), ("c2", "two", "d", 1)], [("c2", "two again", "d", 2), ("s", "three", "d", 2)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/in/drop={n}")
        index = ingest_into_index(index, f"{root}/in/drop=*", schema, f"{root}/checkpoint", embed)
    final = dict(BASE) | {"c1": "one", "c2": "two again", "s": "three"}
    assert state(index) == state(built(spark, list(final.items())))
    # the checkpoint is lost: all files arrive once more, in their order
    index = ingest_into_index(index, f"{root}/in/drop=*", schema, f"{root}/checkpoint-2", embed)
    assert state(index) == state(built(spark, list(final.items())))


def test_upserts_leave_rows_without_an_id_out(spark):
    table = spark.createDataFrame([("a", "1")], "chunk_id string, text string")
    batch = spark.createDataFrame([(None, "x"), ("b", "2")], "chunk_id string, text string")
    once = upsert(table, batch, 1, seq_col="text")
    assert sorted(r.chunk_id for r in upsert(once, batch, 1, seq_col="text").collect()) == ["a", "b"]


def many(spark, n, parts=4):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(f"c{i:04d}", " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(300)], k=rng.randint(3, 40)))) for i in range(n)]
    return rows + [("empty", "")]


def test_rows_that_stay_are_not_dealt_out(spark, monkeypatch):
    """Records and blocks in files of some size lie as they are; the batch's rows alone are dealt out, and whole
    blocks are cut again of what stays of a term."""
    monkeypatch.setattr(maintenance, "LIE_BYTES", 1)
    rows = many(spark, 400)
    index = built(spark, rows)
    dealt = []
    hint = type(index.records).hint
    monkeypatch.setattr(type(index.records), "hint", lambda self, *a: dealt.append(self) or hint(self, *a))
    gone = index.records.where("chunk_id >= 'c0100' and chunk_id < 'c0300'").select("chunk_id")
    index, _ = apply_update(index, deleted=gone)
    assert len(dealt) == 1 and dealt[0].columns == ["term", "term_bucket", "df"]  # statistics only
    left = [r for r in rows if not "c0100" <= r[0] < "c0300"]
    assert state(index) == state(built(spark, left))
    dealt.clear()
    batch = [("c0001", "w1 fresh words", "d", 1), ("c0001", "w1 w2 fresh again", "d", 2), ("new", "w1 w1 w3", "d", 1), ("c0350", "", "d", 1)]
    index, _ = apply_update(index, records(spark, batch), seq_col="v")
    assert len(dealt) == 3  # the batch's records and postings, and the statistics
    final = dict(left) | {"c0001": "w1 w2 fresh again", "new": "w1 w1 w3", "c0350": ""}
    expected = state(built(spark, list(final.items())))
    assert state(index) == expected
    blocks = index.blocks.where("term = 'w0'").select("n", "ids", "tfs", "dls", "max_tf", "min_dl").collect()
    assert all(b.n == len(b.ids) <= 128 and b.max_tf == max(b.tfs) and b.min_dl == min(b.dls) for b in blocks)
    again, _ = apply_update(index, records(spark, batch), seq_col="v")
    assert state(again) == expected
    queries = spark.createDataFrame([(1, "fresh w2"), (2, "w0 w1")], "qid long, query_text string")
    rows_of = lambda df: sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    hits = [rows_of(keyword_search(again, queries, SearchParams(top_k=5), method=m)) for m in ("blocks", "join", "scan")]
    assert hits[0] == hits[1] == hits[2] and hits[0]


def test_many_updates_leave_few_files(spark):
    """Small files are dealt out together by the next update, so their number follows the buckets, not the updates."""
    index = built(spark, BASE)
    root = re.sub("^file:/*", "/", index.root)
    for v in range(4):
        index, _ = apply_update(index, records(spark, [(f"c{i}", f"word{i} shared version{v}", "d", v) for i in range(0, 40, 3)]))
    assert all(len(files(root, name)) <= 16 for name in ("records", "blocks", "term_stats"))
    assert not [d for d in os.listdir(root) if d.startswith("_update")]


def test_a_batch_of_single_ids_is_written_once(spark, monkeypatch):
    index = built(spark, BASE)
    latest = []
    monkeypatch.setattr(maintenance, "latest_by_id", lambda *a, f=maintenance.latest_by_id: latest.append(a) or f(*a))
    rows = [("c1", "one", "d", 1), ("c2", "two", "d", 2), (None, "no id", "d", 1), (None, "no id either", "d", 2)]
    changed, rejected = apply_update(index, records(spark, rows), seq_col="v")
    assert not latest and sorted(r.text for r in rejected.collect()) == ["no id", "no id either"]
    expected = state(built(spark, list((dict(BASE) | {"c1": "one", "c2": "two"}).items())))
    assert state(changed) == expected
    unchanged, rejected = apply_update(changed, records(spark, rows).where("v > 2"), seq_col="v")
    assert state(unchanged) == expected and rejected.count() == 0


def test_an_update_that_stops_while_it_is_put_in_place_is_finished(spark, monkeypatch):
    index = built(spark, BASE)
    batch = [(f"c{i}", f"word{i} changed", "d", 1) for i in range(0, 40, 2)]
    expected = state(built(spark, list((dict(BASE) | {i: t for i, t, _, _ in batch}).items())))

    class Stopped(Exception):
        pass

    def half(spark, root, aside):
        path, fs = maintenance._store(spark, root)
        moves = [m for m in spark.read.parquet(f"{aside}/moves").collect() if not m.empty]
        for table, folder, _ in moves[:len(moves) // 2]:
            fs.delete(path(f"{root}/{table}/{folder}"), True)
            fs.rename(path(f"{aside}/{table}/{folder}"), path(f"{root}/{table}/{folder}"))
        fs.delete(path(f"{root}/{moves[-1].table}/{moves[-1].folder}"), True)
        raise Stopped

    with monkeypatch.context() as m:
        m.setattr(maintenance, "_put_in_place", half)
        with pytest.raises(Stopped):
            apply_update(index, records(spark, batch))
    again, _ = apply_update(open_index(spark, index.root, EMBED), records(spark, batch))
    assert state(again) == expected
