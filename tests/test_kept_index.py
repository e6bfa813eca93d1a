"""The merge store and the kept full-text index: against plain tables, with crashes, two writers, and counts of what is read."""

import os
import random

import pytest
from pyspark.sql import functions as F

from admitflow.operators import fulltext, search
from admitflow.sources import merge_store
from admitflow.sources.merge_store import MergeStore

SCHEMA = "k int, at double, v string"


def files(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names}


def rows(store):
    return sorted((tuple(r) for r in store.read().collect()), key=str)


def test_store_keeps_the_last_row_of_each_key(spark, tmp_path):
    draw, want = random.Random(4), {}
    store = MergeStore(spark, f"{tmp_path}/s", SCHEMA, ["k"], ["at"], buckets=4)
    assert rows(store) == [] and store.compact() == 0
    for batch in range(6):
        some = [(draw.choice([None, *range(12)]), float(draw.randrange(20)), f"{batch}-{i}") for i in range(8)]
        some = list({(k, at): (k, at, v) for k, at, v in some}.values())  # equal times within a batch have no order
        gone = batch == 3
        assert (store.delete if gone else store.upsert)(spark.createDataFrame(some, SCHEMA), "job", batch)
        best = {}
        for r in sorted(some, key=lambda r: r[1]):
            best[r[0]] = r
        for k, r in best.items():
            if k not in want or r[1] >= want[k][0][1]:
                want[k] = r, gone
        if batch == 4:
            touched = {b: len(e) for b, e in store.pieces.state()["pieces"]["rows"].items()}
            assert store.compact(3) == sum(n >= 3 for n in touched.values())
    assert rows(store) == sorted((r for r, gone in want.values() if not gone), key=str)
    assert store.compact(2) >= 0 and store.compact(2) == 0
    before = rows(store)
    assert store.pieces.vacuum(1) > 0 and rows(store) == before


def test_a_batch_costs_what_it_writes(spark, tmp_path, monkeypatch):
    store = MergeStore(spark, f"{tmp_path}/s", SCHEMA, ["k"], ["at"], buckets=16)
    store.upsert(spark.range(5000).selectExpr("cast(id as int) k", "0D at", "'old' v"))
    before = files(tmp_path)
    monkeypatch.setattr(merge_store.Pieces, "load", lambda *a: pytest.fail("an upsert reads no data"))
    store.upsert(spark.createDataFrame([(1, 1.0, "new")], SCHEMA))
    after = files(tmp_path)
    assert {p: t for p, t in after.items() if p in before} == before
    parts = [p for p in after if p not in before and p.endswith(".parquet")]
    assert len(parts) == 1 and os.path.getsize(parts[0]) < 5000
    monkeypatch.undo()
    assert store.read().filter("v = 'new'").count() == 1 and store.read().count() == 5000


def test_writers_don_t_hide_each_other(spark, tmp_path):
    """The batch numbers of a new writer start at 0 again: none of its rows is lost. A batch that comes again is none."""
    one = lambda k, v: spark.createDataFrame([(k, 1.0, v)], SCHEMA)
    store = MergeStore(spark, f"{tmp_path}/s", SCHEMA, ["k"], ["at"])
    assert store.upsert(one(1, "sync")) and store.upsert(one(2, "sync"))
    assert store.upsert(one(3, "stream"), "a", 0) and store.upsert(one(4, "stream"), "a", 1) and store.upsert(one(5, "other"), "b", 0)
    assert not store.upsert(one(9, "again"), "a", 1) and not store.upsert(one(9, "again"), "a", 0)
    assert [r[0] for r in rows(store)] == [1, 2, 3, 4, 5]


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """Another commit falls between a writer's look and its own: it goes on behind it, and a compaction keeps what came meanwhile."""
    store, other = (MergeStore(spark, f"{tmp_path}/s", SCHEMA, ["k"], ["at"], buckets=1) for _ in range(2))
    put, seen = merge_store.Pieces._put, []

    def late(self, state):
        if not seen:
            seen.append(1)
            other.upsert(spark.createDataFrame([(2, 1.0, "other")], SCHEMA))
        return put(self, state)

    monkeypatch.setattr(merge_store.Pieces, "_put", late)
    store.upsert(spark.createDataFrame([(1, 1.0, "one")], SCHEMA))
    assert [r[0] for r in rows(store)] == [1, 2] and store.pieces.state()["seq"] == 2
    seen.clear()
    assert store.compact(2) == 1
    assert rows(store) == [(1, 1.0, "one"), (2, 1.0, "other")]
    assert len(store.pieces.state()["pieces"]["rows"]["0"]) == 2  # the merged piece and the one that came meanwhile


@pytest.mark.parametrize("step", ["data", "draft", "rename"])
def test_crash_at_each_step(spark, tmp_path, monkeypatch, step):
    store = MergeStore(spark, f"{tmp_path}/s", SCHEMA, ["k"], ["at"])
    store.upsert(spark.createDataFrame([(1, 1.0, "kept")], SCHEMA), "w", 0)

    def crash(*a, **k):
        raise KeyboardInterrupt

    if step == "data":  # files are there, the version isn't
        monkeypatch.setattr(merge_store.Pieces, "commit", crash)
    elif step == "draft":
        monkeypatch.setattr(merge_store.Pieces, "_put", crash)
    else:
        put = merge_store.Pieces._put
        monkeypatch.setattr(merge_store.Pieces, "_put", lambda self, state: crash() if put(self, state) else False)
    with pytest.raises(KeyboardInterrupt):
        store.upsert(spark.createDataFrame([(1, 2.0, "new")], SCHEMA), "w", 1)
    monkeypatch.undo()
    done = step == "rename"  # the version is there: the batch that comes again is none
    assert rows(store) == [(1, 2.0, "new") if done else (1, 1.0, "kept")]
    assert store.upsert(spark.createDataFrame([(1, 2.0, "new")], SCHEMA), "w", 1) is not done
    assert rows(store) == [(1, 2.0, "new")]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    make = lambda: " ".join(draw.choices(words, [1 / (i + 1) for i in range(60)], k=draw.choice([0, 3, 30])))
    return [[(i, make() or None, make()) for i in range(n)] for n in (150, 60, 40)], [(q, make() + " w0 w59") for q in range(12)] + [(90, "nowhere"), (91, None), (92, "")]


def compared(spark, index, plain, asked, k=10):
    docs = spark.createDataFrame([(i, t, a) for i, (t, a) in plain.items()], "id long, title string, abstract string")
    want = [(r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in search.top_k(asked, docs, "q", "text", "id", ["title", "abstract"], k).collect()]
    read = {}
    got = [(r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in index.search(asked, "q", "text", k, read).collect()]
    assert sorted(got) == sorted(want)
    return read


def test_index_after_changes_ranks_like_a_rebuilt_one(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(fulltext, "SPAN", 4)
    batches, queries = texts
    asked = spark.createDataFrame(queries, "q long, text string")
    index = fulltext.FullTextIndex(spark, f"{tmp_path}/i", {"id": "bigint"}, ["title", "abstract"], buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string, abstract string")
    assert index.is_empty() and index.search(asked, "q", "text").count() == 0
    plain = {}
    for n, rows_ in enumerate(batches):  # the second and third replace documents of the first
        assert index.upsert(frame(rows_), "w", n) and not index.upsert(frame(rows_), "w", n)
        plain |= {i: (t, a) for i, t, a in rows_}
    index.delete(spark.range(5, 25), "w", 9)
    plain = {i: x for i, x in plain.items() if not 5 <= i < 25}
    read = compared(spark, index, plain, asked)
    assert read["sources"] + read["read"] + read["probed"] < read["all"]  # not all blocks of frequent tokens are read
    assert index.live().count() == len(plain)
    index.upsert(frame([(7, "w59 back", None)]))
    plain[7] = ("w59 back", None)
    assert index.compact(2) > 0 and index.compact(2) == 0
    compared(spark, index, plain, asked)
    compared(spark, index, plain, asked, k=1000)


def test_index_writers_that_replace_the_same_document(spark, tmp_path, monkeypatch):
    one, two = (fulltext.FullTextIndex(spark, f"{tmp_path}/i", {"id": "bigint"}, ["title"], buckets=2) for _ in range(2))
    frame = lambda text: spark.createDataFrame([(1, text)], "id long, title string")
    one.upsert(frame("first words"))
    blocks, seen = fulltext.FullTextIndex._blocks, []

    def late(self, postings):
        if not seen:
            seen.append(1)
            two.upsert(frame("other"))
        return blocks(self, postings)

    monkeypatch.setattr(fulltext.FullTextIndex, "_blocks", late)
    one.upsert(frame("last"))
    asked = spark.createDataFrame([(1, "first words other last")], "q long, text string")
    assert [r["title"] for r in one.live().collect()] == ["last"]
    assert one.search(asked, "q", "text").count() == 1 and one.pieces.state()["totals"] == {"docs": 1, "length": 1}
    assert one.live().select(F.max("length")).first()[0] == 1
