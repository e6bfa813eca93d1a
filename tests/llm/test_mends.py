"""Cases that once lost rows, links or columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from admitflow.llm import exact_dedup, jaccard_join, license_scan, mixing, url_filter


def test_callers_columns_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "mine", "own", "h")], "page_id long, url string, _found string, _best string, host string")
    for most in (1000, 0):  # the trie, and the join
        row = url_filter.filter_urls(pages, max_trie_rules=most).first().asDict()
        assert (row["_found"], row["_best"], row["host"], row["rule"], row["verdict"]) == ("mine", "own", "a.net", "net/", "block")


def test_a_broken_batch_is_added_again(spark, tmp_path, monkeypatch):
    """The files of a batch are there in part, its line isn't: the batch that comes again brings all its texts."""
    docs = spark.createDataFrame([(i, f"text {i % 10}") for i in range(30)], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)

    def crash(self, lines, mode):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(exact_dedup.DigestIndex, "_mark", crash)
        with pytest.raises(KeyboardInterrupt):
            index.add(exact_dedup.digests(docs.filter("doc_id % 10 < 3")), "a/0")
    assert index.read().count() == 0 and spark.table(index.table).count() == 3
    got = exact_dedup.deduplicate(docs, index, batch="a").collect()
    assert sorted(r["doc_id"] for r in got if r["kept"]) == list(range(20, 30)) and all(r["keep_id"] is not None for r in got)
    again = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index"), batch="a").collect()
    assert sorted(map(str, again)) == sorted(map(str, got)) and index.read().count() == 10


def test_licenses_below_the_bands_are_refused(spark):
    with pytest.raises(ValueError):
        license_scan.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), least=0.05)


def test_equal_rows_are_dealt_over_buckets(spark, monkeypatch):
    docs = spark.range(7000).select(F.when(F.col("id") < 6000, 0).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 6000, "the same few words").otherwise(F.concat(F.lit("w "), "id")).alias("text"), F.lit("s").alias("source"))
    seen, keep = {}, mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, name: seen.setdefault(name, keep(df, name)))
    mixed = mixing.mix_rows(docs, bucket_rows=250, share=0.5)
    words = mixed.agg(F.sum(mixing.words_in(F.col("text")))).first()[0]
    assert abs(words - 13_000) <= 4
    sizes = [r["count"] for r in seen["mix-0"].groupBy("bucket").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400
    seen.clear()
    got = mixing.mix(docs, bucket_rows=250, share=0.5).agg(F.sum("taken"), F.count(F.lit(1))).first()
    assert abs(got[0] - 13_000) <= 4 and got[1] == 7000


def test_sets_that_meet_by_chance_are_taken_apart(spark, monkeypatch):
    """Of a cluster of unlike texts only those that may be linked are counted; no link is lost."""
    words = lambda tag, n: " ".join(f"{tag}x{i}" for i in range(n))
    rows = [(i, f"{words(f'p{i}', 30)} {words(f'own{i}', 30)} {words(f'p{i + 1}', 30)}") for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 200, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, keep = {}, jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name: seen.setdefault(name, keep(df, name)))
    monkeypatch.setattr(jaccard_join, "CROWD", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    # what chance does on large tables: all sets are one cluster by their keys
    monkeypatch.setattr(jaccard_join, "_clusters", lambda raw, n, percent, live: seen["sets"].select("node", F.lit(seen["sets"].agg(F.min("node")).first()[0]).alias("root")))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert all(got[i] == (i % 1000, 1 if i >= 1000 or i % 10 == 0 else 0) for i in got)
    assert seen["cluster-sizes"].agg(F.max("sets"), F.max("times")).first() == (2, 1)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(7)
    for n in (1, 5, 60, 700):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets = [base, np.unique(np.concatenate([base[: n - n // 12], rng.integers(0, 1 << 63, n // 12, dtype=np.uint64)])), np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))]
        root = jaccard_join.possible_roots(np.array([len(s) for s in sets]), [jaccard_join._bitmap(s) for s in sets], 80)
        assert root[1] == 0
        assert root[2] == (2 if n > 5 else root[2])


def test_keys_dealt_out_do_not_follow_the_crowds(spark, monkeypatch):
    """Keys go out for all sets that meet, so a cluster that grows crowded adds none; keys of one set alone stay in their task."""
    words = lambda tag, n: " ".join(f"{tag}x{i}" for i in range(n))
    rows = [(i, f"{words('same', 60)} {words(f'own{i}', 4)}") for i in range(12)]
    rows += [(100 + 10 * i + j, f"{words(f'p{i}', 60)} {words(f'own{i}-{j}', 4)}") for i in range(5) for j in range(2)]
    docs, keep, dealt = spark.createDataFrame(rows, "doc_id long, text string"), jaccard_join.materialise, {}
    for crowd in (1, 8):
        seen = {}
        monkeypatch.setattr(jaccard_join, "materialise", lambda df, name, seen=seen: seen.setdefault(name, keep(df, name)))
        monkeypatch.setattr(jaccard_join, "CROWD", crowd)
        got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect()}
        assert all(got[i] == ((0, 11) if i < 100 else (i // 10 * 10, 1)) for i in got)
        dealt[crowd] = seen["crowd-keys"].filter("key is not null")
        alone = dealt[crowd].groupBy("key").agg(F.countDistinct("node").alias("n")).filter("n = 1").count()
        assert alone <= dealt[crowd].count() // 50
    assert dealt[1].count() == dealt[8].count() > 0
