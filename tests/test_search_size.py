"""What a search and an index shuffle: texts once a pass, never pairs or postings; and odd rows in both."""

from admitflow.operators import fulltext, identity, search
from admitflow.plans import citation_queries
from admitflow.sources import merge_store, projections


def exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_pairs_are_scored_where_their_document_lies(spark):
    docs = spark.createDataFrame([(1, "a b", "b c c"), (2, "c", None), (2, "c", None), (3, None, "x")], "id long, title string, body string")
    asked = spark.createDataFrame([(7, "c b"), (8, "x x"), (9, "none")], "q long, text string")
    found = search.top_k(asked, docs, "q", "text", "id", ["title", "body"], 5)
    by = exchanges(found)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect()) == [(7, 1, 1), (7, 2, 2), (8, 1, 3)]
    assert len(by) == 2 and "(key" in by[1] and "(query_id" in by[0], by


def test_hits_are_searched_once(spark, tmp_path):
    spark.createDataFrame([(i, f"some words number {i} of a text", "src", "en", 10) for i in range(20)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "words of number 3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits = citation_queries._hits(spark, str(tmp_path))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 5 and "Join" not in plan and "Window" not in plan


def test_an_index_is_made_in_its_row(spark):
    texts = ["b a  b a", "", None, "one", "one", "é b\nc é"]
    rows = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").coalesce(1).select("text", projections.index_of_text("text").alias("index"))
    made = rows.select("text", "index", projections.text_of_index(rows["index"]).alias("again"))
    assert not exchanges(made)
    got = made.collect()
    assert [r["again"] for r in got] == texts and got[0]["index"] == {"b": [0, 3], "a": [1, 4], "": [2]}


def test_repeated_and_null_texts_stay(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (1, "c"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert citation_queries.inverted_abstract(spark, str(tmp_path)).count() == 3


def test_titles_of_works_are_joined_once(spark, monkeypatch):
    """Members meet their first one without their texts."""
    rows = [(1, "A", "1", "long title", "Lee", 2000, "10.1/a", "text"), (2, "B", "2", None, "Lee", 2000, "10.1/a", None), (3, "C", "3", "other", None, 2001, "10.1/a", None)]
    cand = spark.createDataFrame(rows, "ord long, adapter string, record_id string, title string, author string, year int, doi string, abstract string")
    seen, keep = {}, identity.skew_lookup
    monkeypatch.setattr(identity, "skew_lookup", lambda left, right, *rest: seen.setdefault(rest[0], (left, right)) and keep(left, right, *rest))
    got = identity.works(cand).first()
    assert (got["work"], got["n_members"], got["conflicts"], got["title"], got["abstract"], got["g5"], got["g3"]) == (1, 3, "title,year", "long title", "text", True, False)
    assert {r["f_title"] for r in seen["work"][1].collect()} == {""} and "abstract" not in seen["work"][0].columns


def test_a_kept_index_deals_texts_and_postings_once(spark, tmp_path, monkeypatch):
    """An upsert shuffles texts for its documents and for its blocks, no postings; a search shuffles postings by document, no pairs."""
    plans, write = {}, merge_store.Pieces.write
    dealt = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]
    monkeypatch.setattr(merge_store.Pieces, "write", lambda self, rows, entry, table, *a, **k: plans.update({table: dealt(rows)}) or write(self, rows, entry, table, *a, **k))
    index = fulltext.FullTextIndex(spark, f"{tmp_path}/i", {"id": "bigint"}, ["level", "part"], {"more": "map<string, int>"}, ["id"], buckets=2)
    rows = [(i, f"title {i}", f"words of text {i} of {i % 7}", {"n": i}) for i in range(300)]
    index.upsert(spark.createDataFrame(rows, "id long, level string, part string, more map<string, int>"))
    assert len(plans["docs"]) == 1 and len(plans["blocks"]) == 1, plans
    found = index.search(spark.createDataFrame([(1, "title 5 of 6"), (2, "words 299")], "q long, text string"), "q", "text", 3)
    by = exchanges(found)
    assert len([x for x in by if "(doc" in x]) == 1 and len([x for x in by if "(query_id" in x]) == 1 and not [x for x in by if "query_id" in x and "doc" in x], by
    want = search.top_k(spark.createDataFrame([(1, "title 5 of 6"), (2, "words 299")], "q long, text string"), index.live(), "q", "text", "id", ["level", "part"], 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and index.live().filter("more['n'] = id").count() == 300


def test_spans_without_a_rare_word_stay_closed(spark, tmp_path, monkeypatch):
    """A query of one rare and one frequent word reads the frequent one's postings where the rare one is; a large list gives the opening a part."""
    monkeypatch.setattr(fulltext, "SPAN", 4)
    index = fulltext.FullTextIndex(spark, f"{tmp_path}/i", {"id": "bigint"}, ["text"], buckets=2)
    rows = [(i, f"the {'zebra' if i % 60 == 7 else 'horse'}") for i in range(600)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index.upsert(docs)
    asked, read = spark.createDataFrame([(1, "the zebra")], "q long, text string"), {}
    got = sorted(map(tuple, index.search(asked, "q", "text", 5, read).collect()))
    assert got == sorted(map(tuple, search.top_k(asked, docs, "q", "text", "id", ["text"], 5).collect())) and [r[2] for r in got] == [7, 67, 127, 187, 247]
    assert 3 * (read["sources"] + read["read"]) < read["all"]
