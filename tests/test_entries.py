"""The whole entries over hand-made answers: where each query's work, or its miss, ends up."""

import json

import pytest
from pyspark.sql import functions as F

from admitflow.plans import entries
from admitflow.sources import adapters

CLAIM = "screen time increases anxiety among students"


def _openalex(*works):
    index = lambda text: {w: [i for i, x in enumerate(text.split()) if x == w] for w in text.split()}
    return json.dumps({"results": [{"id": i, "doi": f"https://doi.org/{d}", "publication_year": 2001, "title": t, "authorships": [{"author": {"display_name": "Ann Lee"}}], "abstract_inverted_index": index(p)} for i, d, t, p in works]})


def _capture(spark):
    rows = [
        ("OPENALEX", "10.5555/one", 200, None, _openalex(("W1", "10.5555/one", "Screens", f"We found that {CLAIM}."), ("W2", "10.5555/other", "Other things", "Nothing."))),
        ("CROSSREF", "10.5555/one", 200, None, json.dumps({"message": {"items": [{"DOI": "10.5555/ONE", "title": ["screens."], "author": [{"given": "Ann", "family": "Lee"}], "issued": {"date-parts": [[2001]]}}]}})),
        ("OPENALEX", "busy", 429, None, None), ("CROSSREF", "busy", 200, None, '{"message": {"items": []}}'),
        ("OPENALEX", "none", 200, None, '{"results": []}'), ("CROSSREF", "none", 200, None, '{"message": {"items": []}}'),
        ("OPENALEX", "screens anxiety", 200, None, _openalex(("W1", "10.5555/one", "Screens", f"We found that {CLAIM}."))),
        ("CROSSREF", "screens anxiety", None, "timeout", None),
    ]
    return spark.createDataFrame([(*r, 0.0) for r in rows], adapters.CAPTURE)


def test_citations_from_search_to_decision(spark):
    big = 1 << 60  # ids of any size keep their hits apart
    claims = spark.createDataFrame([(big, CLAIM, "10.5555/one"), (big + 1, CLAIM, "busy"), (big + 2, CLAIM, "none"), (big + 3, CLAIM, None), (5, "quite another claim about rice fields", "10.5555/one")], "query_id long, context string, citation string")
    answer = entries.resolve(claims, entries.Sources(_capture(spark)), ["OPENALEX", "CROSSREF"])
    works = {(r["query_id"], r["source_id"]): (r["n_members"], r["state"], r["decision"], r["bucket"]) for r in answer.works.collect()}
    assert works[big, "OPENALEX:W1"] == (2, "VERIFIED", "ADMIT", "verified")  # a DOI in other letters and a title in other forms merge
    assert works[big, "OPENALEX:W2"][1:] == ("REJECTED", "REJECT", "rejected") and works[5, "OPENALEX:W1"][2:] == ("HOLD", "held") and len(works) == 4
    missed = {r["query_id"]: (r["bucket"], [tuple(a) for a in r["by_adapter"]]) for r in answer.missed.collect()}
    assert missed == {big + 1: ("adapter_error", [("CROSSREF", "NOT_FOUND"), ("OPENALEX", "RATE_LIMITED")]), big + 2: ("not_found", [("CROSSREF", "NOT_FOUND"), ("OPENALEX", "NOT_FOUND")]),
                      big + 3: ("adapter_error", [("CROSSREF", "TIMEOUT"), ("OPENALEX", "TIMEOUT")])}
    forced = spark.createDataFrame([("OPENALEX", "10.5555/one", "ACCESS_DENIED"), ("CROSSREF", "10.5555/one", "TIMEOUT")], "adapter string, query string, state string")
    lost = entries.resolve(claims, entries.Sources(_capture(spark), forced), ["OPENALEX", "CROSSREF"])
    assert lost.works.count() == 0 and {r["bucket"] for r in lost.missed.filter("query_id = 5").collect()} == {"adapter_error"}
    with pytest.raises(Exception, match="a claim is needed"):
        entries.resolve(claims.withColumn("context", F.lit(" ")), entries.Sources(_capture(spark)), ["OPENALEX"])


def test_routes_name_the_adapters(spark):
    queries = spark.createDataFrame([(1, "q", "hospital patients"), (2, "q", "rice"), (3, "q", None)], "query_id long, query string, context string")
    found = {r["query_id"]: r["a"] for r in entries.routed(queries).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("priority", "adapter")))["adapter"].alias("a")).collect()}
    assert found[1] == ["PUBMED", "OPENALEX", "CROSSREF"] and found[2] == found[3] == ["THAIJO", "OPENALEX", "CROSSREF"]


def test_discovery_merges_over_the_family_and_decides_nothing(spark):
    topics = spark.createDataFrame([(1, "screens anxiety students"), (2, "none")], "query_id long, context string")
    planned = spark.createDataFrame([(1, "support", "screens anxiety", 1), (1, "challenge", "10.5555/one", 1), (1, "challenge", "busy", 2), (1, "challenge", "screens anxiety", 3)], "query_id long, side string, query string, rank int")
    answer = entries.discover(topics, planned, entries.Sources(_capture(spark)), ["OPENALEX", "CROSSREF"])
    works = {(r["query_id"], r["record_id"]): (r["n_members"], r["origin"], r["found"]) for r in answer.works.collect()}
    assert works == {(1, "W1"): (3, "10.5555/one; screens anxiety", True), (1, "W2"): (1, "10.5555/one", False)}
    assert not {"decision", "bucket"} & set(answer.works.columns)
    assert {(r["query_id"], r["query"], r["bucket"]) for r in answer.missed.collect()} == {(1, "busy", "adapter_error"), (2, "none", "not_found")}
