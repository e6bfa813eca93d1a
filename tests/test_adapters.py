"""Sources asked through the Data Source: only asked calls are made, failures are rows, own sources fit in."""

import json
import os

import pytest
from pyspark.sql import functions as F

from admitflow.sources import adapters, captured, projections

SUMMARY = {"result": {"uids": ["5", "6"], "5": {"uid": "5", "title": "P", "pubdate": "1999 May"}}}


class Own(adapters.SourceAdapter):
    """A source of one's own: its records are the answer itself, in another source's form."""

    name, url = "OWN", "own://records"

    def parameters(self, query):
        return {"q": query, "n": self.size}

    def candidates(self, raw, keep):
        return projections.openalex(raw, keep=keep).withColumn("source_adapter", F.lit(self.name))


def answer(url, parameters, timeout):
    """Answers by query; each request is noted in a file, as workers come and go."""
    with open(os.environ["FAKE_CALLS"], "a") as f:
        f.write(json.dumps([url, parameters, timeout]) + "\n")
    query = parameters.get("search") or parameters.get("query") or parameters.get("term") or parameters.get("q")
    if "esummary" in url:
        return (503, "") if parameters["id"] == "9" else (200, json.dumps(SUMMARY if parameters["id"] == "5,6" else {"result": {"uids": []}}))
    if query == "slow":
        raise TimeoutError
    if query == "down":
        raise ConnectionError
    if query == "busy":
        return 429, ""
    if "esearch" in url:
        ids = {"some": ["5", "6"], "lost": ["7"], "late": ["9"]}.get(query, [])
        return (200, "{}") if query == "odd" else (200, "oops") if query == "bad" else (200, json.dumps({"esearchresult": {"idlist": ids}}))
    records = [{"id": f"W{query}", "display_name": query, "publication_year": 2000}] if query == "some" else []
    return 200, json.dumps(records if url.startswith("own") else {"results": records} if "openalex" in url else {"message": {"items": [{"DOI": "10.1/x"}] * len(records)}})


def get(url, parameters, timeout, path):
    os.environ["FAKE_CALLS"] = path  # workers may be older than the test
    return answer(url, parameters, timeout)


def test_calls_are_rows_and_only_named_ones_are_asked(spark, tmp_path):
    path = str(tmp_path / "calls")
    (tmp_path / "fake_calls_here.py").write_text(f"from tests.test_adapters import get as g\ndef get(u, p, t):\n    return g(u, p, t, {path!r})\n")
    spark.sparkContext.addPyFile(str(tmp_path / "fake_calls_here.py"))
    queries = ["some", "none", "slow", "down", "busy", "odd", "bad", "lost", "late", "some"]
    settings = {"PUBMED": {"size": 3, "timeout": 2.0, "extra": {"api_key": "k"}}, "OWN": {"size": 4}}
    frame = adapters.calls(spark, queries, ["OPENALEX", "CROSSREF", "PUBMED", "tests.test_adapters:Own"], "fake_calls_here:get", settings)
    few = adapters.calls(spark, ["some", "none"], ["PUBMED"], "fake_calls_here:get", settings)
    assert few.count() == few.rdd.getNumPartitions() == 2
    asked = [json.loads(line) for line in open(path)][:3]
    assert sorted(a[1].get("term", a[1].get("id")) for a in asked) == ["5,6", "none", "some"]  # two steps for the one that found ids
    assert all(a[1]["api_key"] == "k" and a[2] == 2.0 for a in asked) and {a[1].get("retmax") for a in asked} == {3, None}
    assert frame.filter("adapter = 'OPENALEX' and query in ('some', 'none', 'elsewhere')").count() == 2 and adapters.calls(spark, []).count() == 0
    kept = frame.toPandas()
    rows = [tuple(r) for r in frame.collect()]
    assert len(kept) == 36 and set(kept[kept["query"] == "slow"]["failure"]) == {"timeout"} and set(kept[kept["query"] == "down"]["failure"]) == {"connection"}

    sources = {**adapters.SOURCES, "OWN": Own()}
    capture = spark.createDataFrame(rows, adapters.CAPTURE)
    wanted = spark.createDataFrame([(i, q, a) for i, q in enumerate(sorted(set(queries))) for a in (*sources, "TNRR")], "query_id long, query string, adapter string")
    calls, found = captured.search(capture, wanted, sources=sources)
    got = {(r["query"], r["adapter"]): r["outcome"] for r in calls.collect()}
    assert {a: got["some", a] for a in (*sources, "TNRR")} == {**dict.fromkeys(sources, "HIT"), "TNRR": "NOT_CONNECTED"}
    assert {got["none", a] for a in sources} == {"NOT_FOUND"} and {got["slow", a] for a in sources} == {got["down", a] for a in sources} == {"TIMEOUT"} and {got["busy", a] for a in sources} == {"RATE_LIMITED"}
    # no list of ids, no JSON, ids without summaries, and a second step that failed
    assert [got[q, "PUBMED"] for q in ("odd", "bad", "lost", "late")] == ["PARSER_ERROR", "PARSER_ERROR", "PARSER_ERROR", "TIMEOUT"]
    assert sorted((r["source_adapter"], r["source_record_id"], r["nth"]) for r in found.collect()) == [("CROSSREF", "10.1/x", 0), ("OPENALEX", "Wsome", 0), ("OWN", "Wsome", 0), ("PUBMED", "5", 0)]


def test_a_table_of_queries_is_asked_once(spark, tmp_path):
    path = str(tmp_path / "calls")
    wanted = spark.createDataFrame([(1, "some", "OPENALEX"), (2, "some", "OPENALEX"), (3, None, "OPENALEX"), (4, "busy", "PUBMED"), (5, "x", "TNRR")], "query_id long, query string, adapter string")
    capture = adapters.record(wanted, lambda u, p, t: get(u, p, t, path))
    assert sorted((r["adapter"], r["query"], r["status"]) for r in capture.collect()) == [("OPENALEX", "some", 200), ("PUBMED", "busy", 429)]
    assert capture.count() == 2 and len(open(path).readlines()) == 2
    assert adapters.record(wanted.limit(0), lambda u, p, t: get(u, p, t, path)).count() == 0
    with pytest.raises(Exception, match="record"):
        adapters.calls(spark, [str(i) for i in range(4000)], get="x:y").count()


def test_http_errors_are_answers(monkeypatch):
    import urllib.error
    import urllib.request

    def failing(url, timeout):
        raise urllib.error.HTTPError(url, 403, "no", None, None)

    monkeypatch.setattr(urllib.request, "urlopen", failing)
    monkeypatch.setattr(urllib.error.HTTPError, "read", lambda self: b"no", raising=False)
    assert adapters.http_get("http://x", {"a": "b c"}, 1.0) == (403, "no")
    monkeypatch.setattr(urllib.request, "urlopen", lambda url, timeout: (_ for _ in ()).throw(urllib.error.URLError(TimeoutError())))
    assert adapters.call(adapters.OpenAlex(), "q", adapters.http_get)[2:5] == (None, "timeout", None)
