"""The citation entries against plain Python on small tables, and rules against rows labelled by hand."""

import itertools
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from admitflow.functions import vocab as V
from admitflow.operators import identity, verification
from admitflow.plans import citations
from admitflow.sources import captured, serialise

CAND = "query_id long, ord long, adapter string, record_id string, title string, authors array<string>, year int, doi string, pmid string, issn string, url string, abstract string, raw_metadata string, query string"
ROWS = [
    (1, 1, "OPENALEX", "W1", "Governing the Commons", ["Elinor Ostrom"], 1990, "10.1017/cbo9780511807763", None, None, "u", "We found that commons rules increase cooperation in villages.", None, "q2"),
    (1, 2, "CROSSREF", "C1", "Governing the commons.", ["Elinor Ostrom"], 1990, "https://doi.org/10.1017/CBO9780511807763", None, None, None, None, "{}", "q1"),
    (1, 3, "PUBMED", "77", "Fishing rules in villages", ["Lee A"], 2001, None, "77", None, "u", None, None, "q1"),
    (2, 4, "OPENALEX", "W1", "Governing the Commons", ["Elinor Ostrom"], 1990, "10.1017/cbo9780511807763", None, None, "u", None, "{}", "q"),
    (2, 5, "CROSSREF", "C1", "Governing the Commons", ["E. Ostrom"], 1991, "10.1017/cbo9780511807763", None, None, None, None, None, "q"),
    (3, 6, "THAIJO", "T1", "ﬁnance", None, None, None, None, None, None, None, None, "q"),
]


def hits(spark):
    return spark.createDataFrame(ROWS, CAND)


def test_identifiers_are_embedded_at_boundaries_only(spark):
    rows = [("10.1234/abcd", "10.1234/abcd", True), ("10.1234/abcd2", "10.1234/abcd", False), ("see 10.1234/abcd, p. 2", "10.1234/abcd", True), ("x10.1234/abcd", "10.1234/abcd", False),
            ("10.1234/abcd2 10.1234/abcd", "10.1234/abcd", False), ("a 123 b", "123", False), ("123", "123", True), ("", "", False), ("ก10.1234/abcd", "10.1234/abcd", False)]
    frame = spark.createDataFrame(rows, "q string, i string, want boolean")
    assert all(r["got"] == r["want"] for r in frame.select("want", verification.embeds_identifier(F.col("q"), F.col("i")).alias("got")).collect())


def test_identity_gate_is_the_rule_in_plain_python(spark):
    titles = ["Governing the Commons", "The Evolution of Institutions for Collective Action", "Commons", "Rules games and common pool resources", None, ""]
    queries = ["Governing the commons, Ostrom 1990", "governing commons", "Evolution of institutional collective actions", "a b c", "", "common pool resource games rules", "sleep in commons", "77", None]
    pairs = list(enumerate(itertools.product(titles, queries, [["Elinor Ostrom"], ["Lee, Ann"], None])))
    rows = [(i, t, q, a, "77") for i, (t, q, a) in pairs]
    frame = spark.createDataFrame(rows, "i int, title string, citation string, authors array<string>, record_id string").select("*", *[F.lit(None).cast("string").alias(f"p_{c}") for c in identity.IDENTIFIERS])
    got = {r["i"]: r["g6"] for r in verification.with_identity(frame, "citation").collect()}

    def keywords(text):
        import re

        return {k for k in re.findall("[a-z0-9]+", (text or "").lower()) if len(k) > 2 and k not in V.GATE_STOPWORDS}

    for i, (title, query, authors) in pairs:
        q, t = keywords(query), keywords(title)
        shared = q & t
        ratio = len(shared) / min(len(q), len(t)) if q and t else 0.0
        surnames = [a.split(",")[0].lower() if "," in a else a.split()[-1].lower() for a in authors or []]
        author = any(len(s) > 2 and s in (query or "").lower() for s in surnames)
        seq = SequenceMatcher(None, " ".join(sorted(q)), " ".join(sorted(t))).ratio()
        want = bool((query or "").strip()) and (query == "77" or ((len(shared) >= 2 or author) and (ratio >= 0.5 or seq >= 0.55 or (author and len(shared) >= 1))))
        assert got[i] == want, (title, query, authors)


def test_works_merge_by_any_identifier_and_compare_with_the_first(spark):
    chain = [(1, 1, "A", "1", "t", ["x"], 2000, "10.1/a", "5", None, None, None, None, "q"), (1, 2, "B", "2", "t", ["x"], 2000, "10.1/a", None, None, None, None, "{}", "q"), (1, 3, "C", "3", "t", ["x"], 2000, None, "pmid:5", None, None, None, None, "q"),
             (1, 4, "D", "4", "t", ["x"], 2000, "10.1/b", None, None, None, None, None, "q"), (1, 5, "E", "5", "t", ["x"], 2000, "10.1/b", "6", None, None, None, None, "q"), (1, 6, "F", "6", "t", ["x"], 2000, None, "6", None, None, None, None, "q")]
    frame = spark.createDataFrame(chain, CAND).withColumn("arxiv_id", F.when(F.col("ord") >= 6, "arXiv:9"))
    got = {r["work"]: r for r in identity.works(frame).collect()}
    assert set(got) == {1, 4} and got[1]["n_members"] == got[4]["n_members"] == 3
    assert got[1]["g2"] and got[1]["g5"] and not got[4]["g2"] and not got[4]["g5"]  # 6 is tied to 4 by 5 only
    assert got[4]["pmid"] == "6" and got[4]["arxiv_id"] == "arXiv:9" and got[4]["state"] == "IDENTIFIED"
    ligature = spark.createDataFrame([(1, "ﬁnance A", "1-1", 2000, ["z"], "A", "1"), (2, "Finance a", "1-1", 2000, ["z"], "B", "2")], "ord long, title string, issn string, year int, authors array<string>, adapter string, record_id string")
    assert [r["n_members"] for r in identity.works(ligature).collect()] == [2]


def test_citations_are_verified_per_query(spark):
    queries = spark.createDataFrame([(1, "commons rules increase cooperation", "doi:10.1017/cbo9780511807763"), (2, "x", "Governing the Commons"), (3, "y", "finance"), (4, "z", "nothing")], "query_id long, context string, citation string")
    uses = {(r["query_id"], r["work"]): r for r in citations.resolve_citations(queries, hits(spark)).collect()}
    first = uses[1, 1]
    assert (first["state"], first["matched_field"], first["relation"], first["statement_type"], first["decision"], first["bucket"]) == ("VERIFIED", "doi", "SUPPORTS", "RESULT", "ADMIT", "verified")
    assert uses[1, 3]["state"] == "REJECTED" and "G6_identity_match" in uses[1, 3]["reason"] and uses[1, 3]["bucket"] == "rejected"
    assert uses[2, 4]["state"] == "CONFLICT" and uses[2, 4]["decision"] == "HOLD" and uses[2, 4]["reason"] == "METADATA_CONFLICT on field(s): year, authors"
    assert not uses[3, 6]["g3"] and all(r["decision"] == "ADMIT" for r in uses.values() if r["bucket"] == "verified")
    calls = spark.createDataFrame([(4, "OPENALEX", "TIMEOUT"), (4, "PUBMED", "NOT_FOUND")], "query_id long, adapter string, outcome string")
    assert [tuple(r) for r in citations.misses(queries, hits(spark), calls).collect()] == [(4, "adapter_error")]
    replaced = citations.resolve_citations(queries, hits(spark), relation=lambda claim, passage: F.lit("CHALLENGES"))
    assert {r["relation"] for r in replaced.collect()} == {"CHALLENGES"}


def test_discovery_knows_no_decision(spark):
    topics = spark.createDataFrame([(1, "cooperation and commons"), (2, "unrelated topic words"), (3, " ")], "query_id long, context string")
    found = citations.discover_citations(topics, hits(spark))
    assert "decision" not in found.columns
    got = {(r["query_id"], r["work"]): (r["found"], r["origin"]) for r in found.collect()}
    assert got == {(1, 1): (True, "q1; q2"), (1, 3): (False, "q1"), (2, 4): (False, "q"), (3, 6): (False, "q")}
    assert [r["work"] for r in citations.first_results(found, 1).collect()] == [1]


def test_resolve_source_prefers_identifiers(spark):
    hints = spark.createDataFrame([(1, None, None, "Governing the commons Ostrom", None, None), (2, "10.1017/cbo9780511807763", None, None, None, None), (3, "10.9/none", None, "finance", None, None)], "query_id long, doi string, pmid string, title string, author string, search_terms string")
    got = {r["query_id"]: (r["status"], r["source_id"]) for r in citations.resolve_source(hints, hits(spark)).collect()}
    assert got == {1: ("SOURCE_CONFIRMED", "OPENALEX:W1"), 2: ("UNRESOLVED", None), 3: ("UNRESOLVED", None)}
    cites = spark.createDataFrame([(1, "commons rules increase cooperation", "https://doi.org/10.1017/CBO9780511807763"), (2, " ", "x"), (3, "y", "nope")], "query_id long, context string, citation string")
    told = {r["query_id"]: (r["status"], r["decision"]) for r in citations.verify_cite(cites, hits(spark)).collect()}
    assert told == {1: ("CHECKED", "ADMIT"), 2: ("ERROR", None), 3: ("NOT_FOUND", None)}


def test_query_families_are_ordered_sets(spark):
    planned = spark.createDataFrame([(1, "support", "a", 1), (1, "support", "b", 2), (1, "challenge", "a", 1), (1, "challenge", "c", 2)], "query_id long, side string, query string, rank int")
    extra = spark.createDataFrame([(1, "c", 1), (1, "d", 2)], "query_id long, query string, rank int")
    got = citations.query_family(planned, extra).orderBy("nth").collect()
    assert [(r["nth"], r["query"]) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_captured_searches(spark):
    works = '{"results": [{"id": "W9", "display_name": "T", "publication_year": 2000}, {"display_name": "no id"}]}'
    summary = '{"result": {"uids": ["5"], "5": {"uid": "5", "title": "P", "pubdate": "1999 May"}}}'
    capture = spark.createDataFrame(
        [("OPENALEX", "a", 200, None, works), ("CROSSREF", "a", 429, None, None), ("PUBMED", "a", 200, None, summary), ("OPENALEX", "b", 200, None, "oops"), ("CROSSREF", "b", 200, None, '{"message": {"items": []}}'), ("PUBMED", "b", None, "timeout", None),
         ("OPENALEX", "c", 200, None, '{"results": [{"title": "x"}]}'), ("CROSSREF", "c", 200, None, '{"other": 1}')], "adapter string, query string, status int, failure string, body string")
    wanted = spark.createDataFrame([(i, q, a) for i, q in enumerate("abc") for a in ("OPENALEX", "CROSSREF", "PUBMED")], "query_id long, query string, adapter string")
    calls, candidates = captured.search(capture, wanted, spark.createDataFrame([("PUBMED", "a", "ACCESS_DENIED")], "adapter string, query string, state string"))
    got = {(r["query"], r["adapter"]): r["outcome"] for r in calls.collect()}
    assert got == {("a", "OPENALEX"): "HIT", ("a", "CROSSREF"): "RATE_LIMITED", ("a", "PUBMED"): "ACCESS_DENIED", ("b", "OPENALEX"): "PARSER_ERROR", ("b", "CROSSREF"): "NOT_FOUND", ("b", "PUBMED"): "TIMEOUT",
                   ("c", "OPENALEX"): "PARSER_ERROR", ("c", "CROSSREF"): "PARSER_ERROR", ("c", "PUBMED"): "TIMEOUT"}
    assert [(r["query"], r["source_record_id"]) for r in candidates.collect()] == [("a", "W9")]
    _, plain = captured.search(capture, wanted)
    assert sorted(r["source_record_id"] for r in plain.collect()) == ["5", "W9"]
    assert captured.endpoints(spark).count() == 36
    found = spark.createDataFrame([("a", '{"esearchresult": {"idlist": ["5", "6"]}}')], "query string, body string")
    assert captured.pubmed_bodies(found, spark.createDataFrame([("5", "{}")], "uid string, raw string")).count() == 1
    queries, forced = captured.scenarios(spark.createDataFrame([("s", "ctx", ["OPENALEX"], ['plain', '{"text": "x", "inject_error": "TIMEOUT"}'])], "name string, context string, adapters array<string>, queries array<string>"))
    assert [r["query"] for r in queries.orderBy("nth").collect()] == ["plain", "x"] and [tuple(r) for r in forced.collect()] == [("s", "OPENALEX", "x", "TIMEOUT")]


def test_serialisers_and_contracts(spark):
    rows = identity.whole(hits(spark)).withColumn("tags", F.when(F.col("ord") == 1, F.array(F.lit("A"), F.lit("B"))))
    got = {r["ord"]: r["line"] for r in rows.select("ord", serialise.citation_line("tags").alias("line")).collect()}
    assert got[1] == "Elinor Ostrom (1990). Governing the Commons. doi:10.1017/cbo9780511807763 [A/B]"
    assert got[6] == "(no author listed) (n.d.). ﬁnance. THAIJO:T1" and got[3].endswith(". pmid:77")
    line = spark.createDataFrame([("TNRR", "NOT_CONNECTED", None)], "source string, status string, reason string").select(serialise.coverage_line().alias("x")).first()[0]
    assert line == "  TNRR                 NOT_CONNECTED"
    assert serialise.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first()[0] == '{"a":1,"b":null}'
    contracts = spark.createDataFrame([("VERIFY", "c", "SUPPORTS"), ("VERIFY", " ", "SUPPORTS"), ("VERIFY", "c", "MAYBE"), ("DISCOVER", None, None), ("X", "c", "SUPPORTS")], "mode string, claim string, intended_relation string")
    assert verification.check_contract(contracts, strict=False).count() == 2
