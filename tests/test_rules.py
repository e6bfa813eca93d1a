"""Golden rows of the rules, by hand (FIXTURES.md 4)."""

import difflib  # noqa: F401
import random

import pytest

from admitflow.functions import rules as R
from admitflow.functions.dialect import SPARK


def label(spark, pairs):
    rows = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(pairs)], "i int, claim string, passage string")
    toks = rows.selectExpr("i", f"{R.tokens(SPARK, 'claim')} as c", f"{R.tokens(SPARK, 'passage')} as p")
    return [r[0] for r in toks.orderBy("i").selectExpr(R.relation(SPARK, "c", "p")).collect()]


def test_relations(spark):
    pairs = [
        ("AI increases students time on task", "tutoring significantly increased students time on task"),
        ("social media use causes depression", "we found no significant association between social media use and depression"),
        ("exercise raises pressure", "exercise lowers pressure in adults"),
        ("screen time increases anxiety", "screen time increases anxiety only among adults under 30"),
        ("screen time increases anxiety", "ok"),
        ("demand rises quickly", "demand fell very quickly there"),
        ("exercise increases fitness", "fitness decreasing with less exercise"),
    ]
    assert label(spark, pairs) == ["SUPPORTS", "CHALLENGES", "CHALLENGES", "QUALIFIES", "UNCLEAR", "SUPPORTS", "CHALLENGES"]


def test_statement_types(spark):
    cases = {
        "We found that tutoring helps students": "RESULT", "This study examined whether tutoring helps": "OBJECTIVE", "We discuss the hypothesis that tutoring helps": "HYPOTHESIS",
        "It is not true that we found any effect": "BACKGROUND", "In conclusion, tutoring helps students": "CONCLUSION", "One limitation is the small sample": "LIMITATION",
        "ok": "UNKNOWN", "": "UNKNOWN", "This trial found large effects here": "RESULT", "according to Smith 2019 effects are large": "PRIOR_WORK",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want string").selectExpr("want", "lower(p) as x", f"{R.tokens(SPARK, 'p')} as t")
    assert all(r[0] == r[1] for r in rows.selectExpr("want", R.statement_type(SPARK, "x")).collect())


def test_domains(spark):
    cases = {"quantum": "GENERAL", "farmers in thailand": "THAI", "cancer treatment": "HEALTH", "hospital in bangkok": "THAI_HEALTH", "กฎหมายอิสลาม": "THAI", "วัคซีนสุขภาพ": "THAI_HEALTH"}
    rows = spark.createDataFrame(list(cases.items()), "x string, want string")
    assert all(r[0] == r[1] for r in rows.selectExpr("want", R.domain(SPARK, "x")).collect())


@pytest.mark.parametrize("word,base", [("decreased", "decrease"), ("decreasing", "decrease"), ("protects", "protect"), ("losses", "loss")])
def test_inflections(word, base):
    assert word in R.surface_forms([base])


def test_components_against_union_find(spark):
    from admitflow.plans.components import connected_components

    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(0, 0), (None, 1)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {i: i for e in edges if None not in e and e[0] != e[1] for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}


def test_projections(spark):
    from admitflow.sources import projections as P

    one = lambda text: spark.createDataFrame([(text,)], "raw string")
    r = P.openalex(one('{"id":"W1","title":"T","doi":"https://doi.org/10.1/x","publication_year":2017,"abstract_inverted_index":{"b":[1],"a":[0,2]}}')).first()
    assert (r["doi"], r["abstract"], r["year"], r["url"]) == ("10.1/x", "a b a", 2017, "W1")
    r = P.crossref(one('{"DOI":"10.2/y","title":["Q"],"author":[{"given":"A","family":"B"}],"issued":{"date-parts":[[2019,1]]},"ISSN":["1"]}')).first()
    assert (r["authors"], r["year"], r["issn"]) == (["A B"], 2019, "1")
    r = P.pubmed(one('{"uid":"5","title":"Z","authors":[{"name":"S J"}],"articleids":[{"idtype":"doi","value":"10.3/z"}],"pubdate":"2019 Jan","essn":"9"}')).first()
    assert (r["doi"], r["year"], r["issn"], r["abstract"]) == ("10.3/z", 2019, "9", None)
    r = P.dublin_core(one('{"identifier":"oai:1","titles":["T"],"dates":["x","2020-01"],"identifiers":["http://a/1","https://doi.org/10.4/w"]}')).first()
    assert (r["doi"], r["url"], r["year"]) == ("10.4/w", "http://a/1", 2020)
    assert P.openalex(one('{"title":"no id"}')).count() == 0
    page = "<OAI-PMH><ListRecords><record><header><identifier>a</identifier></header><metadata><dc><title>One</title><title>Eins</title></dc></metadata></record></ListRecords><resumptionToken>t2</resumptionToken></OAI-PMH>"
    r = P.oai_records(spark.createDataFrame([(page,)], "xml string")).first()
    assert (r["identifier"], r["titles"], r["token"]) == ("a", ["One", "Eins"], "t2")


def run_query(spark, folder, name, **tables):
    from admitflow.plans import queries as Q

    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return [tuple(r) for r in Q.QUERIES[name](spark, str(folder)).collect()]


def test_statement_type_reads_whole_texts(spark, tmp_path):
    filler = "plain words stand here and say little" + " of any weight" * 40
    texts = [filler, filler + ". In summary, this holds", filler + " whether. our study found more", filler + " whether the study found it", filler + " if it was so. we used rats"]
    got = {(i, cue): kind for i, cue, kind in run_query(spark, tmp_path, "statement_type", documents=(list(enumerate(texts)), "doc_id long, text string"))}
    assert [got[i, "increases"] for i in range(5)] == ["BACKGROUND", "CONCLUSION", "RESULT", "BACKGROUND", "METHOD"]


def test_found_pattern_against_brute_force(spark):
    import re

    from admitflow.functions import vocab as V

    draw = random.Random(8)
    bits = ["this study found", "our  trial found", "the paper", "found", "whether", ".", "!", "?", "we", "\n", "\x01", " if ", "never found"]
    texts = [" ".join(draw.choices(bits, k=draw.randrange(14))) for _ in range(400)]
    want = [[f.group(0).replace("\x01", "\x02") for f in re.finditer("[^.!?]*?" + V.FOUND_PATTERN, t)] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").selectExpr(R._found_by_splitting(SPARK, "x"))
    assert [r[0] for r in rows.collect()] == want


def test_calls_count_every_event(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string"
    events = [(0, 1, "view"), (4, 1, "error"), (3, 1, "view"), (7, 1, "click"), (1, 2, "signup")]
    got = {(u, source): status for u, source, status in run_query(spark, tmp_path, "coverage_fold", events=(events, schema))}
    assert [got[1, a] for a in ("OPENALEX", "CROSSREF", "PUBMED", "THAIJO", "THAIJO:so01", "TNRR")] == ["UNAVAILABLE", "PLANNED", "PLANNED", "STALE", "STALE", "NOT_CONNECTED"]
    assert (got[2, "CROSSREF"], got[2, "THAIJO:so01"]) == ("SEARCHED_OK", "PLANNED")
    assert sorted(run_query(spark, tmp_path, "track_status", events=(events, schema))) == [(1, "global", "degraded"), (1, "local", "ok"), (2, "global", "unchanged")]
    assert sorted(run_query(spark, tmp_path, "not_found_bucket", events=(events, schema))) == [(1, "hit"), (2, "not_found")]


def test_fetch_evidence_asks_for_every_record(spark, tmp_path):
    from hashlib import md5

    docs = [(i, text, "s", 9) for i, text in enumerate(["same", "same", "", "x", "", "same", "y"])]
    got = {r[0]: r[1:] for r in run_query(spark, tmp_path, "fetch_evidence", documents=(docs, "doc_id long, text string, source string, n_chars int"))}
    names = ["OPENALEX", "CROSSREF", "PUBMED", "THAIJO"]
    want = {f"{names[i % 4]}:{i}": ("OK", "ABSTRACT" if text else "METADATA", i) for i, text, _, _ in docs}
    for i, text, _, _ in reversed(docs):
        if i % 3:
            want["DOI:10.5555/" + md5(text.encode()).hexdigest()] = ("OK", "ABSTRACT" if text else "METADATA", i)
    assert got == want | {"nonsense": ("UNAVAILABLE", None, None)}


@pytest.mark.parametrize("prefix", ["", "oai:"])
def test_harvested_pages_keep_doi_and_url(spark, prefix):
    from pyspark.sql import functions as F

    from admitflow.sources import projections as P

    ids = [["http://a/1", "https://doi.org/10.4/w"], ["10.5/v"], []]
    records = "".join(
        f"<o:record><o:header><o:identifier>oai:{i}</o:identifier></o:header><o:metadata><oai_dc:dc><dc:title>T{i}</dc:title>{''.join(f'<dc:identifier>{x}</dc:identifier>' for x in own)}</oai_dc:dc></o:metadata></o:record>"
        for i, own in enumerate(ids)
    )
    page = f'<o:OAI-PMH xmlns:oai="http://www.openarchives.org/OAI/2.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/"><o:ListRecords>{records}</o:ListRecords></o:OAI-PMH>'
    for tag in ("OAI-PMH", "ListRecords", "record", "header", "identifier", "metadata"):
        page = page.replace(f"<o:{tag}", f"<{prefix}{tag}").replace(f"</o:{tag}", f"</{prefix}{tag}")
    cut = P.oai_records(spark.createDataFrame([(page,)], "xml string")).drop("xml")
    rows = P.dublin_core(cut.select(F.to_json(F.struct("*")).alias("raw"))).orderBy("source_record_id").collect()
    assert [(r["source_record_id"], r["title"], r["doi"], r["url"]) for r in rows] == [("oai:0", "T0", "10.4/w", "http://a/1"), ("oai:1", "T1", "10.5/v", None), ("oai:2", "T2", None, None)]


def test_cues_are_looked_for_in_telling_parts_alone(spark, tmp_path):
    """The type of a text, whatever is put before it, is that of its parts with a cue; the query finds these once a text."""
    long = "plain words stand here and say little. " * 300
    texts = [long, long + "whether it was! we found this. no more", "study found more. " + long, long + "according to them! in 1999. so", long + "it is unclear if this study found. the end", long + ". . we used rats", "a.b", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string").selectExpr("*", R.telling_parts("x") + " told")
    assert all(r.told is None if r.x is None else len(r.told) < 120 for r in rows.collect())
    for cue in ("this", "we conclude", "whether", "x"):
        kinds = rows.selectExpr("id", R.statement_type(SPARK, f"concat('{cue} ', told)", f"concat('{cue} ', x)"), R.statement_type(SPARK, f"concat('{cue} ', x)")).collect()
        assert all(r[1] == r[2] for r in kinds)
        if cue == "x":
            assert [r[1] for r in kinds] == ["BACKGROUND", "RESULT", "BACKGROUND", "PRIOR_WORK", "BACKGROUND", "METHOD", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
        if cue == "this":
            assert kinds[2][1] == "RESULT"  # found across the border
