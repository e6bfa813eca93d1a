"""The evidence check with reasons in order, evidence behind ids, and relevance tags, on rows labelled by hand."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from admitflow.functions import rules, vocab
from admitflow.functions.dialect import SPARK
from admitflow.operators import evidence, relevance, verification

CLAIM = "screen time increases anxiety among students"
FOUND = f"We found that {CLAIM}."
PAIRS = "i int, claim string, passage string, kind string, rel string, evidence_ string"


def checked(spark, rows, **options):
    table = spark.createDataFrame([(i, *r, "kept") for i, r in enumerate(rows)], PAIRS)
    told = evidence.check_evidence(table, "claim", "passage", "kind", "rel", **options)
    assert told.columns == [*table.columns, "evidence"]
    return [r.evidence for r in told.orderBy("i").collect()]


def test_reasons_in_order(spark):
    agree, apart, bad, none, empty = checked(spark, [
        (CLAIM, FOUND, "RESULT", "SUPPORTS"), (CLAIM, FOUND, "METHOD", "SUPPORTS"), (CLAIM, FOUND, "result", "nonsense"), (CLAIM, FOUND, None, None), (None, None, None, "UNCLEAR"),
    ])
    assert (agree.decision, agree.agreement) == ("ADMIT", True)
    assert agree.reasons == ["ai_statement_type=RESULT agrees with checker_statement_type=RESULT", "ai_relation=SUPPORTS agrees with checker_relation=SUPPORTS", "relation_matches_intended_use"]
    assert (apart.decision, apart.agreement) == ("HOLD", False)
    assert apart.reasons == ["ai_statement_type=METHOD vs checker_statement_type=RESULT -- disagreement, routed to HOLD", "ai_relation=SUPPORTS agrees with checker_relation=SUPPORTS"]
    assert (bad.decision, bad.agreement, bad.proposed, bad.reasons) == ("ADMIT", None, None, ["relation_matches_intended_use"])
    assert none == bad
    assert (empty.decision, empty.agreement) == ("HOLD", True)
    assert empty.checked.statement_type == "UNKNOWN" and empty.reasons[-1] == "statement_type=UNKNOWN, no finding reported to evaluate"


def test_intended_and_directions(spark):
    against, scope = checked(spark, [(CLAIM, FOUND, None, None), (CLAIM, "In conclusion, screen time increases anxiety only among adults under 30.", None, None)], intended="CHALLENGES")
    assert (against.decision, against.reasons) == ("REJECT", ["relation_SUPPORTS_does_not_match_intended_CHALLENGES"])
    assert (scope.decision, scope.reasons) == ("HOLD", ["relation_QUALIFIES_narrower_scope_than_claim_needs_human_decision"])
    by_row = checked(spark, [(CLAIM, FOUND, None, None)], intended=F.lit(None).cast("string"))
    assert by_row[0].decision == "ADMIT"


def test_check_refuses_taken_names_and_takes_empty_tables(spark):
    table = spark.createDataFrame([], PAIRS)
    assert evidence.check_evidence(table, "claim", "passage").count() == 0
    clash = spark.createDataFrame([(CLAIM, FOUND, 1, 2)], "claim string, passage string, _labels int, _wanted int")
    row = evidence.check_evidence(clash, "claim", "passage").first()
    assert (row["_labels"], row["_wanted"], row.evidence.decision) == (1, 2, "ADMIT")
    with pytest.raises(ValueError):
        evidence.check_evidence(clash, "claim", "passage", into="_LABELS")


def test_labels_are_found_once(spark):
    """The long expressions stand once in the plan, whatever of the answer is read."""
    table = spark.createDataFrame([(CLAIM, FOUND, "RESULT")], "claim string, passage string, kind string")
    told = evidence.check_evidence(table, "claim", "passage", "kind").select("evidence.decision", "evidence.reasons", "evidence.agreement")
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    one = spark.sql("select 'c' as claim, 'p' as passage").select(evidence._labels("claim", "passage"))
    assert plan.count("we hypothesize") <= one._jdf.queryExecution().analyzed().toString().count("we hypothesize")


RECORD = "ord int, source_adapter string, source_record_id string, title string, authors array<string>, year int, doi string, pmid string, url string, abstract string"
RECORDS = [
    (1, "CROSSREF", "10.1/A", "Bare", ["Lee"], 2001, "10.1/a", None, "u", " "),
    (2, "OPENALEX", "W:1", "Whole", ["Lee"], 2002, "https://doi.org/10.1/A", "7", "u", " body "),
    (3, "PUBMED", "7", "Second", None, None, None, "PMID:7", None, "other"),
    (4, "THAIJO", "t1", "Elsewhere", None, None, "10.1/t", None, None, "x"),
    (5, "OPENALEX", None, None, None, None, "", None, None, None),
]


def test_fetch(spark):
    asked = ["openalex:W:1", "OPENALEX:w:1", "DOI:HTTPS://doi.org/10.1/a", "PMID: 7", "CROSSREF:10.1/A", "doi:10.1/t", "THAIJO:t1", "nonsense", ":x", "DOI: ", "DOI:doi:", None, "PMID:pmid:7", "PMID:7"]
    ids = spark.createDataFrame([(i, s, 0) for i, s in enumerate([*asked, "PMID:7"])], "i int, source_id string, _kind int")
    told = evidence.fetch(ids, spark.createDataFrame(RECORDS, RECORD), ["OPENALEX", "CROSSREF", "PUBMED"])
    assert told.columns == [*ids.columns, "evidence"]
    rows = [r.evidence for r in told.orderBy("i").collect()]
    at = lambda r: r.metadata and r.metadata.source_record_id
    assert [at(r) for r in rows] == ["W:1", None, "W:1", "W:1", "10.1/A", None, None, None, None, None, None, None, "W:1", "W:1", "W:1"]
    assert (rows[0].evidence_text, rows[0].evidence_level, rows[0].locator, rows[0].reason) == ("body", "ABSTRACT", "abstract", None)
    assert (rows[4].evidence_text, rows[4].evidence_level, rows[4].locator) == ("", "METADATA", "metadata-only")
    assert "no such source" in rows[6].reason and all("malformed" in rows[i].reason for i in (7, 8, 9, 11))
    assert rows[5].reason == rows[10].reason == "no record has exactly this identifier"


def test_fetch_tells_failures(spark):
    ids = spark.createDataFrame([("DOI:10.9/x",), ("OPENALEX:q",), ("PUBMED:7",)], "source_id string")
    failed = lambda *names: spark.createDataFrame([(n, "TIMEOUT") for n in names], "adapter string, state string")
    read = lambda f: {r.source_id: r.evidence.reason for r in evidence.fetch(ids, spark.createDataFrame(RECORDS, RECORD), ["OPENALEX", "PUBMED"], f).collect()}
    one, both = read(failed("openalex", "THAIJO")), read(failed("OPENALEX", "PUBMED"))
    assert one["DOI:10.9/x"].startswith("no record") and one["OPENALEX:q"].endswith("OPENALEX=TIMEOUT") and one["PUBMED:7"] is None
    assert both["DOI:10.9/x"].endswith("OPENALEX=TIMEOUT, PUBMED=TIMEOUT")


def test_tags(spark):
    home = '{"authorships":[{"institutions":null},{"institutions":[{"country_code":"%s","display_name":"%s"}]}]}'
    rows = [
        ("a", None, None, None, ""), ("Farms", "in Thailand", None, None, "ABOUT_THAILAND,FOREIGN_ABOUT_THAILAND"), ("Siam", None, "http://x.AC.th", None, "PUBLISHED_IN_THAILAND,ABOUT_THAILAND"),
        ("a", "b", None, home % ("th", "X"), "PUBLISHED_IN_THAILAND"), ("a", "b", None, home % ("NO", "Mahidol"), "PUBLISHED_IN_THAILAND"), ("a", "b", None, home % ("NO", "Oslo"), ""),
        ("น้ำ", None, "", "{broken", "THAI_LANGUAGE"), ("a", "b", "u", '{"authorships": "none", "primary_location": {"source": {"display_name": "ThaiJO"}}}', "PUBLISHED_IN_THAILAND"), (None, None, None, "[]", ""),
    ]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "title string, abstract string, url string, raw_metadata string, want string, _text int")
    told = relevance.tag(table).orderBy("_text").collect()
    assert [",".join(r.tags) for r in told] == [r.want for r in told]
    assert [r["_text"] for r in told] == list(range(len(rows)))


def test_admission_table(spark):
    """GAT11 and GAT12 for every state, relation and statement type, against the rule written as a plain function."""
    def plain(state, relation, kind, intended, g6, g5):
        if state == "REJECTED":
            return "HOLD" if g6 and not g5 else "REJECT"
        if state not in ("VERIFIED", "CONTENT_FETCHED") or kind not in (None, "RESULT", "CONCLUSION") or relation not in ("SUPPORTS", "CHALLENGES"):
            return "HOLD"
        return "ADMIT" if relation == intended else "REJECT"

    rows = [(s, r, k, i, a, b) for s in vocab.STATES for r in vocab.RELATIONS for k in [*vocab.STATEMENT_TYPES, None] for i in ("SUPPORTS", "CHALLENGES") for a in (True, False) for b in (True, False)]
    table = spark.createDataFrame(rows, "s string, r string, k string, i string, a boolean, b boolean")
    told = table.withColumn("d", F.expr(rules.admission(SPARK, "s", "r", "i", "k", "a", "b"))).collect()
    assert [tuple(x) for x in told if x.d != plain(*x[:6])] == []


def test_bound_is_never_below_the_ratio(spark):
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("ab cé\u0e01\U0001f600") for _ in range(dice.randrange(9)))
    rows = [(word(), word()) for _ in range(400)] + [("", ""), ("abc", "abc"), ("", "a")]
    told = spark.createDataFrame(rows, "a string, b string").withColumn("bound", verification.ratio_bound(F.col("a"), F.col("b"))).collect()
    assert all(r.bound > SequenceMatcher(None, r.a, r.b).ratio() - 1e-9 for r in told)
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(verification.ratio_bound(F.col("a"), F.col("b"))).first()[0] is None


def test_few_rows_reach_python(spark):
    """Rows that identifiers, overlaps or their characters decide carry no similarity."""
    from admitflow.operators import identity

    none = [F.lit(None).cast("string").alias(f"p_{c}") for c in identity.IDENTIFIERS]
    cases = [("Commons", "zebra fjord", False), ("Rules games common pool", "institutional rules games", True), ("water basins valley", "tree ecology forests, Lee", False), ("x", "10.1234/abcdef", False), ("Evolution of collective action", "evolutionary collectives actions, Lee", True)]
    table = spark.createDataFrame([(i, t, q, ["Lee"], "10.1234/abcdef") for i, (t, q, _) in enumerate(cases)], "i int, title string, citation string, authors array<string>, record_id string").select("*", *none)
    rows = verification.with_identity(table, "citation").orderBy("i").collect()
    assert [r.seq is not None for r in rows] == [False, False, False, False, True]


def test_similarity(spark):
    rows = [("\ufb01nance: A", "Finance a", 1.0), ("abc", "xyz", 0.0), (None, "a", 0.0), ("!", "!", 0.0), ("abcd", "bcde", 0.75), ("", "", 0.0)]
    told = verification.with_similarity(spark.createDataFrame([(*r, 1) for r in rows], "a string, b string, want double, _left int"), "a", "b")
    assert told.columns == ["a", "b", "want", "_left", "similarity"]
    assert all(r.similarity == r.want for r in told.collect())
