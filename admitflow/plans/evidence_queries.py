"""Registered queries of the evidence check, of evidence behind ids and of relevance tags over whole documents. Their
oracles are written by hand; those of the check know each passage's labels by its making."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.functions import vocab as V
from admitflow.operators import evidence, relevance
from admitflow.plans.queries import cand
from admitflow.plans.shared import read_spread

CLAIM = "screen time increases anxiety among students"
#: Passages with the labels that they have by hand: statement type and relation to CLAIM.
PASSAGES = [
    (f"We found that {CLAIM}.", "RESULT", "SUPPORTS"),
    ("We found that screen time reduces anxiety among students.", "RESULT", "CHALLENGES"),
    (f"We hypothesize that {CLAIM}.", "HYPOTHESIS", "SUPPORTS"),
    ("In conclusion, screen time increases anxiety only among adults under 30.", "CONCLUSION", "QUALIFIES"),
    ("We found that anxiety has many roots and forms.", "RESULT", "CONTEXT_ONLY"),
    ("We found quite other matters in these villages.", "RESULT", "UNCLEAR"),
]
#: Words of no weight that keep a document's own words away from the passage before them.
APART = " what comes behind this point belongs to the record as it was once kept here by hand. "
ADAPTERS = ["OPENALEX", "CROSSREF", "PUBMED"]
#: Names of institutions and their countries, by the remainder of a document's id.
HOMES = [("Mahidol University", "TH"), ("Oslo University", "NO"), ("Kasetsart Institute", "JP"), ("Keio", "th"), ("Turku", None)]


def evidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT13: a known passage before each document's whole text; quality and toxic labels stand for a reader's labels."""
    docs = read_spread(spark, f"{sf_dir}/documents.parquet").filter("doc_id is not null").select("doc_id", "text")
    said = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    pick = F.element_at(F.array(*[F.lit(p) for p, _, _ in PASSAGES]), (F.col("doc_id") % len(PASSAGES) + 1).cast("int"))
    pairs = docs.join(said, "doc_id", "left").select(
        "doc_id", F.lit(CLAIM).alias("claim"), F.concat(pick, F.lit(APART), F.coalesce("text", F.lit(""))).alias("passage"),
        F.when(F.col("quality") == 1, "RESULT").when(F.col("quality") == 0, "HYPOTHESIS").alias("own_type"),
        F.when(F.col("toxic") == 1, "nonsense").when((F.col("toxic") == 0) & (F.col("doc_id") % 2 == 0), "SUPPORTS").alias("own_relation"),
        F.when(F.col("doc_id") % 7 == 0, "CHALLENGES").alias("intended"),
    )
    told = evidence.check_evidence(pairs, "claim", "passage", "own_type", "own_relation", F.col("intended"))
    e = F.col("evidence")
    return told.select("doc_id", e.decision.alias("decision"), F.array_join(e.reasons, " | ").alias("reasons"), e.agreement.alias("agreement"), e.proposed.statement_type.alias("proposed_type"), e.proposed.relation.alias("proposed_relation"), e.checked.statement_type.alias("statement_type"), e.checked.relation.alias("relation"))


def fetch_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API4: each document's record by its source's id, DOI and PMID, and ids that are malformed or of no source here."""
    found = cand(spark, sf_dir).filter("ord is not null").withColumnsRenamed({"adapter": "source_adapter", "record_id": "source_record_id"})
    found = found.withColumns({"authors": F.array("author"), "abstract": F.when(F.col("ord") % 3 != 1, F.col("abstract"))})
    token = F.concat_ws(":", F.lower("source_adapter"), "source_record_id")
    asked = [token, F.concat(F.lit("DOI: https://doi.org/"), F.upper("doi")), F.col("pmid"), F.when(F.col("ord") % 9 == 0, F.concat(F.lit("nonsense "), "ord")), F.when(F.col("ord") % 8 == 0, F.concat(F.lit("TNRR:"), "ord"))]
    ids = found.select(F.explode(F.array(*asked)).alias("source_id")).filter("source_id is not null").distinct()
    told = evidence.fetch(ids, found, ADAPTERS)
    e = F.col("evidence")
    return told.select("source_id", e.status.alias("status"), e.reason.alias("reason"), e.evidence_level.alias("level"), e.locator.alias("locator"), e.metadata.source_record_id.alias("record_id"), F.md5(e.evidence_text).alias("text_md5"))


def record_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS1: each document as a record with institutions, countries, hosts and places in its raw metadata."""
    docs = read_spread(spark, f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    home = F.struct(pick([c for _, c in HOMES]).alias("country_code"), pick([n for n, _ in HOMES]).alias("display_name"))
    place = F.struct(F.when(F.col("doc_id") % 11 == 0, "https://so01.ThaiJO.org/x").alias("landing_page_url"))
    raw = F.to_json(F.struct(place.alias("primary_location"), F.array(F.struct(F.array(home).alias("institutions"))).alias("authorships")))
    raw = F.when(F.col("doc_id") % 3 == 0, raw).when(F.col("doc_id") % 3 == 1, '{"authorships": [')
    records = docs.select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "Water in Chiang Rai").when(F.col("doc_id") % 4 == 1, "การจัดการน้ำในชุมชนชนบท").alias("title"), F.when(F.col("doc_id") % 4 != 1, F.col("text")).alias("abstract"),
        F.when(F.col("doc_id") % 13 == 0, "http://www.cmu.AC.TH/j").alias("url"), raw.alias("raw_metadata"),
    )
    return relevance.tag(records).select("doc_id", F.array_join("tags", ",").alias("tags"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (evidence_reasons, fetch_by_id, record_relevance)}

_KIND = " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind, _) in enumerate(PASSAGES))
_RELATION = " ".join(f"WHEN {i} THEN '{relation}'" for i, (_, _, relation) in enumerate(PASSAGES))
_WORDS = "[" + ", ".join(f"'{w}'" for w in V.THAILAND_KEYWORDS) + "]"

SQL: dict[str, str] = {
    "evidence_reasons": f"""WITH k AS (SELECT d.doc_id, CASE d.doc_id % {len(PASSAGES)} {_KIND} END AS statement_type, CASE d.doc_id % {len(PASSAGES)} {_RELATION} END AS relation,
        CASE quality WHEN 1 THEN 'RESULT' WHEN 0 THEN 'HYPOTHESIS' END AS proposed_type, CASE WHEN toxic = 0 AND d.doc_id % 2 = 0 THEN 'SUPPORTS' END AS proposed_relation,
        CASE WHEN d.doc_id % 7 = 0 THEN 'CHALLENGES' ELSE 'SUPPORTS' END AS intended FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL),
      a AS (SELECT *, coalesce(proposed_type <> statement_type, FALSE) OR coalesce(proposed_relation <> relation, FALSE) AS apart, proposed_type IS NOT NULL OR proposed_relation IS NOT NULL AS given FROM k),
      b AS (SELECT *, CASE WHEN statement_type = 'HYPOTHESIS' THEN 'statement_type=HYPOTHESIS, no finding reported to evaluate'
          WHEN relation = 'QUALIFIES' THEN 'relation_QUALIFIES_narrower_scope_than_claim_needs_human_decision'
          WHEN relation IN ('CONTEXT_ONLY', 'UNCLEAR') THEN 'relation_' || relation || '_not_directional'
          WHEN relation = intended THEN 'relation_matches_intended_use' ELSE 'relation_' || relation || '_does_not_match_intended_' || intended END AS why FROM a)
      SELECT doc_id, CASE WHEN apart THEN 'HOLD' WHEN why = 'relation_matches_intended_use' THEN 'ADMIT' WHEN why LIKE '%does_not_match%' THEN 'REJECT' ELSE 'HOLD' END AS decision,
        concat_ws(' | ', 'ai_statement_type=' || proposed_type || CASE WHEN proposed_type = statement_type THEN ' agrees with checker_statement_type=' || statement_type ELSE ' vs checker_statement_type=' || statement_type || ' -- disagreement, routed to HOLD' END,
          'ai_relation=' || proposed_relation || CASE WHEN proposed_relation = relation THEN ' agrees with checker_relation=' || relation ELSE ' vs checker_relation=' || relation || ' -- disagreement, routed to HOLD' END,
          CASE WHEN NOT apart THEN why END) AS reasons,
        CASE WHEN apart THEN FALSE WHEN given THEN TRUE END AS agreement, proposed_type, proposed_relation, statement_type, relation FROM b""",
    "fetch_by_id": """WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'openalex' WHEN 1 THEN 'crossref' WHEN 2 THEN 'pubmed' ELSE 'thaijo' END AS adapter, '10.5555/' || md5(text) AS doi, n_chars, CASE WHEN doc_id % 3 <> 1 THEN trim(text) END AS body,
        doc_id % 3 <> 0 AS has_doi, doc_id % 7 = 0 AS has_pmid FROM documents WHERE doc_id IS NOT NULL),
      n AS (SELECT adapter || ':' || doc_id AS source_id, adapter || ':' || doc_id AS key FROM c UNION SELECT 'DOI: https://doi.org/' || upper(doi), doi FROM c WHERE has_doi UNION SELECT 'PMID:' || n_chars, 'PMID:' || n_chars FROM c WHERE has_pmid
        UNION SELECT 'nonsense ' || doc_id, NULL FROM c WHERE doc_id % 9 = 0 UNION SELECT 'TNRR:' || doc_id, NULL FROM c WHERE doc_id % 8 = 0),
      h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(body, '') = '', kind, doc_id) AS nth FROM (
        SELECT unnest([adapter || ':' || doc_id, CASE WHEN has_doi THEN doi END, CASE WHEN has_pmid THEN 'PMID:' || n_chars END]) AS key, body, doc_id % 4 AS kind, doc_id FROM c WHERE doc_id % 4 < 3) x WHERE key IS NOT NULL)
      SELECT source_id, CASE WHEN nth IS NULL THEN 'UNAVAILABLE' ELSE 'OK' END AS status,
        CASE WHEN nth IS NOT NULL THEN NULL WHEN source_id LIKE 'nonsense%' THEN 'malformed id: ADAPTER:native id, DOI:doi or PMID:pmid is expected' WHEN source_id LIKE 'TNRR%' THEN 'no such source here: TNRR' WHEN source_id LIKE 'thaijo%' THEN 'no such source here: THAIJO' ELSE 'no record has exactly this identifier' END AS reason,
        CASE WHEN nth IS NOT NULL THEN CASE WHEN coalesce(body, '') <> '' THEN 'ABSTRACT' ELSE 'METADATA' END END AS level, CASE WHEN nth IS NOT NULL THEN CASE WHEN coalesce(body, '') <> '' THEN 'abstract' ELSE 'metadata-only' END END AS locator,
        CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN nth IS NOT NULL THEN md5(coalesce(body, '')) END AS text_md5 FROM n LEFT JOIN h ON h.key = n.key AND h.nth = 1""",
    "record_relevance": f"""WITH r AS (SELECT doc_id, doc_id % 4 = 1 AS thai_title, doc_id % 4 = 0 OR (doc_id % 4 <> 1 AND len(list_filter({_WORDS}, lambda w: contains(lower(coalesce(text, '')), w))) > 0) AS about,
        doc_id % 13 = 0 OR (doc_id % 3 = 0 AND (doc_id % 11 = 0 OR doc_id % {len(HOMES)} IN (0, 2, 3))) AS here FROM documents WHERE doc_id IS NOT NULL)
      SELECT doc_id, concat_ws(',', CASE WHEN thai_title THEN 'THAI_LANGUAGE' END, CASE WHEN here THEN 'PUBLISHED_IN_THAILAND' END, CASE WHEN about THEN 'ABOUT_THAILAND' END, CASE WHEN about AND NOT thai_title AND NOT here THEN 'FOREIGN_ABOUT_THAILAND' END) AS tags FROM r""",
}
