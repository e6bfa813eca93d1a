"""Registered queries of the citation entries. Their oracles are written by hand for DuckDB and share no rule text with
the engine, only fixed values (word lists)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.functions import rules as R
from admitflow.functions import vocab as V
from admitflow.functions.dialect import SPARK
from admitflow.operators import identity, search, upsert, verification
from admitflow.plans import citations
from admitflow.plans.queries import SQL as CORE_SQL
from admitflow.plans.queries import PAIRS, cand, coverage_fold
from admitflow.plans.shared import materialise
from admitflow.sources import captured, projections, serialise

THAI = ["การจัดการน้ำในชุมชน", "น้ำในชุมชนชนบท", "ab การศึกษาไทย cd", "ไทย", "no thai at all", ""]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate as a work of its own, with a citation of one of six kinds."""
    doi = F.coalesce("doi", F.lit("10.5555/none"))
    kinds = [F.concat(F.lit("https://doi.org/"), F.upper(doi)), F.concat("title", F.lit(" "), "author"), F.concat(doi, F.lit("2")), F.concat(F.lit("see "), doi, F.lit(", p. 3")), F.col("record_id"), F.lit(" ")]
    pick = F.element_at(F.array(*kinds), (F.col("ord") % 6 + 1).cast("int"))
    return identity.whole(cand(spark, sf_dir)).withColumn("citation", pick).select("*", *[F.col(c).alias(f"p_{c}") for c in identity.IDENTIFIERS])


def gates_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT6 of every candidate up to the similarity, which SQL has no word for: null where that decides."""
    judged = verification.with_identity(_cited(spark, sf_dir), "citation")
    return judged.select("ord", "matched_field", F.size("shared_tokens").cast("long").alias("n_shared"), F.round("title_ratio", 6).alias("title_ratio"), "author_match", "g6_decided")


def detect_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.conflict_assertions(cand(spark, sf_dir))


def citation_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    dois = cand(spark, sf_dir).select(F.explode(F.array("doi", F.concat(F.lit(" https://doi.org/"), "doi"), F.concat(F.lit("DOI:"), "doi"), F.concat(F.lit("see "), "doi"), "record_id", "title")).alias("citation"))
    kind, value = citations.hint_kind("citation")
    return dois.filter("citation is not null").select("citation", kind.alias("hint"), value.alias("value"))


def claim_proposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS7 and TXT23: each user's turn as the claim, the next assistant's as the passage, and pairs known by hand."""
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = said.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("claim"))
    pairs = asked.join(said.filter("role = 'assistant'"), ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "claim", F.col("text").alias("passage"))
    pairs = pairs.unionByName(spark.createDataFrame([(f"hand:{i}", c, p) for i, (c, p) in enumerate(PAIRS)], "id string, claim string, passage string"))
    told = pairs.select("id", F.expr(R.tokens(SPARK, "claim")).alias("c"), F.expr(R.tokens(SPARK, "passage")).alias("p"))
    return told.select("id", F.expr(R.subject(SPARK, "c")).alias("subject"), F.expr(R.polarity(SPARK, "c", "p")).alias("polarity"))


def thai_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.createDataFrame([(x,) for x in THAI], "x string").unionByName(_table(spark, sf_dir, "benchmark").select(F.col("text").alias("x")))
    return frame.select("x", F.array_join(F.array_sort(verification.thai_runs(F.col("x"))), "|").alias("runs"))


def endpoint_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, JON7: the last event of each endpoint is its harvest; endpoints without one stay NOT_ATTEMPTED."""
    events = _table(spark, sf_dir, "events")
    code = F.format_string("so%02d", F.pmod("user_id", F.lit(23)).cast("int"))
    status = F.when(F.col("event_type") == "error", "UNAVAILABLE:TIMEOUT").otherwise("OK")
    rows = events.select(code.alias("code"), status.alias("status"), F.col("event_id").alias("records"), F.col("ts").alias("synced_at"))
    return citations.endpoint_coverage(captured.endpoints(spark), upsert.latest(rows, ["code"], ["synced_at", "records"]))


def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return citations.coverage_flags(spark.sql(coverage_fold(SPARK)))


def requested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON1, JON5: each claim's sources by its domain, available or not (PUBMED isn't here)."""
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(R.domain(SPARK, "text || ' hospital patients'")).alias("domain"))
    routes = spark.createDataFrame([(d, a, i + 1) for d, order in V.ROUTES.items() for i, a in enumerate(order)], "domain string, adapter string, priority int")
    here = captured.default_sources(spark).filter("adapter <> 'PUBMED'").select("adapter")
    made, missing = citations.search_calls(asked, routes, here)
    return made.withColumn("available", F.lit(True)).unionByName(missing.withColumn("available", F.lit(False))).select("query_id", "adapter", "priority", "available")


def inverted_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ2 of every text's inverted index is the text again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", projections.index_of_text("text").alias("index"))
    return docs.select("doc_id", F.md5(projections.text_of_index(F.col("index"))).alias("digest"))


def _payloads(docs: DataFrame) -> dict[str, Column]:
    title = F.substring("text", 1, 40)
    source = F.coalesce("source", F.lit(""))
    return {
        "openalex": F.to_json(F.struct(F.concat(F.lit("W"), "doc_id").alias("id"), title.alias("display_name"), (2000 + F.col("doc_id") % 20).cast("int").alias("publication_year"), F.concat(F.lit("https://doi.org/10.1/"), "doc_id").alias("doi"), F.array(F.struct(F.struct(source.alias("display_name")).alias("author"))).alias("authorships"))),
        "crossref": F.to_json(F.struct(F.concat(F.lit("10.2/"), "doc_id").alias("DOI"), F.array(title).alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), source.alias("family"))).alias("author"), F.struct(F.array(F.array((1990 + F.col("doc_id") % 30).cast("int"))).alias("date-parts")).alias("issued"), F.array(F.lit("1111-2222")).alias("ISSN"))),
        "pubmed": F.to_json(F.struct(F.col("doc_id").cast("string").alias("uid"), title.alias("title"), F.array(F.struct(source.alias("name"))).alias("authors"), F.array(F.struct(F.lit("doi").alias("idtype"), F.lit("").alias("value")), F.struct(F.lit("doi").alias("idtype"), F.concat(F.lit("10.3/"), "doc_id").alias("value"))).alias("articleids"), F.concat((1980 + F.col("doc_id") % 40).cast("string"), F.lit(" May 3")).alias("pubdate"), F.lit("").alias("issn"), F.lit("3333-4444").alias("essn"))),
    }


def source_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, PRJ3, PRJ4 of a payload per document and source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    made = None
    for name, payload in _payloads(docs).items():
        own = getattr(projections, name)(docs.select(payload.alias("raw")))
        made = own if made is None else made.unionByName(own)
    return made.select("source_adapter", "source_record_id", "title", F.array_join("authors", "|").alias("authors"), "year", "doi", "pmid", "issn", "url")


def citation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6 of every candidate."""
    rows = identity.whole(cand(spark, sf_dir))
    return rows.select("ord", serialise.citation_line().alias("line"))


def coverage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7 of every endpoint."""
    return endpoint_status(spark, sf_dir).select("source", serialise.coverage_line().alias("line"))


def resolve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API3 for the DOI of every candidate, among all candidates with that DOI."""
    every = identity.whole(cand(spark, sf_dir))
    hints = every.filter("doi is not null").select("doi").distinct().withColumn("query_id", F.col("doi"))
    null = F.lit(None).cast("string")
    hints = hints.select("query_id", F.concat(F.lit("doi:"), "doi").alias("doi"), null.alias("pmid"), null.alias("title"), null.alias("author"), null.alias("search_terms"))
    found = citations.resolve_source(hints, every.filter("doi is not null").withColumn("query_id", F.col("doi")))
    return found.select("query_id", "status", "source_id", "matched_field")


def _hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """What each claim's search brings: the k best candidates by text (k is the source's page size), searched once and kept."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"))
    best = materialise(search.top_k(_table(spark, sf_dir, "benchmark"), docs, "item_id", "text", "doc_id", ["title", "abstract"], k), "best")
    met = best.select("query_id", F.col("doc_id").alias("ord")).join(cand(spark, sf_dir), "ord")
    return materialise(met.withColumn("ord", F.col("query_id") * F.lit(1 << 40) + F.col("ord")), "hits")


def resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API1: each claim is context and citation of its own search's hits."""
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("context"), F.col("text").alias("citation"))
    uses = citations.resolve_citations(queries, _hits(spark, sf_dir))
    return uses.select("query_id", "work", "source_id", "state", "g1", "g2", "g3", "g4", "g5", "g6", "g6b", "g7", "level", "relation", "statement_type", "decision", "bucket", "reason")


def discover_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API2: each claim is a topic."""
    topics = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("context"))
    found = citations.discover_citations(topics, _hits(spark, sf_dir).withColumn("query", F.col("query_id").cast("string")))
    return found.select("query_id", "work", "adapter", "record_id", "n_members", "state", "g3", "g4", "g5", "g6_discovery", "g7", "found", "origin", F.size("matched_keywords").alias("n_matched"))


def verify_cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API7: every candidate's DOI, cited for its own title, among the candidates with that DOI."""
    every = identity.whole(cand(spark, sf_dir)).filter("doi is not null").withColumn("query_id", F.col("doi"))
    asked = every.groupBy("query_id").agg(F.min_by("title", "ord").alias("context")).withColumn("citation", F.concat(F.lit("https://doi.org/"), "query_id"))
    return citations.verify_cite(asked, every)


QUERIES = {
    f.__name__: f
    for f in (
        gates_identity, detect_conflicts, citation_hints, claim_proposition, thai_ngrams, endpoint_status, coverage_flags, requested_sources, inverted_abstract,
        source_projections, citation_lines, coverage_lines, resolve_source, resolve_citations, discover_citations, verify_cite,
    )
}

_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_C = """SELECT doc_id AS ord, CASE doc_id % 4 WHEN 0 THEN 'OPENALEX' WHEN 1 THEN 'CROSSREF' WHEN 2 THEN 'PUBMED' ELSE 'THAIJO' END AS adapter, CAST(doc_id AS VARCHAR) AS record_id,
  substr(text, 1, 80) AS title, text AS abstract, 2000 + n_chars % 25 AS year, source AS author, CASE WHEN doc_id % 3 <> 0 THEN '10.5555/' || md5(text) END AS doi,
  CASE WHEN doc_id % 7 = 0 THEN 'PMID:' || n_chars END AS pmid, CASE WHEN doc_id % 11 = 0 THEN 'arXiv:' || (n_chars % 1000) END AS arxiv_id, CASE WHEN doc_id % 2 = 0 THEN '{}' END AS raw_metadata,
  CASE WHEN doc_id % 2 = 0 THEN '1234-5678' END AS issn, CASE WHEN doc_id % 5 = 0 THEN 'https://journal.ac.th/' || doc_id END AS url FROM documents"""
_KW = lambda x: f"list_distinct([k FOR k IN regexp_extract_all(lower({x}), '[a-z0-9\\x{{0E00}}-\\x{{0E7F}}]+') IF len(k) > 2 AND NOT list_contains({_LIST(V.GATE_STOPWORDS)}, k)])"
_GATE = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '^https?://doi\\.org/', ''), '^doi:', ''), '^pm(c)?id:', ''))"
_KEY = lambda x: f"regexp_replace(regexp_replace(lower(trim({x})), '[\\p{{P}}\\p{{S}}]', '', 'g'), '\\s+', ' ', 'g')"
_HIT = lambda i: f"(q <> '' AND {i} <> '' AND (q = {i} OR (len({i}) >= 6 AND strpos(q, {i}) > 0 AND NOT regexp_matches(CASE WHEN strpos(q, {i}) > 1 THEN q[strpos(q, {i}) - 1] ELSE '' END || substr(q, strpos(q, {i}) + len({i}), 1), '[\\p{{L}}\\p{{N}}]'))))"

_ENDPOINTS = """WITH code AS (SELECT 'sc01' AS code UNION ALL SELECT k || '0' || i FROM (VALUES ('li'), ('ph'), ('he')) a(k), range(1, 6) t(i) UNION ALL SELECT 'so' || lpad(CAST(i AS VARCHAR), 2, '0') FROM range(1, 21) t(i)),
  last AS (SELECT 'so' || lpad(CAST(user_id % 23 AS VARCHAR), 2, '0') AS code, CASE WHEN event_type = 'error' THEN 'UNAVAILABLE:TIMEOUT' ELSE 'OK' END AS status, event_id,
    row_number() OVER (PARTITION BY user_id % 23 ORDER BY ts DESC, event_id DESC) AS n FROM events),
  found AS (SELECT 'THAIJO:' || code.code AS source, CASE WHEN status IS NULL THEN 'NOT_ATTEMPTED' WHEN status = 'OK' THEN 'SEARCHED_OK' ELSE 'UNAVAILABLE' END AS status,
    CASE WHEN status IS NULL THEN 'no harvest has ever been recorded for this endpoint' WHEN status = 'OK' THEN event_id || ' record(s) harvested' ELSE 'TIMEOUT' END AS reason
    FROM code LEFT JOIN (SELECT * FROM last WHERE n = 1) l ON l.code = code.code)"""

_WORKS = f"""WITH RECURSIVE c AS ({_C}),
  k AS (SELECT ord, 'd' || lower(doi) AS key FROM c WHERE doi IS NOT NULL UNION ALL SELECT ord, lower(pmid) FROM c WHERE pmid IS NOT NULL UNION ALL SELECT ord, lower(arxiv_id) FROM c WHERE arxiv_id IS NOT NULL UNION ALL
    SELECT ord, 'b' || issn || '|' || {_KEY('title')} || '|' || year || '|' || lower(split_part(trim(author), ' ', -1)) FROM c WHERE issn IS NOT NULL AND {_KEY('title')} <> '' AND trim(author) <> ''),
  e AS (SELECT DISTINCT a.ord AS u, b.ord AS v FROM k a JOIN k b USING (key)), reach(u, v) AS (SELECT ord, ord FROM c UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
  w AS (SELECT u AS ord, min(v) AS work FROM reach GROUP BY u)"""

SQL = {
    "gates_identity": f"""WITH c AS ({_C}), a AS (SELECT *, CASE ord % 6 WHEN 0 THEN 'https://doi.org/' || upper(coalesce(doi, '10.5555/none')) WHEN 1 THEN title || ' ' || author WHEN 2 THEN coalesce(doi, '10.5555/none') || '2'
        WHEN 3 THEN 'see ' || coalesce(doi, '10.5555/none') || ', p. 3' WHEN 4 THEN record_id ELSE ' ' END AS citation FROM c),
      b AS (SELECT *, {_GATE('citation')} AS q, {_GATE('doi')} AS i1, {_GATE('pmid')} AS i2, {_GATE('record_id')} AS i4, coalesce({_KW('citation')}, []) AS kq, coalesce({_KW('title')}, []) AS kt,
        lower(split_part(trim(author), ' ', -1)) AS who FROM a),
      m AS (SELECT *, CASE WHEN {_HIT('i1')} THEN 'doi' WHEN {_HIT('i2')} THEN 'pmid' WHEN {_HIT('i4')} THEN 'source_record_id' END AS matched_field, len(list_intersect(kq, kt)) AS n,
        coalesce(len(who) > 2 AND contains(lower(citation), who), FALSE) AS author_match FROM b),
      r AS (SELECT *, CASE WHEN least(len(kq), len(kt)) = 0 THEN 0.0 ELSE n * 1.0 / least(len(kq), len(kt)) END AS ratio FROM m)
      SELECT ord, matched_field, CAST(n AS BIGINT) AS n_shared, round(CAST(ratio AS DOUBLE), 6) AS title_ratio, author_match,
        CASE WHEN coalesce(trim(citation), '') = '' THEN FALSE WHEN matched_field IS NOT NULL THEN TRUE WHEN n < 2 AND NOT author_match THEN FALSE WHEN ratio >= 0.5 OR (author_match AND n >= 1) THEN TRUE END AS g6_decided FROM r""",
    "detect_conflicts": _WORKS
    + f""", m AS (SELECT w.work, c.* FROM w JOIN c USING (ord)),
      p AS (SELECT m.work, m.ord, m.adapter, m.record_id, x.field, x.value, x.base, f.adapter AS fa, f.record_id AS fr FROM m JOIN m f ON f.ord = m.work,
        LATERAL (SELECT 'title' AS field, m.title AS value, f.title AS base WHERE {_KEY('m.title')} <> {_KEY('f.title')} UNION ALL SELECT 'year', CAST(m.year AS VARCHAR), CAST(f.year AS VARCHAR) WHERE m.year <> f.year
          UNION ALL SELECT 'authors', m.author, f.author WHERE trim(m.author) <> '' AND trim(f.author) <> '' AND lower(trim(m.author)) <> lower(trim(f.author))) x)
      SELECT work, field, ord, adapter, record_id, value FROM p UNION ALL SELECT DISTINCT work, field, work AS ord, fa, fr, base FROM p""",
    "citation_hints": f"""WITH c AS ({_C}), a AS (SELECT unnest([doi, ' https://doi.org/' || doi, 'DOI:' || doi, 'see ' || doi, record_id, title]) AS citation FROM c)
      SELECT citation, CASE WHEN starts_with(rest, '10.5555/') THEN 'doi' WHEN len(t) BETWEEN 1 AND 9 AND translate(t, '0123456789', '') = '' THEN 'pmid' ELSE 'title' END AS hint,
        CASE WHEN starts_with(rest, '10.5555/') THEN rest ELSE t END AS value
      FROM (SELECT citation, trim(citation) AS t, CASE WHEN starts_with(trim(citation), 'https://doi.org/') THEN substr(trim(citation), 17) WHEN starts_with(trim(citation), 'DOI:') THEN substr(citation, 5) ELSE trim(citation) END AS rest FROM a WHERE citation IS NOT NULL)""",
    "thai_ngrams": f"""SELECT x, coalesce(array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(len(t) - 2, 1)), lambda i: substr(t, i, 4)))), '|'), '') AS runs
      FROM (SELECT x, regexp_replace(x, '[^\\x{{0E00}}-\\x{{0E7F}}]', '', 'g') AS t FROM (SELECT unnest({_LIST(THAI)}) AS x UNION ALL SELECT text FROM benchmark))""",
    "endpoint_status": _ENDPOINTS + " SELECT source, status, reason FROM found",
    "coverage_lines": _ENDPOINTS + " SELECT source, '  ' || rpad(source, 20, ' ') || ' ' || status || ' -- ' || reason AS line FROM found",
    "coverage_flags": f"SELECT query_id, NOT bool_or(status = 'SEARCHED_OK') AS all_negative, bool_or(status = 'STALE') AS has_stale, bool_or(status = 'PLANNED') AS has_unconfirmed FROM ({CORE_SQL['coverage_fold']}) f GROUP BY query_id",
    "inverted_abstract": "SELECT doc_id, md5(text) AS digest FROM documents",
    "source_projections": """SELECT 'OPENALEX' AS source_adapter, 'W' || doc_id AS source_record_id, substr(text, 1, 40) AS title, coalesce(source, '') AS authors, CAST(2000 + doc_id % 20 AS INTEGER) AS year, '10.1/' || doc_id AS doi, NULL AS pmid, NULL AS issn, 'W' || doc_id AS url FROM documents
      UNION ALL SELECT 'CROSSREF', '10.2/' || doc_id, substr(text, 1, 40), trim('Ann ' || coalesce(source, '')), CAST(1990 + doc_id % 30 AS INTEGER), '10.2/' || doc_id, NULL, '1111-2222', NULL FROM documents
      UNION ALL SELECT 'PUBMED', CAST(doc_id AS VARCHAR), substr(text, 1, 40), coalesce(source, ''), CAST(1980 + doc_id % 40 AS INTEGER), '10.3/' || doc_id, CAST(doc_id AS VARCHAR), '3333-4444', 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' FROM documents""",
    "citation_lines": f"""SELECT ord, coalesce(author, '(no author listed)') || ' (' || year || '). ' || title || '. ' || CASE WHEN doi IS NULL AND pmid IS NULL THEN adapter || ':' || record_id ELSE concat_ws(' ', 'doi:' || doi, 'pmid:' || pmid) END AS line FROM ({_C})""",
    "resolve_source": f"""WITH c AS ({_C}), d AS (SELECT *, min(ord) OVER (PARTITION BY doi) AS work FROM c WHERE doi IS NOT NULL),
      f AS (SELECT * FROM d WHERE ord = work),
      g AS (SELECT f.doi, any_value(f.adapter || ':' || f.record_id) AS source_id, bool_and(coalesce({_KEY('d.title')} = {_KEY('f.title')}, TRUE) AND coalesce(d.year = f.year, TRUE)
        AND coalesce(lower(trim(d.author)) = lower(trim(f.author)) OR trim(d.author) = '' OR trim(f.author) = '', TRUE)) AND any_value(coalesce(trim(f.title) <> '' AND trim(f.author) <> '', FALSE) AND f.year IS NOT NULL)
        AND bool_or(coalesce(trim(d.abstract) <> '', FALSE) OR d.raw_metadata IS NOT NULL) AS sound FROM d JOIN f ON d.doi = f.doi GROUP BY f.doi)
      SELECT doi AS query_id, CASE WHEN sound THEN 'SOURCE_CONFIRMED' ELSE 'UNRESOLVED' END AS status, CASE WHEN sound THEN source_id END AS source_id, CASE WHEN sound THEN 'doi' END AS matched_field FROM g""",
}
