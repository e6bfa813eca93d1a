
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.functions import rules as R
from admitflow.functions import vocab as V
from admitflow.functions.dialect import DUCK, SPARK, Dialect
from admitflow.operators import identity, search, upsert
from admitflow.plans.shared import read_spread

TABLES = ("documents", "benchmark", "conversations", "events", "pages", "labels")
#: Tables of long texts, on which rules spend much time a row.
PROSE = ("documents", "conversations", "pages")

#: Cue passages, as the tables' prose is invented and holds none.
CUES = ["We found no significant association", "In conclusion", "We hypothesize", "This study aims to", "Previous studies suggest", "One limitation is", "We used",
        "It is not true that we found", "This trial found", "Only among adults", "increases", "decreased however", "according to Smith 2019", "whether we found"]
CLAIMS = ["social media causes depression", "exercise prevents disease", "tutoring increases students time on task", "caffeine is linked to sleep", "teachers like tablets", "Vitamin D raises mood!", "  "]
#: Passages and claims whose relation is known by hand.
PAIRS = [
    ("AI increases students time on task", "tutoring significantly increased students time on task in schools"),
    ("social media use causes depression", "we found no significant association between social media use and depression"),
    ("exercise raises blood pressure", "daily exercise lowers blood pressure in adults"),
    ("vaccine protects children", "the vaccine damages children in rare cases"),
    ("screen time increases anxiety", "screen time increases anxiety only among adults under 30"),
    ("screen time increases anxiety", "this paper describes quite other matters here"),
    ("screen time increases anxiety", "anxiety has many roots and forms"),
    ("screen time increases anxiety", "ok"),
]


def _cand(d: Dialect) -> str:
    return """SELECT doc_id AS ord, CASE doc_id % 4 WHEN 0 THEN 'OPENALEX' WHEN 1 THEN 'CROSSREF' WHEN 2 THEN 'PUBMED' ELSE 'THAIJO' END AS adapter,
      CAST(doc_id AS VARCHAR(20)) AS record_id, substr(text, 1, 80) AS title, text AS abstract, 2000 + n_chars % 25 AS year, source AS author,
      CASE WHEN doc_id % 3 <> 0 THEN '10.5555/' || md5(text) END AS doi, CASE WHEN doc_id % 2 = 0 THEN '1234-5678' END AS issn,
      CASE WHEN doc_id % 5 = 0 THEN 'https://journal.ac.th/' || doc_id END AS url, CASE WHEN doc_id % 7 = 0 THEN 'PMID:' || n_chars END AS pmid,
      CASE WHEN doc_id % 11 = 0 THEN 'arXiv:' || (n_chars % 1000) END AS arxiv_id, CASE WHEN doc_id % 2 = 0 THEN '{}' END AS raw_metadata FROM documents"""


def _values(d: Dialect, names: str, rows: list[tuple]) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(d.text(v) if isinstance(v, str) else str(v) for v in row) + ')' for row in rows)}) v({names})"


def tokenize_docs(d: Dialect) -> str:
    return f"""SELECT doc_id, CAST({d.size('t')} AS BIGINT) AS n_tokens, CAST({d.size(R.keywords(d, 't'))} AS BIGINT) AS n_keywords,
      CAST({d.size(R.keywords(d, 't', V.RELATION_STOPWORDS))} AS BIGINT) AS n_relation_keywords FROM (SELECT doc_id, {R.tokens(d, 'text')} AS t FROM documents) x"""


def _met(d: Dialect) -> str:
    """Keywords of claims (benchmark) and documents, joined on the keyword."""
    return f"""WITH c AS (SELECT item_id, {R.keywords(d, 't')} AS k FROM (SELECT item_id, {R.tokens(d, 'text')} AS t FROM benchmark) x),
      p AS (SELECT doc_id, {R.keywords(d, 't')} AS k FROM (SELECT doc_id, {R.tokens(d, 'text')} AS t FROM documents) x),
      cw AS (SELECT item_id, {d.size('k')} AS n, {d.unnest('k')} AS w FROM c), pw AS (SELECT doc_id, {d.size('k')} AS m, {d.unnest('k')} AS w FROM p),
      met AS (SELECT item_id, doc_id, n, m, count(*) AS shared FROM cw JOIN pw ON cw.w = pw.w GROUP BY item_id, doc_id, n, m)"""


def keyword_overlap(d: Dialect) -> str:
    return _met(d) + " SELECT item_id, doc_id, shared, round(shared * 1.0 / least(n, m), 6) AS ratio FROM met WHERE shared * 2 >= least(n, m)"


def discovery_relevance(d: Dialect) -> str:
    return _met(d) + " SELECT item_id, count(*) AS relevant_docs, max(shared) AS most_shared FROM met WHERE shared >= CASE WHEN n >= 2 THEN 2 ELSE 1 END GROUP BY item_id"


def statement_type(d: Dialect) -> str:
    cues = _values(d, "cue", [(c,) for c in CUES])
    if d.spark:  # cues are looked for once a text, not once for each of the cues put before it
        return f"""SELECT doc_id, cue, {R.statement_type(d, 'told', 'x')} AS statement_type FROM
          (SELECT doc_id, cue, concat(lower(cue), ' ', told) AS told, concat(lower(cue), ' ', x) AS x FROM
          (SELECT doc_id, {R.tokens_enough('x')} AS x, {R.telling_parts('x')} AS told FROM (SELECT doc_id, lower(text) AS x FROM documents) w) y CROSS JOIN {cues}) z"""
    return f"""SELECT doc_id, cue, {R.statement_type(d, 'x')} AS statement_type FROM
      (SELECT doc_id, cue, lower(cue || ' ' || text) AS x FROM documents CROSS JOIN {cues}) z"""


def _turns() -> str:
    return """SELECT u.conv_id, u.turn, u.text AS claim, a.text AS passage FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""


def relation_label(d: Dialect) -> str:
    pairs = _values(d, "claim, passage", PAIRS)
    cues = _values(d, "cue", [(c,) for c in CUES])
    return f"""SELECT id, cue, {R.relation(d, 'c', 'p')} AS relation FROM (SELECT id, cue, {R.tokens(d, 'claim')} AS c, {R.tokens(d, 'passage')} AS p FROM
      (SELECT CAST(conv_id AS VARCHAR(20)) || ':' || CAST(turn AS VARCHAR(20)) AS id, cue, 'effect increases ' || claim AS claim, cue || ' effect ' || passage AS passage FROM ({_turns()}) q CROSS JOIN {cues}
       UNION ALL SELECT claim AS id, passage AS cue, claim, passage FROM {pairs}) y) z"""


def check_claim_evidence(d: Dialect) -> str:
    outside = _values(d, "ai_type, ai_relation, intended", [("RESULT", "SUPPORTS", "SUPPORTS"), ("", "", "SUPPORTS"), ("METHOD", "", "CHALLENGES"), ("nonsense", "CHALLENGES", "CHALLENGES"), ("", "QUALIFIES", "SUPPORTS")])
    pairs = [(c, lead + p) for c, p in PAIRS for lead in ("", "We found that ", "One limitation is that ")]
    legal = lambda x, of: f"CASE WHEN {x} IN ({', '.join(repr(v) for v in of)}) THEN {x} END"
    return f"""WITH k AS (SELECT claim, passage, lower(passage) AS x, {R.tokens(d, 'claim')} AS c, {R.tokens(d, 'passage')} AS p FROM
        (SELECT claim, passage FROM {_values(d, 'claim, passage', pairs)} UNION ALL SELECT claim, 'We found ' || passage FROM ({_turns()}) q) y),
      l AS (SELECT claim, passage, {R.statement_type(d, 'x')} AS kind, {R.relation(d, 'c', 'p')} AS relation FROM k),
      o AS (SELECT l.*, intended, ai_type, ai_relation, {legal('ai_type', V.STATEMENT_TYPES)} AS t, {legal('ai_relation', V.RELATIONS)} AS r FROM l CROSS JOIN {outside})
      SELECT claim, passage, ai_type, ai_relation, intended, kind, relation,
        CASE WHEN t <> kind OR r <> relation THEN 'HOLD' ELSE {R.admission(d, "'VERIFIED'", 'relation', 'intended', 'kind')} END AS decision,
        CASE WHEN t <> kind OR r <> relation THEN FALSE WHEN t IS NOT NULL OR r IS NOT NULL THEN TRUE END AS agreement FROM o"""


def domain_route(d: Dialect) -> str:
    routes = [(name, a, i + 1) for name, order in V.ROUTES.items() for i, a in enumerate(order)]
    topics = _values(d, "topic", [("",), (" clinical trial",), (" in thailand",), (" hospital patients in bangkok",), (" surin",)])
    return f"""SELECT item_id, topic, dom AS domain, adapter, priority FROM (SELECT item_id, topic, {R.domain(d, 'x')} AS dom FROM (SELECT item_id, topic, text || topic AS x FROM benchmark CROSS JOIN {topics}) y) z
      JOIN {_values(d, 'name, adapter, priority', routes)} ON name = dom"""


def relevance_tags(d: Dialect) -> str:
    return f"""SELECT ord, {d.join(R.relevance_tags(d, 'x', 'venue'), ',')} AS tags FROM (SELECT ord, title || CASE WHEN ord % 7 = 0 THEN ' in Northern Thailand ' ELSE ' ' END || abstract AS x, lower(coalesce(url, '')) AS venue FROM ({_cand(d)}) c) y"""


def normalise_ids(d: Dialect) -> str:
    raw = [("https://doi.org/10.1/AB",), ("doi:10.1/ab",), ("PMID:123",), ("pmcid:PMC9",), ("arXiv:1706.03762",), ("  ",), ("http://doi.org/10.2/x",), ("https://doi.org/doi:10.3/y",)]
    return f"""SELECT x, {R.merge_id(d, 'x')} AS merge_id, {R.gate_id(d, 'x')} AS gate_id, CASE WHEN {d.matches(d.replace('trim(x)', '^(?i:https?://doi\\.org/|doi:)', ''), '^10\\.\\d{4,9}/\\S+$')} THEN 'doi' WHEN {d.matches('trim(x)', '^\\d{1,9}$')} THEN 'pmid' ELSE 'title' END AS hint
      FROM (SELECT url AS x FROM pages UNION ALL SELECT x FROM {_values(d, 'x', raw)}) y"""


def normalise_titles(d: Dialect) -> str:
    return f"SELECT ord, {R.title_key(d, 'title')} AS title_key, {R.surname(d, 'author')} AS surname FROM ({_cand(d)}) c"


def plan_queries(d: Dialect) -> str:
    """CLS12: families in order, the leftmost of a family's words (longest first), up to three queries each way."""
    cases = {k: [] for k in ("word", "same", "opposite", "support", "challenge")}
    for _, a, a_word, b, b_word, support, challenge in V.RELATION_FAMILIES:
        words = sorted(a + b, key=lambda w: (-len(w), w))
        found = "lower(regexp_extract(claim, " + d.text(r"(?i)\b(" + "|".join(words) + r")\b") + ", 0))"
        cases["word"].append(f"nullif({found}, '')")
        in_a = f"{found} IN ({', '.join(d.text(w) for w in a)})"
        for name, x in (("same", f"CASE WHEN {in_a} THEN '{a_word}' ELSE '{b_word}' END"), ("opposite", f"CASE WHEN {in_a} THEN '{b_word}' ELSE '{a_word}' END"), ("support", d.list(support)), ("challenge", d.list(challenge))):
            cases[name].append(f"WHEN {found} <> '' THEN {x}")
    pick = lambda name, last: f"CASE {' '.join(cases[name])} ELSE {last} END"
    at = d.at("lower(claim)", "word")
    put = lambda x: R.clean_query(d, f"substr(claim, 1, {at} - 1) || {x} || substr(claim, {at} + length(word))")
    lists = lambda x: d.map(x, "q", R.clean_query(d, "topic || ' ' || q"))
    one = lambda *xs: f"array({', '.join(xs)})" if d.spark else f"[{', '.join(xs)}]"
    number = f"SELECT id, side, pos, q FROM (SELECT id, 'support' AS side, {'posexplode(s) AS (pos, q)' if d.spark else 'unnest(range(0, len(s))) AS pos, unnest(s) AS q'} FROM l UNION ALL SELECT id, 'challenge', {'posexplode(c) AS (pos, q)' if d.spark else 'unnest(range(0, len(c))), unnest(c)'} FROM l) n"
    return f"""WITH t AS (SELECT id, claim, coalesce({', '.join(cases['word'])}) AS word, {pick('same', "''")} AS same, {pick('opposite', "''")} AS opposite, {pick('support', d.list([]) if not d.spark else 'cast(array() as array<string>)')} AS sq, {pick('challenge', d.list(V.FALLBACK_QUALIFIERS))} AS cq
        FROM (SELECT id, {R.clean_query(d, 'claim')} AS claim FROM (SELECT 'b' || CAST(item_id AS VARCHAR(20)) AS id, text AS claim FROM benchmark UNION ALL SELECT claim AS id, claim FROM {_values(d, 'claim', [(c,) for c in CLAIMS])}) a) b WHERE claim <> ''),
      u AS (SELECT *, CASE WHEN word IS NULL THEN claim ELSE {put("' '")} END AS topic FROM t),
      l AS (SELECT id, CASE WHEN word IS NULL THEN {one('claim')} ELSE {d.concat(one('claim', put('same')), lists('sq'))} END AS s, CASE WHEN word IS NULL THEN {lists('cq')} ELSE {d.concat(one(put('opposite')), lists('cq'))} END AS c FROM u),
      n AS ({number}), f AS (SELECT id, side, q, pos, row_number() OVER (PARTITION BY id, side, lower(q) ORDER BY pos) AS nth FROM n WHERE q <> ''),
      r AS (SELECT id, side, q, row_number() OVER (PARTITION BY id, side ORDER BY pos) AS rank FROM f WHERE nth = 1)
      SELECT id, side, q AS query, CAST(rank AS INT) AS rank FROM r WHERE rank <= {V.MAX_QUERIES}"""


#: The oracle's own statement of the decision: what admits or rejects, and HOLD for all else.
_DECISION = """CASE WHEN state IN ('VERIFIED', 'CONTENT_FETCHED') AND kind IN ('RESULT', 'CONCLUSION') AND relation IN ('SUPPORTS', 'CHALLENGES')
    THEN CASE WHEN relation = intended THEN 'ADMIT' ELSE 'REJECT' END WHEN state = 'REJECTED' AND (g5 OR NOT g6) THEN 'REJECT' ELSE 'HOLD' END"""


def admission_decision(d: Dialect) -> str:
    """GAT11: each document as a work in one of the states, with a passage of one of the kinds, in every relation and gate."""
    one = lambda name, values: _values(d, name, [(v,) for v in values]).replace(" v(", f" {name}_v(")
    pick = lambda values, x: "CASE " + x + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    flags = _values(d, "g6, g5", [(True, True), (True, False), (False, True), (False, False)]).replace(" v(", " flag_v(")
    works = f"""(SELECT doc_id, {pick(V.STATES, f'doc_id % {len(V.STATES)}')} AS state, {pick(V.STATEMENT_TYPES, f'doc_id % {len(V.STATEMENT_TYPES)}')} AS kind FROM documents WHERE doc_id IS NOT NULL) w"""
    decision = R.admission(d, "state", "relation", "intended", "kind", "g6", "g5") if d.spark else _DECISION
    return f"""SELECT doc_id, state, relation, kind, intended, g6, g5, {decision} AS decision
      FROM {works} CROSS JOIN {one('relation', V.RELATIONS)} CROSS JOIN {one('intended', ['SUPPORTS', 'CHALLENGES'])} CROSS JOIN {flags}"""


def http_state(d: Dialect) -> str:
    log = _values(d, "outcome, status, failure, body", [("view", 200, "", "ok"), ("click", 429, "", ""), ("error", 500, "", ""), ("purchase", 403, "", ""), ("signup", 200, "", "empty")])
    return f"""SELECT state, count(*) AS calls FROM (SELECT CASE WHEN failure IN ('timeout', 'connection') OR status >= 500 THEN 'TIMEOUT' WHEN status = 429 THEN 'RATE_LIMITED' WHEN status IN (401, 403) THEN 'ACCESS_DENIED'
      WHEN status <> 200 OR body IN ('bad_json', 'missing_field', 'no_id') THEN 'PARSER_ERROR' WHEN body = 'empty' THEN 'NOT_FOUND' ELSE 'OK' END AS state
      FROM events JOIN {log} ON event_type = outcome) x GROUP BY state"""


def _calls() -> str:
    """Search calls from events: user as query, a source per event, event type as outcome."""
    return """SELECT user_id AS query_id, CASE event_id % 4 WHEN 0 THEN 'OPENALEX' WHEN 1 THEN 'CROSSREF' WHEN 2 THEN 'PUBMED' ELSE 'THAIJO' END AS adapter,
      CASE event_type WHEN 'error' THEN 'TIMEOUT' WHEN 'signup' THEN 'NOT_FOUND' WHEN 'purchase' THEN 'NEVER_SYNCED' WHEN 'click' THEN 'STALE' ELSE 'HIT' END AS outcome FROM events"""


def coverage_fold(d: Dialect) -> str:
    """AGG9, JON6: the worst evidence of each planned source decides its status; without evidence it stays PLANNED."""
    plan = _values(d, "source", [(a,) for a in ("OPENALEX", "CROSSREF", "PUBMED", "THAIJO", "THAIJO:so01", "TNRR")])
    return f"""WITH e AS (SELECT query_id, adapter, max(CASE outcome WHEN 'TIMEOUT' THEN 4 WHEN 'NEVER_SYNCED' THEN 3 WHEN 'STALE' THEN 2 ELSE 1 END) AS worst FROM ({_calls()}) c GROUP BY query_id, adapter)
      SELECT q.query_id, source, CASE WHEN source IN ('TNRR', 'TCI') THEN 'NOT_CONNECTED' WHEN worst >= 3 THEN 'UNAVAILABLE' WHEN worst = 2 THEN 'STALE' WHEN worst = 1 THEN 'SEARCHED_OK' ELSE 'PLANNED' END AS status
      FROM (SELECT DISTINCT query_id FROM ({_calls()}) c) q CROSS JOIN {plan} LEFT JOIN e ON e.query_id = q.query_id AND e.adapter = split_part(source, ':', 1)"""


def track_status(d: Dialect) -> str:
    """AGG8: a track with an error is degraded, else ok with a healthy source, else unchanged."""
    flag = lambda test: f"max(CASE WHEN {test} THEN 1 ELSE 0 END) = 1"
    return f"""SELECT query_id, CASE WHEN adapter = 'THAIJO' THEN 'local' ELSE 'global' END AS track, CASE WHEN {flag("outcome = 'TIMEOUT'")} THEN 'degraded' WHEN {flag("outcome = 'HIT'")} THEN 'ok' ELSE 'unchanged' END AS status
      FROM ({_calls()}) c GROUP BY query_id, CASE WHEN adapter = 'THAIJO' THEN 'local' ELSE 'global' END"""


def not_found_bucket(d: Dialect) -> str:
    """API1: no source hit and one failed: adapter error; none failed: not found."""
    flag = lambda test: f"max(CASE WHEN {test} THEN 1 ELSE 0 END) = 1"
    return f"""SELECT query_id, CASE WHEN {flag("outcome = 'HIT'")} THEN 'hit' WHEN {flag("outcome = 'TIMEOUT'")} THEN 'adapter_error' ELSE 'not_found' END AS bucket FROM ({_calls()}) c GROUP BY query_id"""


def fetch_evidence(d: Dialect) -> str:
    """JON8, SRT3: every ADAPTER:id and DOI:id is asked for; of a record's rows the first with an abstract counts, else the first."""
    kind = "upper(split_part(source_id, ':', 1))"
    id_ = f"substr(source_id, {d.at('source_id', d.text(':'))} + 1)"
    return f"""WITH c AS (SELECT ord, upper(adapter) AS adapter, record_id, doi, CASE WHEN trim(abstract) <> '' THEN ord END AS whole FROM ({_cand(d)}) x),
      ids AS (SELECT adapter || ':' || record_id AS source_id FROM c UNION SELECT 'DOI:' || doi FROM c WHERE doi IS NOT NULL UNION SELECT 'nonsense' AS source_id),
      k AS (SELECT source_id, {kind} AS kind, CASE WHEN {kind} = 'DOI' THEN {R.gate_id(d, id_)} ELSE {id_} END AS id FROM ids),
      r AS (SELECT adapter AS kind, record_id AS id, min(whole) AS whole, min(ord) AS first FROM c GROUP BY adapter, record_id
        UNION ALL SELECT 'DOI' AS kind, id, min(whole) AS whole, min(ord) AS first FROM (SELECT {R.gate_id(d, 'doi')} AS id, whole, ord FROM c WHERE doi IS NOT NULL) n GROUP BY id)
      SELECT k.source_id, CASE WHEN r.first IS NULL THEN 'UNAVAILABLE' ELSE 'OK' END AS status, CASE WHEN r.whole IS NOT NULL THEN 'ABSTRACT' WHEN r.first IS NOT NULL THEN 'METADATA' END AS level,
        coalesce(r.whole, r.first) AS record FROM k LEFT JOIN r ON r.kind = k.kind AND r.id = k.id"""


def verdict_pivot(d: Dialect) -> str:
    kinds = ", ".join(f"count(CASE WHEN verdict = '{v}' THEN 1 END) AS {v.lower()}" for v in ("PASS", "FAIL", "INCONCLUSIVE"))
    return f"""WITH s AS (SELECT lang AS category, CASE WHEN quality = 1 AND toxic = 0 THEN 'PASS' WHEN quality = 0 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM documents JOIN labels ON documents.doc_id = labels.doc_id)
      SELECT coalesce(category, 'TOTAL') AS category, {kinds} FROM s GROUP BY ROLLUP(category)"""


STATED: list[Callable[[Dialect], str]] = [
    tokenize_docs, keyword_overlap, discovery_relevance, statement_type, relation_label, check_claim_evidence, domain_route, relevance_tags, normalise_ids,
    normalise_titles, plan_queries, admission_decision, http_state, coverage_fold, track_status, not_found_bucket, fetch_evidence, verdict_pivot,
]


def _views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for t in TABLES:
        if t in sql:
            path = f"{sf_dir}/{t}.parquet"
            (read_spread(spark, path) if t in PROSE else spark.read.parquet(path)).createOrReplaceTempView(t)


def _run(rule: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = rule(SPARK)
        _views(spark, sf_dir, sql)
        return spark.sql(sql)

    run.__name__ = rule.__name__
    return run


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "documents")
    return spark.sql(_cand(SPARK))


def resolve_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.resolve(cand(spark, sf_dir)).select("ord", "work")


def works_and_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.works(cand(spark, sf_dir)).select("work", "n_members", "doi", "pmid", "arxiv_id", "conflicts", "state", "g1", "g2", "g3", "g4", "g5", "g7")


def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search.top_k(asked, docs, "item_id", "text", "doc_id", ["title", "abstract"], 50)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("at"), "event_id", "value")
    return upsert.latest(e, ["user_id", "event_type"], ["at", "event_id"])


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return upsert.index_stats(e, "user_id", "at", 1_707_900_000.0)


_KEYS = f"""WITH RECURSIVE c AS ({_cand(DUCK)}),
  k AS (SELECT ord, 'doi:' || lower(doi) AS key FROM c WHERE doi IS NOT NULL UNION ALL SELECT ord, lower(pmid) FROM c WHERE pmid IS NOT NULL UNION ALL SELECT ord, lower(arxiv_id) FROM c WHERE arxiv_id IS NOT NULL UNION ALL
    SELECT ord, 'bib:' || trim(issn) || '|' || {R.title_key(DUCK, 'title')} || '|' || year || '|' || {R.surname(DUCK, 'author')} FROM c WHERE issn IS NOT NULL AND {R.title_key(DUCK, 'title')} IS NOT NULL AND author IS NOT NULL),
  e AS (SELECT DISTINCT a.ord AS u, b.ord AS v FROM k a JOIN k b ON a.key = b.key),
  reach(u, v) AS (SELECT ord, ord FROM c UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
  w AS (SELECT u AS ord, min(v) AS work FROM reach GROUP BY u)"""

_OWN = {
    "resolve_identities": _KEYS + " SELECT ord, work FROM w",
    "works_and_gates": _KEYS
    + f""", m AS (SELECT w.work, c.*, coalesce({R.title_key(DUCK, 'title')}, '') AS title_key, lower(trim(author)) AS who FROM w JOIN c USING (ord)),
  g AS (SELECT m.work, count(*) AS n_members, arg_min(m.doi, m.ord) FILTER (m.doi IS NOT NULL) AS doi,
      bool_or(coalesce(m.title_key <> f.title_key AND m.title IS NOT NULL AND f.title IS NOT NULL, FALSE)) AS t, bool_or(coalesce(m.year <> f.year, FALSE)) AS y, bool_or(coalesce(m.who <> f.who AND m.who <> '' AND f.who <> '', FALSE)) AS a,
      bool_and(m.ord = f.ord OR EXISTS (SELECT 1 FROM k x JOIN k y ON x.key = y.key WHERE x.ord = m.ord AND y.ord = f.ord)) AS g2, bool_or(coalesce(trim(m.doi) <> '' , FALSE) OR coalesce(trim(m.url) <> '', FALSE)) AS g4,
      bool_or(coalesce(trim(m.abstract) <> '', FALSE) OR coalesce(trim(m.raw_metadata) <> '', FALSE)) AS g5, arg_min(m.pmid, m.ord) FILTER (m.pmid IS NOT NULL) AS pmid, arg_min(m.arxiv_id, m.ord) FILTER (m.arxiv_id IS NOT NULL) AS arxiv_id, any_value(coalesce(trim(f.title) <> '' AND trim(f.author) <> '', FALSE) AND f.year IS NOT NULL) AS whole
      FROM m JOIN m f ON f.ord = m.work GROUP BY m.work),
  s AS (SELECT *, array_to_string(list_filter([CASE WHEN t THEN 'title' END, CASE WHEN y THEN 'year' END, CASE WHEN a THEN 'authors' END], lambda x: x IS NOT NULL), ',') AS conflicts FROM g)
  SELECT work, n_members, doi, pmid, arxiv_id, conflicts, CASE WHEN conflicts <> '' THEN 'CONFLICT' WHEN n_members > 1 OR doi IS NOT NULL OR pmid IS NOT NULL OR arxiv_id IS NOT NULL THEN 'IDENTIFIED' ELSE 'DISCOVERED' END AS state, TRUE AS g1, g2, whole AND conflicts = '' AS g3, g4, g5, conflicts = '' AS g7 FROM s""",
    "fts_topk": f"""WITH t AS (SELECT doc_id, {R.tokens(DUCK, 'substr(text, 1, 80)')} AS a, {R.tokens(DUCK, 'text')} AS b FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(a) + len(b)) AS avg_length FROM t),
  p AS (SELECT col, token, doc_id, length, count(*) AS tf FROM (SELECT doc_id, 'title' AS col, unnest(a) AS token, len(a) + len(b) AS length FROM t UNION ALL SELECT doc_id, 'abstract', unnest(b), len(a) + len(b) FROM t) x GROUP BY ALL),
  f AS (SELECT col, token, count(*) AS df FROM p GROUP BY ALL), q AS (SELECT item_id, unnest(list_distinct({R.tokens(DUCK, 'text')})) AS token FROM benchmark),
  s AS (SELECT item_id AS query_id, doc_id, round(sum(-(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
    FROM q JOIN p USING (token) JOIN f USING (col, token) CROSS JOIN n GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50""",
    "upsert_latest": "WITH r AS (SELECT user_id, event_type, CAST(epoch(ts) AS DOUBLE) AS \"at\", event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, \"at\", event_id, value FROM r WHERE n = 1",
    "index_stats": "SELECT user_id, count(*) AS n, CAST(min(epoch(ts)) AS DOUBLE) AS oldest, CAST(max(epoch(ts)) AS DOUBLE) AS newest, 1707900000.0 - max(epoch(ts)) > 1209600 AS is_stale FROM events GROUP BY user_id",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _run(f) for f in STATED} | {f.__name__: f for f in (resolve_identities, works_and_gates, fts_topk, upsert_latest, index_stats)}
SQL: dict[str, str] = {f.__name__: f(DUCK) for f in STATED} | _OWN
