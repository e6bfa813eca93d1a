"""Registered queries of the whole entries over answers made of documents, and oracles that know what the answers say by
their making: no rule is run on either side of the comparison but the engine's own."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.plans import entries
from admitflow.plans.shared import read_spread
from admitflow.sources import captured
from admitflow.sources.adapters import SOURCES

#: A claim, and passages that support it by a result, contradict it, and merely suppose it.
CLAIM = "screen time increases anxiety among students"
PASSAGES = [f"We found that {CLAIM}.", f"We found that {CLAIM}.".replace("increases", "reduces"), f"We hypothesize that {CLAIM}."]


def _inverted(text: str) -> str:
    """A text as a JSON object of words and their places."""
    places: dict[str, list[int]] = {}
    for at, word in enumerate(text.split(" ")):
        places.setdefault(word, []).append(at)
    return json.dumps(places)


_ITEM = """'{"id":"W' || doc_id || '","doi":"https://doi.org/10.5555/' || doc_id || '","publication_year":' || (1990 + doc_id % 30) || ',"title":' || t || ',"authorships":[{"author":{"display_name":"Ann Lee"}}]' || abstract || '}'"""
#: Answers to each document's citation: the whole text is its work's title. Some are refused, late, empty, broken or without ids.
_ANSWERS = f"""
SELECT query, 'OPENALEX' AS adapter,
  CASE WHEN doc_id % 17 = 0 THEN 429 WHEN doc_id % 23 = 0 THEN 403 WHEN doc_id % 37 = 0 THEN 502 ELSE 200 END AS status, CAST(NULL AS STRING) AS failure,
  CASE WHEN doc_id % 19 = 0 THEN '{{"results":[]}}' WHEN doc_id % 29 = 0 THEN '{{"results":[' WHEN doc_id % 31 = 0 THEN '{{"results":[{{"title":"no id"}}]}}' ELSE '{{"results":[' || {_ITEM} || ']}}' END AS body FROM d
UNION ALL SELECT query, 'CROSSREF', CASE WHEN doc_id % 13 = 0 THEN 200 WHEN doc_id % 37 = 0 THEN NULL ELSE 200 END, CASE WHEN doc_id % 13 <> 0 AND doc_id % 37 = 0 THEN 'timeout' END,
  CASE WHEN doc_id % 13 = 0 THEN '{{"message":{{"items":[{{"DOI":"10.5555/' || doc_id || '","title":["Another work"],"author":[{{"given":"Ann","family":"Lee"}}],"issued":{{"date-parts":[[' || (1990 + doc_id % 30) || ']]}},"URL":"u"}}]}}}}'
    WHEN doc_id % 41 = 0 THEN '{{"message":{{}}}}' ELSE '{{"message":{{"items":[]}}}}' END FROM d
UNION ALL SELECT query, 'PUBMED', 200, CAST(NULL AS STRING), CASE WHEN doc_id % 43 = 0 THEN '{{"result":{{"uids":["' || doc_id || '"]}}}}' ELSE '{{"esearchresult":{{"idlist":[]}}}}' END FROM d WHERE doc_id % 5 <> 0
"""


def _capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    title = F.to_json(F.struct(F.coalesce(F.col("text"), F.lit("")).alias("t")))
    passages = F.element_at(F.array(*[F.lit(',"abstract_inverted_index":' + _inverted(p)) for p in PASSAGES]), (F.col("doc_id") % 3 + 1).cast("int"))
    made = docs.select("doc_id", F.concat(F.lit("https://doi.org/10.5555/"), "doc_id").alias("query"), F.substr(title, F.lit(6), F.length(title) - 6).alias("t"), passages.alias("abstract"))
    made.createOrReplaceTempView("d")
    return spark.sql(_ANSWERS)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    return docs.select(F.col("doc_id").alias("query_id"), F.lit(CLAIM).alias("context"), F.concat(F.lit("https://doi.org/10.5555/"), "doc_id").alias("citation"))


def captured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 to SRC4: each document's citation asked of three sources and one that isn't connected: outcomes, and what the records say."""
    wanted = entries.to_all(_claims(spark, sf_dir).withColumn("query", F.col("citation")), [*SOURCES, "TNRR"])
    calls, found = captured.search(_capture(spark, sf_dir), wanted.drop("priority"))
    said = found.groupBy("query_id", F.col("source_adapter").alias("adapter")).agg(F.count(F.lit(1)).alias("n_records"), F.max("source_record_id").alias("record_id"), F.max("doi").alias("doi"), F.max("year").alias("year"), F.max("abstract").alias("abstract"), F.md5(F.max("title")).alias("title_md5"))
    return calls.select("query_id", "adapter", "outcome").join(said, ["query_id", "adapter"], "left").fillna(0, ["n_records"])


def admit_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API1 in one plan: each document's citation for one claim, searched, merged, gated and decided; misses beside the works."""
    answer = entries.resolve(_claims(spark, sf_dir), entries.Sources(_capture(spark, sf_dir)), list(SOURCES))
    works = answer.works.select("query_id", "source_id", "n_members", "conflicts", "state", "relation", "statement_type", "decision", "bucket")
    none = F.lit(None).cast("string")
    missed = answer.missed.select("query_id", none.alias("source_id"), F.lit(0).alias("n_members"), none.alias("conflicts"), none.alias("state"), none.alias("relation"), none.alias("statement_type"), none.alias("decision"), "bucket")
    return works.unionByName(missed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (captured_search, admit_citations)}

_CALLS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
  c AS (SELECT doc_id AS query_id, 'OPENALEX' AS adapter, CASE WHEN doc_id % 17 = 0 THEN 'RATE_LIMITED' WHEN doc_id % 23 = 0 THEN 'ACCESS_DENIED' WHEN doc_id % 37 = 0 THEN 'TIMEOUT' WHEN doc_id % 19 = 0 THEN 'NOT_FOUND'
      WHEN doc_id % 29 = 0 OR doc_id % 31 = 0 THEN 'PARSER_ERROR' ELSE 'HIT' END AS outcome, text FROM d
    UNION ALL SELECT doc_id, 'CROSSREF', CASE WHEN doc_id % 13 = 0 THEN 'HIT' WHEN doc_id % 37 = 0 THEN 'TIMEOUT' WHEN doc_id % 41 = 0 THEN 'PARSER_ERROR' ELSE 'NOT_FOUND' END, 'Another work' FROM d
    UNION ALL SELECT doc_id, 'PUBMED', CASE WHEN doc_id % 5 = 0 THEN 'TIMEOUT' WHEN doc_id % 43 = 0 THEN 'PARSER_ERROR' ELSE 'NOT_FOUND' END, NULL FROM d
    UNION ALL SELECT doc_id, 'TNRR', 'NOT_CONNECTED', NULL FROM d)"""
_PASSAGE = lambda x: f"CASE {x} % 3 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PASSAGES)) + " END"

SQL: dict[str, str] = {
    "captured_search": _CALLS + f""" SELECT query_id, adapter, outcome, CAST(CASE WHEN outcome = 'HIT' THEN 1 ELSE 0 END AS BIGINT) AS n_records,
      CASE WHEN outcome = 'HIT' THEN CASE adapter WHEN 'OPENALEX' THEN 'W' || query_id ELSE '10.5555/' || query_id END END AS record_id, CASE WHEN outcome = 'HIT' THEN '10.5555/' || query_id END AS doi,
      CAST(CASE WHEN outcome = 'HIT' THEN 1990 + query_id % 30 END AS INTEGER) AS "year", CASE WHEN outcome = 'HIT' AND adapter = 'OPENALEX' THEN {_PASSAGE('query_id')} END AS abstract,
      CASE WHEN outcome = 'HIT' THEN md5(text) END AS title_md5 FROM c""",
    # both records: their titles differ; the second one alone has no abstract, so nothing is said of the claim
    "admit_citations": _CALLS + """, w AS (SELECT query_id, bool_or(outcome = 'HIT' AND adapter = 'OPENALEX') AS a, bool_or(outcome = 'HIT' AND adapter = 'CROSSREF') AS b, bool_or(outcome IN ('RATE_LIMITED', 'ACCESS_DENIED', 'TIMEOUT', 'PARSER_ERROR')) AS failed,
        max(CASE WHEN adapter = 'OPENALEX' THEN text END) AS text FROM c WHERE adapter <> 'TNRR' GROUP BY query_id),
      s AS (SELECT *, a AND b AND text <> '' AS conflict, a AND (NOT b) AND trim(text) <> '' AS sound FROM w)
      SELECT query_id, CASE WHEN a THEN 'OPENALEX:W' || query_id WHEN b THEN 'CROSSREF:10.5555/' || query_id END AS source_id, CAST(a AS INTEGER) + CAST(b AS INTEGER) AS n_members,
        CASE WHEN a OR b THEN CASE WHEN conflict THEN 'title' ELSE '' END END AS conflicts,
        CASE WHEN conflict THEN 'CONFLICT' WHEN a AND b THEN 'REJECTED' WHEN b OR sound THEN 'VERIFIED' WHEN a THEN 'REJECTED' END AS state,
        CASE WHEN a THEN CASE query_id % 3 WHEN 1 THEN 'CHALLENGES' ELSE 'SUPPORTS' END WHEN b THEN 'UNCLEAR' END AS relation, CASE WHEN a THEN CASE query_id % 3 WHEN 2 THEN 'HYPOTHESIS' ELSE 'RESULT' END WHEN b THEN 'UNKNOWN' END AS statement_type,
        CASE WHEN conflict THEN 'HOLD' WHEN a THEN CASE WHEN NOT sound THEN 'REJECT' ELSE CASE query_id % 3 WHEN 0 THEN 'ADMIT' WHEN 1 THEN 'REJECT' ELSE 'HOLD' END END WHEN b THEN 'HOLD' END AS decision,
        CASE WHEN a THEN CASE WHEN NOT sound THEN 'rejected' ELSE CASE query_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' ELSE 'held' END END WHEN b THEN 'held' WHEN failed THEN 'adapter_error' ELSE 'not_found' END AS bucket FROM s""",
}
