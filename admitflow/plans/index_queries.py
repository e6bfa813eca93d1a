"""Registered queries over kept tables: the full-text index, the merge store and harvested pages, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.operators.fulltext import FullTextIndex
from admitflow.plans import queries as core
from admitflow.plans.shared import fresh_path, read_spread
from admitflow.sources import projections
from admitflow.sources.merge_store import MergeStore


def local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are delivered twice, first by their titles alone, then whole; benchmark items search what is there then."""
    # the index deals documents by key before it reads their words, so they needn't be spread here
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"))
    index = FullTextIndex(spark, fresh_path(spark, "index"), {"doc_id": "bigint"}, ["title", "abstract"])
    index.upsert(docs.withColumn("abstract", F.lit(None).cast("string")), "harvest", 0)
    index.upsert(docs, "harvest", 1)
    return index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", 50)


def merge_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, then labels as a later batch of their keys, then the toxic ones' removal; buckets are compacted in between."""
    store = MergeStore(spark, fresh_path(spark, "store"), "doc_id bigint, at int, source string, value bigint", ["doc_id"], ["at"])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("at"), "source", F.col("n_chars").cast("long").alias("value"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    store.upsert(docs, "documents", 0)
    store.upsert(labels.select("doc_id", F.lit(2).alias("at"), F.lit("labels").alias("source"), F.col("quality").cast("long").alias("value")), "labels", 0)
    store.compact(2)
    gone = labels.filter("toxic = 1").select("doc_id", F.lit(3).alias("at"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("value"))
    store.delete(gone, "labels", 1)
    store.upsert(docs, "documents", 0)  # delivered again: changes nothing
    return store.read()


#: Pages from documents: a record of each, prefixed or not, some cut off or no XML at all, some with an error or a token.
_PAGES = """SELECT doc_id, CASE
    WHEN doc_id % 17 = 0 THEN '<html><body>busy</body>' WHEN doc_id % 19 = 0 THEN '<OAI-PMH><error code="noRecordsMatch">none</error></OAI-PMH>'
    WHEN doc_id % 23 = 0 THEN '<OAI-PMH><error code="badArgument">no</error></OAI-PMH>' WHEN doc_id % 29 = 0 THEN '<OAI-PMH><Identify/></OAI-PMH>'
    WHEN doc_id % 31 = 0 THEN '<OAI-PMH><ListRecords><record><header><identifier>cut off' || source
    WHEN doc_id % 2 = 0 THEN '<oai:OAI-PMH xmlns:oai="o" xmlns:dc="d"><oai:ListRecords><oai:record><oai:header><oai:identifier>oai:' || doc_id || '</oai:identifier></oai:header><oai:metadata><dc:title>' || t
      || '</dc:title><dc:title/><dc:identifier>10.5555/' || doc_id || '</dc:identifier></oai:metadata></oai:record></oai:ListRecords></oai:OAI-PMH>'
    ELSE '<OAI-PMH><ListRecords><record><header><identifier>oai:' || doc_id || '</identifier></header><metadata><dc><title>' || t || '</title><creator>' || source || '</creator><description>' || lang
      || '</description></dc></metadata></record><record><header status="deleted"><identifier>gone:' || doc_id || '</identifier></header></record><record><header/></record><resumptionToken> next' || doc_id || ' </resumptionToken></ListRecords></OAI-PMH>'
    END AS xml FROM (SELECT doc_id, source, lang, {title} AS t FROM documents) x"""


def oai_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8 over a page for each document: its state and token, and its records."""
    read_spread(spark, f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    pages = spark.sql(_PAGES.format(title=r"trim(regexp_replace(text, '[^a-zA-Z0-9]+', ' '))"))
    found = projections.oai_records(pages)
    one = lambda c: F.array_join(c, "|")
    return found.select("doc_id", "state", "token", "identifier", one("titles").alias("titles"), one("creators").alias("creators"), one("descriptions").alias("descriptions"), one("identifiers").alias("identifiers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (local_search, merge_store, oai_parse)}

SQL: dict[str, str] = {
    "local_search": core.SQL["fts_topk"],
    "merge_store": """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS "at", CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labels' END AS source, CAST(coalesce(l.quality, d.n_chars) AS BIGINT) AS value
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) = 0
""",
    # what the pages say by their making, not by reading them
    "oai_parse": r"""
WITH d AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g')) AS t,
    CASE WHEN doc_id % 17 = 0 THEN 'PARSER_ERROR' WHEN doc_id % 19 = 0 THEN 'NOT_FOUND' WHEN doc_id % 23 = 0 OR doc_id % 29 = 0 OR doc_id % 31 = 0 THEN 'PARSER_ERROR' END AS state FROM documents)
SELECT doc_id, state, CASE WHEN state IS NULL AND doc_id % 2 = 1 THEN 'next' || doc_id END AS token, CASE WHEN state IS NULL THEN 'oai:' || doc_id END AS identifier,
  CASE WHEN state IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN t || '|' ELSE t END END AS titles, CASE WHEN state IS NULL THEN CASE WHEN doc_id % 2 = 1 THEN source ELSE '' END END AS creators,
  CASE WHEN state IS NULL THEN CASE WHEN doc_id % 2 = 1 THEN lang ELSE '' END END AS descriptions, CASE WHEN state IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN '10.5555/' || doc_id ELSE '' END END AS identifiers FROM d
UNION ALL SELECT doc_id, state, 'next' || doc_id, 'gone:' || doc_id, '', '', '', '' FROM d WHERE state IS NULL AND doc_id % 2 = 1
""",
}
