"""Search in the kept index of harvested records (SRC5): hits, or why there are none; never a guarantee about the source itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.functions import vocab as V
from admitflow.operators.fulltext import FullTextIndex
from admitflow.sources import projections as P

#: Fixed value: hits of a query.
LIMIT = 50
KEYS = {"code": "string", "native_id": "string"}
NOTES = {
    "NEVER_SYNCED": "the local index is empty: a harvest is needed before it can be searched; this says nothing about the source",
    "STALE": "searched, nothing matched, in a snapshot past its age limit; no guarantee about what the source holds now",
    "FRESH": "searched, nothing matched in the local snapshot; no guarantee about what the source holds now",
}


def open_index(spark: SparkSession, path: str) -> FullTextIndex:
    """The index of harvested records in a folder: the first title and abstract are searched, the record and its time are stored."""
    return FullTextIndex(spark, path, KEYS, ["title", "abstract"], {"raw": "string", "harvested_at": "double"}, ["harvested_at"])


def to_index(records: DataFrame) -> DataFrame:
    """Rows for the index from (code, native_id, raw, harvested_at), raw as JSON."""
    first = lambda field: F.get(F.from_json(F.get_json_object("raw", f"$.{field}"), "array<string>"), F.lit(0))
    return records.select("code", "native_id", first("titles").alias("title"), first("descriptions").alias("abstract"), "raw", "harvested_at")


def freshness(index: FullTextIndex, as_of: float) -> str:
    """NEVER_SYNCED without records, STALE if the newest one is past the limit, else FRESH."""
    if index.is_empty():
        return "NEVER_SYNCED"
    newest = index.live().agg(F.max("harvested_at")).first()[0]
    return "STALE" if newest is None or as_of - newest > V.STALE_SECONDS else "FRESH"


def search(index: FullTextIndex, wanted: DataFrame, as_of: float, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(calls, candidates) of wanted (query_id, query): calls have outcome (HIT or NOT_FOUND), evidence (how fresh) and note."""
    fresh = freshness(index, as_of)
    asked = wanted.select("query_id", "query")
    found = index.search(asked, "query_id", "query", limit).withColumnRenamed("rank", "nth")
    raws = index.live().select(*KEYS, "raw")
    hits = found.join(raws, list(KEYS)).join(asked, "query_id")
    candidates = P.dublin_core(hits, keep=("query_id", "query", "nth", "raw"))
    calls = asked.join(found.select("query_id").distinct().withColumn("hit", F.lit(True)), "query_id", "left")
    outcome = F.when(F.col("hit"), "HIT").otherwise("NOT_FOUND")
    return calls.select("query_id", "query", F.lit("THAIJO").alias("adapter"), outcome.alias("outcome"), F.lit(fresh).alias("evidence"), F.when(F.col("hit").isNull(), NOTES[fresh]).alias("note")), candidates
