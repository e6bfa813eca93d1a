"""The whole entries API1 and API2: from queries over the sources' answers to decisions, one plan each.

Queries meet the adapters of their route or a given list, the adapters' answers come from a capture (`adapters.record` makes
one of live sources, `captured.search` reads it), candidates merge, gates and evidence decide, and queries without a candidate say
why. All candidates of an answer count; how many those are is the source's page size, an argument of its adapter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.functions import rules as R
from admitflow.functions import vocab as V
from admitflow.functions.dialect import SPARK
from admitflow.operators.fulltext import FullTextIndex
from admitflow.plans import citations
from admitflow.plans.shared import materialise
from admitflow.sources import captured
from admitflow.sources.adapters import SourceAdapter

#: What is said of a query that nothing was found for.
NOTES = {
    "not_found": "none of the sources asked returned a record for this query; that is no proof that the work doesn't exist",
    "adapter_error": "a source failed and none answered with a record; this is not an empty result",
}


class Answer(NamedTuple):
    """calls (query_id, query, adapter, outcome, note), works (one row per query or topic and work), and queries without a candidate:
    missed (query_id, query, bucket, note, by_adapter: array of (adapter, outcome))."""

    calls: DataFrame
    works: DataFrame
    missed: DataFrame


def routed(queries: DataFrame) -> DataFrame:
    """(query_id, query, adapter, priority) of (query_id, query, context): the adapters of the context's domain, in their order."""
    routes = queries.sparkSession.createDataFrame([(d, a, i) for d, order in V.ROUTES.items() for i, a in enumerate(order)], "domain string, adapter string, priority int")
    asked = queries.select("query_id", "query", F.expr(R.domain(SPARK, "coalesce(context, '')")).alias("domain"))
    return asked.join(F.broadcast(routes), "domain").drop("domain")


def to_all(queries: DataFrame, adapters: list[str]) -> DataFrame:
    """(query_id, query, adapter, priority): each query to each adapter, in the order given."""
    return queries.select("query_id", "query", F.posexplode(F.array(*map(F.lit, adapters))).alias("priority", "adapter"))


class Sources(NamedTuple):
    """What answers: a capture, forced failures, the kept index with a time for its age, and own adapters (see `captured.search`)."""

    capture: DataFrame
    injected: DataFrame | None = None
    index: FullTextIndex | None = None
    as_of: float = 0.0
    adapters: dict[str, SourceAdapter] | None = None


def _asked(wanted: DataFrame, sources: Sources) -> tuple[DataFrame, DataFrame]:
    """(calls, hits): hits have `ord` (query_id, priority, nth, query), unique and in the order of arrival.

    raw_metadata is a record's digest: gates ask whether there is a record, and the record itself stays in the capture.
    """
    calls, found = captured.search(sources.capture, wanted.drop("priority"), sources.injected, sources.index, sources.as_of, sources.adapters)
    found = found.withColumnsRenamed({"source_adapter": "adapter", "source_record_id": "record_id"})
    found = found.withColumn("raw_metadata", F.when(F.trim("raw") != "", F.md5("raw"))).drop("raw")
    hits = found.join(wanted.select("query_id", "query", "adapter", "priority"), ["query_id", "query", "adapter"])
    hits = hits.withColumn("ord", F.struct("query_id", "priority", "nth", "query")).drop("priority", "nth")
    return materialise(calls, "calls"), materialise(hits, "hits")


def _missed(calls: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries whose calls brought no candidate: adapter_error if a call failed and none was a hit, else not_found."""
    told = calls.groupBy("query_id", "query").agg(
        F.bool_or(F.col("outcome").isin(*V.ERROR_STATES, "NOT_CONNECTED")).alias("failed"), F.bool_or(F.col("outcome") == "HIT").alias("hit"),
        F.array_sort(F.collect_list(F.struct("adapter", "outcome"))).alias("by_adapter"),  # as many as there are adapters
    )
    none = told.join(hits.select("query_id", "query").distinct(), ["query_id", "query"], "left_anti")
    bucket = F.when(F.col("failed") & ~F.col("hit"), "adapter_error").otherwise("not_found")
    note = F.when(bucket == "not_found", NOTES["not_found"]).otherwise(NOTES["adapter_error"])
    return none.select("query_id", "query", bucket.alias("bucket"), note.alias("note"), "by_adapter")


def resolve(claims: DataFrame, sources: Sources, adapters: list[str] | None = None, intended: str = "SUPPORTS", relation=None) -> Answer:
    """API1: verifies citations for claims, (query_id, context, citation) with unique ids; works are as `citations.resolve_citations` gives them.

    Without `adapters` each claim's route decides. A blank claim raises; null and blank citations are searched like others.
    """
    blank = F.coalesce(F.trim("context") == "", F.lit(True))
    sound = F.when(~blank, True).otherwise(F.raise_error(F.concat(F.lit("a claim is needed: query "), F.col("query_id").cast("string"))))
    asked = claims.filter(sound).select("query_id", "context", F.coalesce("citation", F.lit("")).alias("citation"))
    queries = asked.withColumn("query", F.col("citation"))
    calls, hits = _asked(to_all(queries, adapters) if adapters else routed(queries), sources)
    return Answer(calls, citations.resolve_citations(asked, hits, intended, relation), _missed(calls, hits))


def discover(topics: DataFrame, planned: DataFrame, sources: Sources, adapters: list[str] | None = None, extra: DataFrame | None = None) -> Answer:
    """API2: finds works for topics (query_id, context) by their query families; no work carries a decision.

    `planned` and `extra` are as in `citations.query_family`; a topic that has neither is its own query. Works merge over
    their topic's whole family; misses are per query of a family.
    """
    family = citations.query_family(planned, extra).select("query_id", "query")
    asked = topics.select("query_id", "context").join(family, "query_id", "left").withColumn("query", F.coalesce("query", "context"))
    asked = asked.filter("query <> ''")
    calls, hits = _asked(to_all(asked, adapters) if adapters else routed(asked), sources)
    return Answer(calls, citations.discover_citations(topics, hits), _missed(calls, hits))
