"""The engine's entries over tables: verify citations, discover works, resolve hints, check evidence, read coverage
(API1 to API3, API6, API7, API9, API11, JON1, JON3, JON5, JON7, JON10, AGG10, AGG12, SRT2, SRT4, SET2, TXT20).

A table of queries meets a table of hits (the candidates that its searches brought, each row with its query's id and an
`ord` of its own) and a table of calls (query_id, adapter, outcome; outcome HIT, NOT_FOUND or an error state).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.functions import vocab as V
from admitflow.operators import identity, verification

EXACT = "exact_identifier_match"


def hint_kind(citation: str) -> tuple[Column, Column]:
    """TXT20: (doi, pmid or title; its value): one DOI prefix is taken off, and the pattern must be the whole text."""
    whole = F.trim(F.col(citation))
    bare = F.regexp_replace(whole, r"(?i)^(https?://doi\.org/|doi:)", "")
    doi, pmid = bare.rlike(r"^10\.\d{4,9}/\S+$"), whole.rlike(r"^\d{1,9}$")
    return F.when(doi, "doi").when(pmid, "pmid").otherwise("title"), F.when(doi, bare).otherwise(whole)


def search_calls(queries: DataFrame, routes: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls to make, sources wanted but not available): each query with the adapters of its domain, in their order (JON1, JON5).

    `routes` (domain, adapter, priority) and `available` (adapter) are the engine's own few rows.
    """
    wanted = queries.select("query_id", "domain").join(F.broadcast(routes), "domain")
    return wanted.join(F.broadcast(available), "adapter", "left_semi"), wanted.join(F.broadcast(available), "adapter", "left_anti")


def misses(queries: DataFrame, hits: DataFrame, calls: DataFrame) -> DataFrame:
    """(query_id, bucket) of queries without a hit: adapter_error if a call failed, else not_found."""
    failed = calls.groupBy("query_id").agg(F.bool_or(F.col("outcome").isin(*V.ERROR_STATES)).alias("failed"), F.bool_or(F.col("outcome") == "HIT").alias("hit"))
    none = queries.select("query_id").join(hits.select("query_id").distinct(), "query_id", "left_anti").join(failed, "query_id", "left")
    error = F.coalesce("failed", F.lit(False)) & ~F.coalesce("hit", F.lit(False))
    return none.select("query_id", F.when(error, "adapter_error").otherwise("not_found").alias("bucket"))


def resolve_citations(queries: DataFrame, hits: DataFrame, intended: str = "SUPPORTS", relation=None) -> DataFrame:
    """One row per query and work: gates, state, relation, decision and bucket (API1). Candidates merge within their query.

    Only a VERIFIED work with decision ADMIT is in the bucket `verified`.
    """
    works = identity.works(hits, "ord", "query_id")
    asked = works.join(queries.select("query_id", "context", "citation"), "query_id")
    judged = verification.admit(verification.verify(asked, "citation", "context"), "context", intended, relation=relation)
    verified = F.col("state") == "VERIFIED"
    bucket = F.when(verified & (F.col("decision") == "ADMIT"), "verified").when(verified & (F.col("decision") == "HOLD"), "held").otherwise("rejected")
    return judged.withColumns({"bucket": bucket, "source_id": F.concat_ws(":", "adapter", "record_id")})


def last_by_source(cite_uses: DataFrame) -> DataFrame:
    """The reference keeps one entry per source in `held` and `rejected`: the last query's (AGG7)."""
    return cite_uses.filter("bucket <> 'verified'").groupBy("bucket", "source_id").agg(F.max_by(F.struct("query_id", "work", "state", "reason", "decision"), F.struct("query_id", "work")).alias("last")).select("bucket", "source_id", "last.*")


def query_family(planned: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(query_id, query, nth) of each topic's supporting, then challenging, then extra queries, each once (SET2).

    `planned` has (query_id, side, query, rank), `extra` (query_id, query, rank).
    """
    both = planned.select("query_id", "query", F.when(F.col("side") == "support", 0).otherwise(1).alias("part"), "rank")
    if extra is not None:
        both = both.unionByName(extra.select("query_id", "query", F.lit(2).alias("part"), "rank"))
    first = both.groupBy("query_id", "query").agg(F.min(F.struct("part", "rank")).alias("at"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).drop("at")


def discover_citations(topics: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per topic and work, with `found` and without any decision (API2). Candidates merge over a topic's whole family.

    hits carry the `query` that brought them; a work lists all of its members' queries (JON10).
    """
    works = identity.works(hits, "ord", "query_id")
    asked = works.join(topics.select("query_id", "context"), "query_id").withColumn("no_citation", F.lit(""))
    judged = verification.verify(asked, "no_citation", "context", "discovery")
    placed = identity.resolve(identity.whole(hits), "ord", "query_id").groupBy("work").agg(F.array_join(F.array_sort(F.collect_set("query")), "; ").alias("origin"))
    judged = judged.join(placed, "work").withColumn("found", F.col("state") == "VERIFIED")
    return judged.drop("no_citation", "matched_field", "shared_tokens", "title_ratio", "author_match", "g6_decided", "seq")


def first_results(found: DataFrame, most: int) -> DataFrame:
    """SRT2: up to `most` works of each topic in order of arrival; nothing is ranked."""
    return found.filter("found").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("work"))).filter(F.col("nth") <= most)


def hint_queries(hints: DataFrame) -> DataFrame:
    """hints with search_query, identity_query and by_identifier: a doi, else a pmid drives both; else title, terms and author search
    together, and the first of them that is given identifies."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    given = lambda *names: F.coalesce(*[F.when(text(c) != "", text(c)) for c in names], F.lit(""))
    identifier = given("doi", "pmid")
    parts = F.concat_ws(" ", *[F.when(text(c) != "", text(c)) for c in ("title", "search_terms", "author")])
    by = identifier != ""
    return hints.withColumns({"search_query": F.when(by, identifier).otherwise(parts), "identity_query": F.when(by, identifier).otherwise(given("title", "search_terms", "author")), "by_identifier": by})


def resolve_source(hints: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, status, source_id, matched_field: the first verified work that an identifier confirms, else, unless
    the hint is an identifier, the first verified work (API3, SRT4)."""
    asked = hint_queries(hints).withColumn("context", F.lit(""))
    works = identity.works(hits, "ord", "query_id").join(asked.select("query_id", "identity_query", "by_identifier", "context"), "query_id")
    fit = verification.verify(works, "identity_query", "context").filter("state = 'VERIFIED' and (matched_field is not null or not by_identifier)")
    best = fit.groupBy("query_id").agg(F.min_by(F.struct(F.concat_ws(":", "adapter", "record_id").alias("source_id"), "matched_field", "abstract"), F.struct(F.col("matched_field").isNull(), "work")).alias("best"))
    found = asked.select("query_id").join(best, "query_id", "left")
    status = F.when(F.col("best").isNull(), "UNRESOLVED").otherwise("SOURCE_CONFIRMED").alias("status")
    return found.select("query_id", status, "best.source_id", "best.matched_field", F.col("best.abstract").alias("passage"))


def verify_cite(citations: DataFrame, hits: DataFrame, intended: str = "SUPPORTS") -> DataFrame:
    """query_id, status, source_id, relation, statement_type, decision for (query_id, context, citation) rows (API7).

    A blank context is an ERROR row (API11); an unresolved citation is NOT_FOUND; the decision is the evidence check's.
    """
    kind, value = hint_kind("citation")
    hints = citations.withColumns({"_kind": kind, "_value": value}).select("query_id", *[F.when(F.col("_kind") == k, F.col("_value")).alias(k) for k in ("doi", "pmid", "title")], F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("search_terms"))
    found = citations.select("query_id", "context").join(resolve_source(hints, hits), "query_id")
    found = found.withColumn("p", F.coalesce("passage", F.lit("")))
    found = found.withColumn("j", verification.judgement("context", "p", "'VERIFIED'", intended))
    blank, lost = F.coalesce(F.trim("context") == "", F.lit(True)), F.col("status") == "UNRESOLVED"
    status = F.when(blank, "ERROR").when(lost, "NOT_FOUND").otherwise("CHECKED")
    told = lambda c: F.when(~blank & ~lost, c)
    labels = [told(F.col(f"j.{c}")).alias(c) for c in ("relation", "statement_type", "decision")]
    return found.select("query_id", status.alias("status"), told(F.col("source_id")).alias("source_id"), *labels)


def rejected_count(cite_uses: DataFrame) -> DataFrame:
    """AGG12: rejected works per query."""
    return cite_uses.filter("bucket = 'rejected'").groupBy("query_id").agg(F.count(F.lit(1)).alias("rejected"))


def endpoint_coverage(endpoints: DataFrame, statuses: DataFrame) -> DataFrame:
    """(source, status, reason) of every known endpoint by its last harvest, or NOT_ATTEMPTED (JON7, API9).

    `statuses` has one row per code: code, status (OK, or UNAVAILABLE:state), records.
    """
    met = endpoints.select("code").join(statuses.select("code", "status", "records"), "code", "left")
    status = F.when(F.col("status") == "OK", "SEARCHED_OK").when(F.col("status").isNull(), "NOT_ATTEMPTED").otherwise("UNAVAILABLE")
    cut = F.instr("status", ":")
    reason = F.when(F.col("status") == "OK", F.concat(F.col("records").cast("string"), F.lit(" record(s) harvested")))
    reason = reason.when(F.col("status").isNull(), "no harvest has ever been recorded for this endpoint").otherwise(F.substr("status", cut + 1))
    return met.select(F.concat(F.lit("THAIJO:"), "code").alias("source"), status.alias("status"), reason.alias("reason"))


def coverage_flags(coverage: DataFrame) -> DataFrame:
    """Per query: nothing was searched well, something is stale, something planned has no evidence (AGG10). No rows, no query: nothing is negative."""
    is_ = lambda name: F.bool_or(F.col("status") == name)
    return coverage.groupBy("query_id").agg((~is_("SEARCHED_OK")).alias("all_negative"), is_("STALE").alias("has_stale"), is_("PLANNED").alias("has_unconfirmed"))
