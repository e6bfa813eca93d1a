"""Sources over captured responses and configured lists (SRC1 to SRC4, SRC9 to SRC13, JON1, JON9, PRJ6, PRJ7).

A capture is a table (adapter, query, status, failure, body) of what each source answered, one row per adapter and query: `body`
is its JSON. `adapters.calls` and `adapters.record` make one. Readers never raise: a failed call is a row with an error
state, and a call is a row whether it brought records or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.operators.fulltext import FullTextIndex
from admitflow.sources import projections as P
from admitflow.sources.adapters import SOURCES, SourceAdapter
from admitflow.sources.local import search as local_search

#: The default sources in their order, and the harvested endpoints' categories with their numbers of journals.
DEFAULT_SOURCES = ("OPENALEX", "CROSSREF", "PUBMED", "THAIJO")
ENDPOINTS = {"sc": 1, "li": 5, "ph": 5, "he": 5, "so": 20}
ENDPOINT_URL = "https://%s.tci-thaijo.org/index.php/index/oai"


def default_sources(spark: SparkSession) -> DataFrame:
    """SRC11: (adapter, priority)."""
    return spark.createDataFrame([(a, i) for i, a in enumerate(DEFAULT_SOURCES)], "adapter string, priority int")


def endpoints(spark: SparkSession) -> DataFrame:
    """SRC10: (code, url) of the 36 harvested endpoints."""
    codes = [(f"{kind}{i:02d}",) for kind, count in ENDPOINTS.items() for i in range(1, count + 1)]
    return spark.createDataFrame(codes, "code string").withColumn("url", F.format_string(ENDPOINT_URL, "code"))


#: What is said of a source that has neither a capture's reader nor an index.
NOT_CONNECTED = "this source isn't connected: nothing was asked"


def search(capture: DataFrame, wanted: DataFrame, injected: DataFrame | None = None, index: FullTextIndex | None = None, as_of: float = 0.0, sources: dict[str, SourceAdapter] | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls, candidates) for wanted (query_id, query, adapter) rows.

    calls: query_id, query, adapter, outcome (HIT or a state) and note. Candidates have `nth`, their place in the answer, and
    `raw`, their record. `sources` are the readers of captured answers by name, own ones among them. `injected` (adapter, query, state) forces failures for
    exact query texts; it never makes a record (SRC12). A query that the capture doesn't hold timed out. THAIJO is
    answered by the kept index, if there is one, as of the time given; other sources are NOT_CONNECTED.
    """
    local, known = index is not None, sources or SOURCES
    others = wanted.filter(~F.col("adapter").isin(*known, *(["THAIJO"] if local else [])))
    calls, candidates = _captured(capture, wanted.filter(F.col("adapter").isin(*known)), injected, known)
    calls = calls.unionByName(others.select("query_id", "query", "adapter", F.lit("NOT_CONNECTED").alias("outcome"), F.lit(NOT_CONNECTED).alias("note")))
    if local:
        asked = wanted.filter("adapter = 'THAIJO'")
        forced = injected.filter("adapter = 'THAIJO'").select("query", "state") if injected is not None else asked.select("query", F.lit(None).cast("string").alias("state")).limit(0)
        own, found = local_search(index, asked.join(forced, "query", "left_anti"), as_of)
        failed = asked.join(forced, "query").select("query_id", "query", "adapter", F.col("state").alias("outcome"), F.lit(None).cast("string").alias("note"))
        calls, candidates = calls.unionByName(own.drop("evidence")).unionByName(failed), candidates.unionByName(found)
    return calls, candidates


def read_answers(capture: DataFrame, sources: dict[str, SourceAdapter] | None = None) -> DataFrame:
    """(adapter, query, state, items) of every answer of the known sources: an error state, or null and its records as JSON texts.

    Answers whose records all lack an id are parser errors.
    """
    known = sources or SOURCES
    own = capture.filter(F.col("adapter").isin(*known))
    by_source = lambda make: F.coalesce(*[F.when(F.col("adapter") == name, make(source)) for name, source in known.items()])
    own = own.withColumn("items", F.when(F.col("status") == 200, by_source(lambda source: source.items("body"))))
    some = by_source(lambda source: F.exists("items", lambda r: F.coalesce(F.trim(F.get_json_object(r, source.record_id)) != "", F.lit(False))))
    body = F.when(F.try_parse_json("body").isNull(), "bad_json").when(F.col("items").isNull(), "missing_field").when(F.size("items") == 0, "empty").when(~some, "no_id")
    state = F.when(F.col("status").isNull() & F.col("failure").isNull(), "TIMEOUT").otherwise(P.http_state(F.col("status"), F.coalesce("failure", F.lit("")), F.coalesce(body, F.lit(""))))
    return own.withColumn("state", state).select("adapter", "query", "state", F.when(F.col("state").isNull(), F.col("items")).alias("items"))


def _captured(capture: DataFrame, wanted: DataFrame, injected: DataFrame | None, known: dict[str, SourceAdapter]) -> tuple[DataFrame, DataFrame]:
    """Answers are read before they meet what was asked, so calls shuffle states alone, and candidates the records of sound answers."""
    read, on = read_answers(capture, known), ["adapter", "query"]
    forced = injected.select(*on, F.col("state").alias("forced")) if injected is not None else None
    calls = wanted.join(read.select(*on, F.coalesce("state", F.lit("HIT")).alias("told")), on, "left")
    calls = calls.join(forced, on, "left") if forced is not None else calls.withColumn("forced", F.lit(None).cast("string"))
    outcome = F.coalesce("forced", "told", F.lit("TIMEOUT"))
    note = F.when(outcome == "NOT_FOUND", "nothing found in this source; that is no proof that the work doesn't exist")
    sound = read.filter("state is null")
    raw = wanted.join(sound if forced is None else sound.join(forced, on, "left_anti"), on).select("query_id", "query", "adapter", F.posexplode("items").alias("nth", "raw"))
    shaped = None
    for name, source in known.items():
        own = source.candidates(raw.filter(F.col("adapter") == name), ("query_id", "query", "nth", "raw"))
        shaped = own if shaped is None else shaped.unionByName(own)
    return calls.select("query_id", "query", "adapter", outcome.alias("outcome"), note.alias("note")), shaped


def pubmed_bodies(found: DataFrame, summaries: DataFrame) -> DataFrame:
    """JON9: (query, uid, raw) of the ids that a search listed, `found` (query, body), with their summaries (uid, raw)."""
    ids = found.select("query", F.explode(F.from_json(F.get_json_object("body", "$.esearchresult.idlist"), "array<string>")).alias("uid"))
    return ids.join(summaries, "uid").select("query", "uid", "raw")


def scenarios(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC13: (queries, injections) of scenario rows (name, context, adapters, queries); a query is a text or {text, inject_error}.

    `queries` is an array of JSON texts. Rows without a context or queries raise.
    """
    sound = (F.trim(F.coalesce("context", F.lit(""))) != "") & (F.coalesce(F.size("queries"), F.lit(0)) > 0)
    checked = frame.filter(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("illegal scenario: "), F.coalesce("name", F.lit("?"))))))
    each = checked.select("name", "context", "adapters", F.posexplode("queries").alias("nth", "q"))
    text = F.coalesce(F.get_json_object("q", "$.text"), F.col("q"))
    each = each.withColumns({"query": text, "state": F.get_json_object("q", "$.inject_error")})
    queries = each.select("name", "context", "nth", "query", "adapters")
    forced = each.filter("state is not null").select("name", F.explode("adapters").alias("adapter"), "query", "state")
    return queries, forced


def quarantine(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ7: (valid, invalid): a candidate needs a source and a record id that aren't blank."""
    valid = F.coalesce((F.trim("source_adapter") != "") & (F.trim("source_record_id") != ""), F.lit(False))
    return candidates.filter(valid), candidates.filter(~valid)
