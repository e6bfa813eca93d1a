"""Asking citation sources (SRC1 to SRC4, JON9): a source's requests, and a Data Source that records their answers.

A SourceAdapter says how one query is asked (`ask`), where an answer holds its records (`items`) and how records become
candidates (`candidates`). Own sources are subclasses; they are registered by handing them to `captured.search`.

`citation_calls` is a Data Source whose rows are a capture (adapter, query, status, failure, body, asked_at): one partition and
one row per (query, adapter), failures included, as a call never raises. Options name the queries and adapters, and nothing
else is asked. Filters are not pushed: Spark 4.1 keeps a pushed filter with the loaded table, so a second use of the same
DataFrame without that filter would silently lose rows (tests hold that it doesn't). `record` asks for a table of queries of any
size. What answers say (states, records) is decided by `captured.search` in the JVM, for recorded and live answers alike.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from admitflow.plans.shared import materialise
from admitflow.sources import projections

CAPTURE = "adapter string, query string, status int, failure string, body string, asked_at double"
#: Most calls of one read; tables of queries go through `record`.
MOST_CALLS = 10_000
#: Records a page, and seconds until a request has timed out.
SIZE, TIMEOUT = 10, 15.0

#: get(url, parameters, timeout) gives (HTTP status, body); OSError (TimeoutError is one) means that nothing came.
Get = Callable[[str, dict, float], tuple[int, str]]


def http_get(url: str, parameters: dict, timeout: float) -> tuple[int, str]:
    """One GET request; an error status is an answer."""
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(parameters)}", timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode("utf-8", "replace")


class SourceAdapter:
    """One source. `extra` are parameters sent with each request, such as a key or a contact address."""

    name = ""
    url = ""
    #: JSON paths of the array of records in an answer, and of a record's id.
    records, record_id = "$", "$.id"

    def __init__(self, size: int = SIZE, timeout: float = TIMEOUT, extra: dict | None = None):
        self.size, self.timeout, self.extra = size, timeout, extra or {}

    def parameters(self, query: str) -> dict:
        raise NotImplementedError

    def ask(self, query: str, get: Get) -> tuple[int, str]:
        """(HTTP status, body) of a query's answer."""
        return get(self.url, {**self.parameters(query), **self.extra}, self.timeout)

    def items(self, body: str) -> Column:
        """The records of a body as an array of JSON texts: null if the field is missing, empty if the source found nothing."""
        return F.from_json(F.get_json_object(body, self.records), "array<string>")

    def candidates(self, raw: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Rows (raw, and columns to keep) as candidates; a record without an id is none, and no field is made up."""
        raise NotImplementedError


class OpenAlex(SourceAdapter):
    name, url, records = "OPENALEX", "https://api.openalex.org/works", "$.results"

    def parameters(self, query: str) -> dict:
        return {"search": query, "per_page": self.size}

    def candidates(self, raw: DataFrame, keep: Sequence[str]) -> DataFrame:
        return projections.openalex(raw, keep=keep)


class Crossref(SourceAdapter):
    name, url, records, record_id = "CROSSREF", "https://api.crossref.org/works", "$.message.items", "$.DOI"

    def parameters(self, query: str) -> dict:
        return {"query": query, "rows": self.size}

    def candidates(self, raw: DataFrame, keep: Sequence[str]) -> DataFrame:
        return projections.crossref(raw, keep=keep)


class PubMed(SourceAdapter):
    """Two requests: a search that lists ids, then their summaries. The first one's answer stands if it has none."""

    name, url, record_id = "PUBMED", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", "$.uid"
    summaries = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esummary.fcgi"

    def parameters(self, query: str) -> dict:
        return {"db": "pubmed", "term": query, "retmode": "json", "retmax": self.size}

    def ask(self, query: str, get: Get) -> tuple[int, str]:
        status, body = super().ask(query, get)
        try:
            ids = json.loads(body)["esearchresult"]["idlist"] if status == 200 else []
        except (ValueError, KeyError, TypeError):
            ids = []
        if not ids:
            return status, body
        return get(self.summaries, {"db": "pubmed", "id": ",".join(map(str, ids)), "retmode": "json", **self.extra}, self.timeout)

    def items(self, body: str) -> Column:
        """Summaries in the order of the uids; a uid without one is an empty record. A search without ids found nothing."""
        by_uid = F.from_json(F.get_json_object(body, "$.result"), "map<string, string>")
        uids = F.from_json(F.get_json_object(body, "$.result.uids"), "array<string>")
        listed = F.transform(uids, lambda u: F.coalesce(F.try_element_at(by_uid, u), F.lit("{}")))
        found = F.when(F.size(listed) > 0, listed).when(F.size(listed) == 0, F.array(F.lit("{}")))
        none = F.size(F.from_json(F.get_json_object(body, "$.esearchresult.idlist"), "array<string>")) == 0
        return F.coalesce(found, F.when(none, F.array().cast("array<string>")))

    def candidates(self, raw: DataFrame, keep: Sequence[str]) -> DataFrame:
        return projections.pubmed(raw, keep=keep)


#: The sources that are asked by HTTP, by name.
SOURCES: dict[str, SourceAdapter] = {a.name: a for a in (OpenAlex(), Crossref(), PubMed())}


def call(adapter: SourceAdapter, query: str, get: Get) -> tuple:
    """A capture's row: a failure is a value, never an exception."""
    at = time.time()
    try:
        status, body, failure = *adapter.ask(query, get), None
    except TimeoutError:
        status, body, failure = None, None, "timeout"
    except OSError as error:  # urllib wraps the timeouts of a connection
        status, body = None, None
        failure = "timeout" if isinstance(getattr(error, "reason", None), TimeoutError) else "connection"
    return adapter.name, query, status, failure, body, at


def _named(path: str) -> object:
    module, name = path.split(":")
    return getattr(importlib.import_module(module), name)


class _Call(InputPartition):
    def __init__(self, adapter: str, query: str):
        super().__init__((adapter, query))


class _Calls(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = list(dict.fromkeys(json.loads(options["queries"])))
        settings = json.loads(options.get("settings", "{}"))
        self.adapters: dict[str, SourceAdapter] = {}
        for given in json.loads(options.get("adapters", json.dumps(list(SOURCES)))):
            kind = type(SOURCES[given]) if given in SOURCES else _named(given)
            self.adapters[kind.name] = kind(**settings.get(kind.name, {}))
        self.get = options.get("get", f"{__name__}:http_get")

    def partitions(self) -> list[_Call]:
        made = [_Call(a, q) for q in self.queries for a in self.adapters]
        if len(made) > MOST_CALLS:
            raise ValueError(f"{len(made)} calls in one read: use record() for a table of queries")
        return made

    def read(self, partition: _Call | None) -> Iterator[tuple]:
        if partition is not None:  # Spark makes one empty partition of none
            adapter, query = partition.value
            yield call(self.adapters[adapter], query, _named(self.get))


class CitationCalls(DataSource):
    """Options: queries (a JSON array of texts), adapters (a JSON array of names or module:Class; all three sources by default),
    get (module:function, see Get) and settings (JSON: constructor arguments by adapter name)."""

    @classmethod
    def name(cls) -> str:
        return "citation_calls"

    def schema(self) -> str:
        return CAPTURE

    def reader(self, schema) -> _Calls:
        return _Calls(self.options)


def calls(spark: SparkSession, queries: Sequence[str], adapters: Sequence[str] = tuple(SOURCES), get: str = f"{__name__}:http_get", settings: dict | None = None) -> DataFrame:
    """The Data Source over some queries; each action on it asks again, so keep what it brings."""
    spark.dataSource.register(CitationCalls)
    asked = spark.read.format("citation_calls").option("queries", json.dumps(list(queries))).option("adapters", json.dumps(list(adapters)))
    return asked.option("get", get).option("settings", json.dumps(settings or {})).load()


def record(wanted: DataFrame, get: Get = http_get, sources: dict[str, SourceAdapter] | None = None) -> DataFrame:
    """A capture of all (query, adapter) rows of `wanted`, each asked once and kept in the shared folder.

    Calls are dealt over as many tasks as the session has shuffle partitions; a lost task asks its own calls again. Rows with
    a null query or of an adapter that isn't among the sources are left out: `captured.search` says what becomes of them.
    """
    known = sources or SOURCES

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for adapter, query in zip(batch["adapter"], batch["query"], strict=True):
                row = pd.DataFrame([call(known[adapter], query, get)], columns=["adapter", "query", "status", "failure", "body", "asked_at"])
                yield row.astype({"status": "Int32"})

    each = wanted.filter(F.col("query").isNotNull() & F.col("adapter").isin(*known)).select("adapter", "query").distinct()
    return materialise(each.mapInPandas(ask, CAPTURE), "capture")
