"""Resumable harvests (SRC6, SRC7, SNK1 to SNK4, API8): a data source that follows resumption tokens, and its upsert sinks.

`oai_pages` reads pages by a function that options name as module:function, called as fetch(url, token) and giving
(HTTP status, body); so it runs against a server, a capture or a test alike. One endpoint is one partition, in batches as in
streams. A failed page is a row with a state: the rows before it stay, and the harvest goes on from the token that failed.

A stream asks one page of each endpoint in a batch. Every answer is kept in a log before its row is handed on: the log says what
comes next, so a batch that is replayed gives the same rows without asking again, and the time between two
requests to a host holds over batches and restarts. An endpoint's offset is (steps, failures in a row, not before): a failure is
a step too, and the next one waits, twice as long each time, up to `attempts` of them. Run sources without speculation: two
copies of a task might both ask.
"""

from __future__ import annotations

import importlib
import json
import threading
import time
import uuid
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from admitflow.sources import local, projections
from admitflow.sources.captured import ENDPOINT_URL
from admitflow.sources.merge_store import MergeStore

SCHEMA = "code string, nth int, token string, next_token string, state string, xml string, attempts int, at double"
#: Fixed value: ten requests a minute at most.
INTERVAL = 6.0
#: Failures in a row after which a stream leaves an endpoint alone, and the longest wait between them in seconds.
ATTEMPTS, LONGEST = 8, 3600.0
RECORDS = "code string, native_id string, raw string, harvested_at double"
STATUSES = "code string, status string, records bigint, synced_at double"


def read_page(status: int | None, body: str | None) -> tuple[str | None, str | None]:
    """(state, next token): a null state for a page with a list of records, NOT_FOUND for noRecordsMatch, else an error state."""
    if status is None or status >= 500:
        return "TIMEOUT", None
    if status in (401, 403, 429):
        return "RATE_LIMITED" if status == 429 else "ACCESS_DENIED", None
    try:
        root = ElementTree.fromstring(body or "") if status == 200 else None
    except ElementTree.ParseError:
        root = None
    if root is None:
        return "PARSER_ERROR", None
    parts = {part.tag.rpartition("}")[2]: part for part in reversed(root)}
    if "error" in parts:
        return "NOT_FOUND" if parts["error"].get("code") == "noRecordsMatch" else "PARSER_ERROR", None
    if "ListRecords" not in parts:
        return "PARSER_ERROR", None
    tokens = [(part.text or "").strip() for part in (*parts["ListRecords"], *root) if part.tag.rpartition("}")[2] == "resumptionToken"]
    return None, (tokens or [""])[0] or None


def is_failure(state: str | None) -> bool:
    return state is not None and state != "NOT_FOUND"


class _Pages:
    def __init__(self, options: dict):
        self.codes = options["codes"].split(",")
        self.module, self.function = options["fetch"].split(":")
        self.budget, self.interval = int(options.get("budget", 1000)), float(options.get("interval", INTERVAL))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def ask(self, code: str, nth: int, token: str | None, attempts: int) -> tuple:
        """One request's row."""
        at = time.time()
        try:
            status, body = getattr(importlib.import_module(self.module), self.function)(ENDPOINT_URL % code, token)
        except (OSError, TimeoutError):
            status, body = None, None
        state, following = read_page(status, body)
        failed = is_failure(state)
        return code, nth, token, following, state, None if failed else body, attempts + 1 if failed else 0, at


class _Batch(DataSourceReader, _Pages):
    """Each endpoint's pages from the first on, until there is no next one, one failed, or the budget is used."""

    def __init__(self, options: dict):
        _Pages.__init__(self, options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(code) for code in self.codes]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token = None
        for nth in range(self.budget):
            if nth and self.interval:
                time.sleep(self.interval)
            row = self.ask(partition.value, nth, token, 0)
            yield row
            if row[4] is not None or row[3] is None:
                return
            token = row[3]


class _Log:
    """The answers of each endpoint by step, in a folder that driver and executors share; an answer that is there stays."""

    def __init__(self, where: str):
        self.system, self.path = fs.FileSystem.from_uri(where)

    def _file(self, code: str, step: int) -> str:
        return f"{self.path}/{code}/{step:08d}"

    def get(self, code: str, step: int) -> tuple | None:
        if step < 0 or self.system.get_file_info(self._file(code, step)).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_file(self._file(code, step)) as f:
            return tuple(json.loads(f.read()))

    def put(self, code: str, step: int, row: tuple) -> tuple:
        draft = f"{self.path}/{code}/.{uuid.uuid4().hex}"
        self.system.create_dir(f"{self.path}/{code}", recursive=True)
        with self.system.open_output_stream(draft) as f:
            f.write(json.dumps(row).encode())
        there = self.get(code, step)
        if there is not None:
            self.system.delete_file(draft)
            return there
        self.system.move(draft, self._file(code, step))
        return row

    def steps(self, code: str) -> int:
        found = self.system.get_file_info(fs.FileSelector(f"{self.path}/{code}", allow_not_found=True))
        return max([int(f.base_name) + 1 for f in found if not f.base_name.startswith(".")], default=0)


class _Stream(DataSourceStreamReader, _Pages):
    def __init__(self, options: dict):
        _Pages.__init__(self, options)
        self.log, self.known = _Log(options["log"]), {}

    def initialOffset(self) -> dict:
        return {code: [0, 0, 0.0] for code in self.codes}

    def _next(self, code: str) -> list:
        """The offset that an endpoint may go to now."""
        step = self.known.setdefault(code, self.log.steps(code))
        while self.log.get(code, step) is not None:
            step += 1
        self.known[code] = step
        last = self.log.get(code, step - 1)
        if last is None:
            return [1, 0, 0.0]
        following, state, attempts, at = last[3], last[4], last[6], last[7]
        wait = self.interval if not attempts else min(max(self.interval, 1e-3) * 2**attempts, max(self.interval, LONGEST))
        due = time.time() >= at + wait
        more = attempts < self.attempts if is_failure(state) else following is not None
        return [step + (1 if more and due else 0), attempts, at + wait]

    def latestOffset(self) -> dict:
        return {code: self._next(code) for code in self.codes}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((code, start.get(code, [0])[0], end[code][0])) for code in end if end[code][0] > start.get(code, [0])[0]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        code, first, last = partition.value
        for step in range(first, last):
            row = self.log.get(code, step)
            if row is None:
                before = self.log.get(code, step - 1)
                failed = before is not None and is_failure(before[4])
                token = None if before is None else before[2] if failed else before[3]
                if before is not None:
                    time.sleep(max(0.0, before[7] + self.interval - time.time()))
                row = self.log.put(code, step, self.ask(code, step, token, before[6] if failed else 0))
            yield tuple(row)


class OaiPages(DataSource):
    """format("oai_pages") with options codes (comma-separated), fetch, budget, interval; for streams also log and attempts."""

    @classmethod
    def name(cls) -> str:
        return "oai_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def records(pages: DataFrame) -> DataFrame:
    """(code, native_id, raw, harvested_at) of the pages' records; records without an id are left out."""
    cut = projections.oai_records(pages.filter("xml is not null").select("code", "at", "xml"))
    raw = F.to_json(F.struct("identifier", "titles", "creators", "dates", "identifiers", "descriptions"))
    return cut.filter("identifier is not null").select("code", F.col("identifier").alias("native_id"), raw.alias("raw"), F.col("at").alias("harvested_at"))


def statuses(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(code, status, records, synced_at) by each endpoint's last page: UNAVAILABLE:state if it failed, else OK, which noRecordsMatch is too."""
    last = pages.groupBy("code").agg(F.max_by("state", "nth").alias("state"), F.max("at").alias("synced_at"))
    counted = found.groupBy("code").agg(F.count_distinct("native_id").alias("records"))
    status = F.when(F.col("state").isNull() | (F.col("state") == "NOT_FOUND"), "OK").otherwise(F.concat(F.lit("UNAVAILABLE:"), "state"))
    return last.join(counted, "code", "left").select("code", status.alias("status"), F.coalesce("records", F.lit(0)).cast("long").alias("records"), "synced_at")


def report(status: DataFrame) -> DataFrame:
    """SNK4: endpoints, those that are OK, those that failed, and records."""
    return status.agg(
        F.count(F.lit(1)).alias("endpoints"), F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.startswith("status", F.lit("UNAVAILABLE:"))).alias("failed"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
    )


class Sinks:
    """What a harvest fills below a folder: records, statuses and, if wanted, the full-text index."""

    def __init__(self, spark: SparkSession, path: str, indexed: bool = False):
        self.records = MergeStore(spark, f"{path}/records", RECORDS, ["code", "native_id"], ["harvested_at"])
        self.statuses = MergeStore(spark, f"{path}/statuses", STATUSES, ["code"], ["synced_at"], buckets=1)
        self.index = local.open_index(spark, f"{path}/index") if indexed else None

    def write(self, pages: DataFrame, writer: str | None = None, batch: int | None = None) -> None:
        """SNK3: rows count even where a later page failed. Each sink takes a writer's batch once, so a batch may come again."""
        pages = pages.persist()
        found = records(pages)
        self.records.upsert(found, writer, batch)
        if self.index is not None:
            self.index.upsert(local.to_index(found), writer, batch)
        self.statuses.upsert(statuses(pages, found), writer, batch)
        pages.unpersist()

    def compact(self, least: int = 8) -> int:
        """Merge what many batches have left in pieces."""
        return sum(s.compact(least) for s in (self.records, self.statuses, self.index) if s is not None)


def sync(spark: SparkSession, path: str, codes: list[str], fetch: str, at: float | None = None, budget: int = 1000, interval: float = INTERVAL, indexed: bool = False) -> DataFrame:
    """Harvest endpoints in one batch into the sinks below path; the report. `at` is recorded as the time, if given."""
    spark.dataSource.register(OaiPages)
    pages = spark.read.format("oai_pages").options(codes=",".join(codes), fetch=fetch, budget=budget, interval=interval).load()
    sinks = Sinks(spark, path, indexed)
    sinks.write(pages if at is None else pages.withColumn("at", F.lit(at)))
    return report(sinks.statuses.read().filter(F.col("code").isin(codes)))


def page_stream(spark: SparkSession, codes: list[str], fetch: str, log: str, interval: float = INTERVAL, attempts: int = ATTEMPTS) -> DataFrame:
    """Pages as a stream; `log` is a folder that driver and executors share, one for each checkpoint."""
    spark.dataSource.register(OaiPages)
    return spark.readStream.format("oai_pages").options(codes=",".join(codes), fetch=fetch, log=log, interval=interval, attempts=attempts).load()


def sync_stream(spark: SparkSession, path: str, codes: list[str], fetch: str, checkpoint: str, interval: float = INTERVAL, attempts: int = ATTEMPTS, indexed: bool = False):
    """The same as a stream, a page of each endpoint a batch; it goes on from where its checkpoint's log ends.

    The sinks know the stream by its query's id, so a new checkpoint is a new writer and loses no batch.
    """
    sinks, started = Sinks(spark, path, indexed), threading.Event()
    names: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        if not started.wait(60):
            raise RuntimeError("the stream's id didn't come")
        sinks.write(batch, names[0], number)

    stream = page_stream(spark, codes, fetch, f"{checkpoint}/pages", interval, attempts).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
    names.append(str(stream.id))
    started.set()
    return stream


def distinct_records(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Records of a stream of pages, each (code, native_id) once within `delay` of the time its page was asked for.

    A copy that comes within that time is dropped, in whatever order they come; so is a record whose page is older than the latest by more than `delay`.
    """
    timed = records(pages).withColumn("asked_at", F.timestamp_seconds("harvested_at"))
    return timed.withWatermark("asked_at", delay).dropDuplicatesWithinWatermark(["code", "native_id"]).drop("asked_at")


def main() -> None:
    """python -m admitflow.streaming.harvest PATH FETCH CODES [BUDGET]: harvest and print the report."""
    import sys

    spark = SparkSession.builder.getOrCreate()
    path, fetch, codes, *budget = sys.argv[1:]
    row = sync(spark, path, codes.split(","), fetch, budget=int(budget[0]) if budget else 1000).first()
    print(json.dumps(row.asDict()))


if __name__ == "__main__":
    main()
