"""Keyed tables in a folder that grow by pieces (SNK1, SNK2): a write costs what it writes, readers merge, compaction tidies.

`Pieces` is the record of what a folder holds: for each table and bucket the pieces that are live, in order, and for each
writer its last batch. It is one small JSON file per version, and a version becomes valid by a rename that fails
where the name is taken, so writers of any number see each other, and a crash at any step leaves the version
before. Data that no version names are never read; `vacuum` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the store's own in its files; callers' columns may not be called so.
ENTRY, DELETED, BUCKET = "_entry", "_deleted", "_bucket"
EMPTY = {"seq": 0, "writers": {}, "pieces": {}, "totals": {}}


class Conflict(Exception):
    """Another writer changed what this one started from."""


class Pieces:
    """Versions of a folder's state; each is a whole one, so a reader opens one file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self):
        return self._at(self.path).getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        where, system = self._at(f"{self.path}/{folder}"), self._system()
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def state(self) -> dict:
        """The last version; one that is expired under the reader's eyes is looked up again."""
        for _ in range(5):
            versions = [n for n in self.names("versions") if n.isdigit()]
            if not versions:
                return json.loads(json.dumps(EMPTY))
            try:
                stream = self._system().open(self._at(f"{self.path}/versions/{versions[-1]}"))
            except Exception as e:
                if "FileNotFound" in str(e):
                    continue
                raise
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        raise RuntimeError(f"the versions of {self.path} change faster than they can be read")

    def _put(self, state: dict) -> bool:
        """Make `state` the version of its number; false if there is one already."""
        draft = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._system().create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._system().mkdirs(self._at(f"{self.path}/versions"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._at(f"{self.path}/versions/{state['seq']:012d}"), none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._system().delete(draft, False)
            return False
        return True

    def commit(self, change: Callable[[dict], dict | None], tries: int = 100) -> bool:
        """Apply `change` to the last version until no other writer comes between; a change that gives null is none."""
        for _ in range(tries):
            now = self.state()
            then = change(json.loads(json.dumps(now)))
            if then is None:
                return False
            then["seq"] = now["seq"] + 1
            if self._put(then):
                return True
        raise Conflict(f"no turn among the writers of {self.path} in {tries} tries")

    def fresh_entry(self) -> str:
        """A name for new data, which sorts behind those of all versions so far."""
        return f"{self.state()['seq'] + 1:012d}-{uuid.uuid4().hex}"

    def done(self, writer: str, batch: int | None) -> bool:
        return batch is not None and self.state()["writers"].get(writer, -1) >= batch

    def write(self, rows: DataFrame, entry: str, table: str, bucket: Column, within: list[str] | None = None, dealt: bool = False) -> list[str]:
        """Write rows as a piece of the table in each bucket that they touch, sorted by `within`; the buckets. `dealt` rows stay in their tasks."""
        rows = rows.withColumn(BUCKET, bucket)
        # few files a bucket, however many tasks there are; large buckets are split at run time
        rows = rows if dealt else rows.hint("rebalance", F.col(BUCKET))
        rows = rows.sortWithinPartitions(BUCKET, *within) if within else rows
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{entry}/{table}")
        return [n.split("=")[1] for n in self.names(f"data/{entry}/{table}") if n.startswith(f"{BUCKET}=")]

    def paths(self, state: dict, table: str, buckets: list[str] | None = None) -> list[str]:
        held = state["pieces"].get(table, {})
        return [f"{self.path}/data/{e}/{table}/{BUCKET}={b}" for b, entries in held.items() if buckets is None or b in buckets for e in entries]

    def load(self, state: dict, table: str, schema, buckets: list[str] | None = None) -> DataFrame:
        """All rows of a table's live pieces, or of some buckets'."""
        paths = self.paths(state, table, buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 3) -> int:
        """Remove data that none of the last `keep` versions names, drafts and older versions. No writer may be at work: its data have no version yet."""
        system, versions = self._system(), [n for n in self.names("versions") if n.isdigit()]
        live = set()
        for name in versions[-keep:]:
            stream = system.open(self._at(f"{self.path}/versions/{name}"))
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["pieces"]
            stream.close()
            live |= {e for table in held.values() for entries in table.values() for e in entries}
        gone = [f"data/{n}" for n in self.names("data") if n not in live] + [f"versions/{n}" for n in versions[:-keep]] + [f"drafts/{n}" for n in self.names("drafts")]
        for name in gone:
            system.delete(self._at(f"{self.path}/{name}"), True)
        return len(gone)


def added(state: dict, entry: str, tables: dict[str, list[str]], writer: str | None = None, batch: int | None = None, totals: dict[str, float] | None = None) -> dict:
    """The state with an entry's pieces behind those that are there."""
    for table, buckets in tables.items():
        for b in buckets:
            state["pieces"].setdefault(table, {}).setdefault(b, []).append(entry)
    if writer is not None and batch is not None:
        state["writers"][writer] = batch
    for name, value in (totals or {}).items():
        state["totals"][name] = state["totals"].get(name, 0) + value
    return state


def replaced(state: dict, entry: str, table: str, merged: dict[str, list[str]], written: list[str]) -> dict | None:
    """The state with `merged` pieces of each bucket replaced by one; null if any of them is gone, as another compaction was faster."""
    held = state["pieces"].get(table, {})
    for b, old in merged.items():
        if held.get(b, [])[: len(old)] != old:
            return None
        held[b] = ([entry] if b in written else []) + held[b][len(old) :]
        if not held[b]:
            del held[b]
    return state


class MergeStore:
    """The last row of each key, by `order`, then by what was written last.

    A batch is written as a piece of each bucket that its keys fall into; nothing else is read or written. A writer's batch
    numbers only rise, and each is taken once: writers (a stream's checkpoint, a batch job) are named, so a new one starts from 0
    without a loss. Null keys are keys too; an empty batch is a batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], buckets: int = 32):
        self.spark, self.keys, self.order, self.buckets, self.pieces = spark, keys, order, buckets, Pieces(spark, path)
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, {ENTRY} string, {DELETED} boolean"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _latest(self, rows: DataFrame) -> DataFrame:
        """An aggregate, so hot keys are combined before the shuffle."""
        rest = [c for c in rows.columns if c not in self.keys]
        won = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order, ENTRY)).alias("_row"))
        return won.select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in rest])

    def _append(self, rows: DataFrame, deleted: bool, writer: str | None, batch: int | None) -> bool:
        writer = writer or "batch"
        if self.pieces.done(writer, batch):
            return False
        entry = self.pieces.fresh_entry()
        own = self._latest(rows.select(*self.columns, F.lit(entry).alias(ENTRY), F.lit(deleted).alias(DELETED)))
        written = self.pieces.write(own, entry, "rows", self._bucket())

        def change(state: dict) -> dict | None:
            taken = batch is not None and state["writers"].get(writer, -1) >= batch
            return None if taken else added(state, entry, {"rows": written}, writer, batch)

        return self.pieces.commit(change)

    def upsert(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Whether the rows were taken: a writer's batch that is stored already changes nothing."""
        return self._append(rows, False, writer, batch)

    def delete(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Remove keys as of the rows' `order`; other columns count for nothing, and an older row that comes later stays away."""
        return self._append(rows, True, writer, batch)

    def _all(self, state: dict) -> DataFrame:
        """The last row of each key, tombstones too. Buckets of one piece are as they lie: a piece has each key once."""
        held = state["pieces"].get("rows", {})
        one, more = ([b for b, e in held.items() if (len(e) == 1) == single] for single in (True, False))
        return self.pieces.load(state, "rows", self.schema, one).unionByName(self._latest(self.pieces.load(state, "rows", self.schema, more)))

    def read(self) -> DataFrame:
        return self._all(self.pieces.state()).filter(f"NOT {DELETED}").select(*self.columns)

    def compact(self, least: int = 4) -> int:
        """Merge the buckets of `least` pieces or more, and only those, into one piece each; how many there were."""
        state = self.pieces.state()
        merged = {b: e for b, e in state["pieces"].get("rows", {}).items() if len(e) >= least}
        if not merged:
            return 0
        # named like the newest piece it holds, so that pieces written meanwhile stay behind it
        entry = f"{max(e[-1] for e in merged.values())}-{uuid.uuid4().hex}"
        rows = self._latest(self.pieces.load(state, "rows", self.schema, list(merged)))
        written = self.pieces.write(rows, entry, "rows", self._bucket())
        return len(merged) if self.pieces.commit(lambda now: replaced(now, entry, "rows", merged, written)) else 0
