"""Exact dedup against a persistent digest index that is bucketed and sorted by hash.

The index is a folder of (digest, keep_id, rows, batch): the SHA-256 of each text seen so far, the id that stays, how
many of its batch's rows had it, and the batch that brought it. New rows are reduced to their digests, these meet the
index in a sort-merge anti-join (the index side isn't shuffled, as its buckets are), and what is new is appended.
Only built-in expressions run; texts are hashed once, in the scan, and never shuffled by `deduplicate`.

A call's rows go through the index in `batches` parts, the largest ids first, so that of equal texts the largest id is
the first to come. A call under a batch name that the index holds already appends nothing and returns what it
returned before: a job that died between the append and its result is simply run again.

Defined cases: a null text counts as empty; texts are equal when identical as they are; of equal texts in a
call the row with the largest id stays (a null id only if no row has one); rows that repeat both id and
text are one document, of which one row stays; a text the index holds from an earlier call stays with that one,
so all its later rows go. Only id and text are read, so extra columns can't clash; an id column that is named like a
result column gets an underscore in the result. Empty tables give empty results and an empty index.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from admitflow.plans.shared import fresh_path, free_name, materialise, skew_lookup

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, key, copies): the distinct ids and 32-byte digests of docs, with how often each pair occurs."""
    hashed = docs.select(F.col(f"`{key}`").alias("key"), _digest(text).alias("digest"))
    return hashed.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("copies"))


class DigestIndex:
    """The index at `path`, made there if need be; without a path a temporary one, which `drop` removes.

    `buckets` and the ids' type are fixed when it is made (aim at 1 GB a bucket: 20 million texts).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32, key_type: str = "bigint"):
        self.spark, self.temporary = spark, path is None
        self.path = (path or fresh_path(spark, "digest-index")).rstrip("/")
        about = f"{self.path}/_about"  # hidden from the table's own scans
        spark.createDataFrame([(buckets, key_type)], "buckets int, key_type string").coalesce(1).write.mode("ignore").parquet(about)
        self.buckets, key_type = spark.read.parquet(about).first()
        self.table = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        at = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {key_type}, rows BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}'"
        )
        self._mark([], "ignore")
        spark.catalog.refreshTable(self.table)

    def _done(self) -> DataFrame:
        """(label, batch) of the batches that are whole: a batch's files may be committed in part, its line here is one file."""
        return self.spark.read.schema("label string, batch string").parquet(f"{self.path}/_done")

    def read(self) -> DataFrame:
        """digest, keep_id, rows, batch of the batches that are whole."""
        # a line for each batch ever added, of which Spark broadcasts as many as its threshold allows
        return self.spark.table(self.table).withColumnRenamed("batch", "label").join(self._done(), "label").select("digest", "keep_id", "rows", "batch")

    def unseen(self, groups: DataFrame, batch: str) -> DataFrame:
        """The rows of groups whose digest no other batch brought, by a sort-merge anti-join in the index's buckets."""
        held = self.read().filter(F.col("batch") != batch).select("digest")
        return groups.repartition(self.buckets, "digest").join(held.hint("merge"), "digest", "left_anti")

    def add(self, pairs: DataFrame, batch: str) -> None:
        """Append the texts of `digests` rows that are new, one sorted file a bucket; a batch that is held already isn't added again.

        Rows count once the batch's line is written, so what a broken attempt has left is never read.
        """
        if self._done().filter(F.col("batch") == batch).limit(1).count():
            return
        groups = pairs.groupBy("digest").agg(F.max("key").alias("keep_id"), F.sum("copies").alias("rows"))
        new, label = self.unseen(groups, batch).sortWithinPartitions("digest"), uuid.uuid4().hex
        new.select("digest", "keep_id", "rows", F.lit(label).alias("batch")).write.insertInto(self.table)
        self._mark([(label, batch)], "append")

    def _mark(self, lines: list[tuple[str, str]], mode: str) -> None:
        self.spark.createDataFrame(lines, "label string, batch string").coalesce(1).write.mode(mode).parquet(f"{self.path}/_done")

    def drop(self) -> None:
        """Forget the index and delete its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _parts(pairs: DataFrame, batches: int) -> list[DataFrame]:
    """pairs in parts of about equal numbers of rows, the largest keys first; keys that aren't numbers are one part."""
    if batches < 2 or not isinstance(pairs.schema["key"].dataType, NumericType):
        return [pairs]
    shares = ", ".join(str(i / batches) for i in range(batches - 1, 0, -1))
    cuts = pairs.select(F.expr(f"percentile_approx(key, array({shares}))")).first()[0]
    cuts = list(dict.fromkeys(cuts or []))
    if not cuts:
        return [pairs]
    first = pairs.filter(F.col("key") > cuts[0])
    middle = [pairs.filter((F.col("key") <= high) & (F.col("key") > low)) for high, low in zip(cuts, cuts[1:])]
    return [first, *middle, pairs.filter(F.col("key").isNull() | (F.col("key") <= cuts[-1]))]


def _settled(docs: DataFrame, index: DigestIndex | None, key: str, text: str, batch: str | None, batches: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, table): docs' digests, and per digest keep_id, rows in docs, and whether it came by this call."""
    kind = docs.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType.simpleString()
    index = index or DigestIndex(docs.sparkSession, key_type=kind)
    batch = batch or uuid.uuid4().hex
    pairs = materialise(digests(docs, key, text), "digests")
    own = []
    for i, part in enumerate(_parts(pairs, batches)):
        own.append(f"{batch}/{i}")
        index.add(part, own[-1])
    sizes = pairs.groupBy("digest").agg(F.sum("copies").alias("rows")).repartition(index.buckets, "digest")
    held = index.read().select("digest", "keep_id", F.col("batch").isin(own).alias("mine"))
    table = materialise(sizes.join(held.hint("merge"), "digest"), "settled")
    if index.temporary:
        index.drop()
    return pairs, table


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text", batch: str | None = None, batches: int = 2) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256; docs are added to the index (a temporary one by default).

    group_size counts docs' own rows. Only rows whose text came by this call, under their id, are kept.
    """
    pairs, table = _settled(docs, index, key, text, batch, batches)
    found = skew_lookup(pairs, table, "digest", "rows", "key")
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    stays = F.col("mine") & F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return each.select(F.col("key").alias(free_name(key, RESULT)), "keep_id", F.col("rows").alias("group_size"), stays.alias("kept"), digest)


def keep_first(docs: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text", batch: str | None = None, batches: int = 2) -> DataFrame:
    """The whole rows of docs that stay, with all their columns.

    The rows join the winners on digest and id together, so a text with many copies is spread by its ids.
    """
    _, table = _settled(docs, index, key, text, batch, batches)
    digest_, keep_, nth_ = (free_name(name, docs.columns) for name in ("_digest", "_keep", "_nth"))
    as_text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    wins = table.filter("mine").select(F.col("digest").alias(digest_), as_text("keep_id").alias(keep_))
    names = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(*names, _digest(text).alias(digest_), as_text(key).alias(keep_))
    kept = hashed.join(wins, [digest_, keep_], "left_semi")
    nth = F.row_number().over(Window.partitionBy(digest_, keep_).orderBy(digest_))
    return kept.withColumn(nth_, nth).filter(F.col(nth_) == 1).select(*names)
