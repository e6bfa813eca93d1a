"""Folders that driver and executors share, lineage cuts, and joins that survive hot keys."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where the session names no shared folder (tests, local runs).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Most bytes of rows in one Arrow batch between the JVM and Python, unless the session says otherwise.
BATCH_BYTES = 8 << 20
#: Most bytes of a table whose rows are dealt out anew because it lies in fewer files than there are cores.
SPREAD_BYTES = 1 << 30
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where that is unset, a local one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at BATCH_BYTES, where the session has Spark's default (64 MB, held once more by Python)."""
    if spark.conf.get(_BATCH_SETTING) == "67108864b":
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def free_name(base: str, *taken: Iterable[str]) -> str:
    """base, with as many underscores as keep it apart from the names taken (upper or lower case)."""
    used = {name.lower() for names in taken for name in names}
    while base.lower() in used:
        base += "_"
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/admitflow/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that outlives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at path, for rules that spend far more on a row than reading it.

    A small file is often one row group, which Spark reads in one task whatever the split size. Tables of up to
    SPREAD_BYTES in fewer files than there are cores are dealt over all cores; others are read as they lie.
    """
    table, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return table.repartition(cores) if size <= SPREAD_BYTES and len(table.inputFiles()) < cores else table


def skew_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: str, parts: int = 512) -> DataFrame:
    """Left join of `right` (unique `key`; `weight` = rows of that key) that spreads hot keys.

    Keys that own more than 1/parts of all weight number fewer than `parts`, whatever the input: that
    proven bound is what makes broadcasting them safe. Their left rows are answered by the broadcast
    and dealt over `parts` salts in the shuffled join, which all other rows use.
    `right` is read twice and should be materialised. A null key finds nothing.
    """
    columns = [c for c in right.columns if c != key]
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) * parts > F.lit(total)).select(F.col(key).alias("_hot_key"), F.struct(*columns).alias("_hot"))
    side = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    side = side.withColumn("_salt", salt)
    # the right salt is 0, written so that the optimizer keeps it a join key
    cold = right.select(F.col(key).alias("_cold_key"), F.pmod(F.xxhash64(key), F.lit(1)).cast("int").alias("_cold_salt"), F.struct(*columns).alias("_cold"))
    joined = side.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*left.columns, *[found[c].alias(c) for c in columns])
