"""Keyed upserts of harvested rows and statuses (SNK1, SNK2, AGG5, AGG7, API10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.functions import vocab as V


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, so hot keys are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    won = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return won.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def index_stats(rows: DataFrame, endpoint: str, at: str, as_of: float) -> DataFrame:
    """Per endpoint: rows, oldest, newest, and whether the newest is past the staleness threshold."""
    found = rows.groupBy(endpoint).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("oldest"), F.max(at).alias("newest"))
    return found.withColumn("is_stale", F.coalesce(F.lit(as_of) - F.col("newest") > V.STALE_SECONDS, F.lit(True)))
