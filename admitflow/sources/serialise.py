"""Results as text and JSON (SNK5, SNK6, SNK7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(frame: DataFrame, *columns: str) -> DataFrame:
    """One JSON text per row; nulls are kept as such."""
    return frame.select(F.to_json(F.struct(*(columns or frame.columns)), {"ignoreNullFields": "false"}).alias("json"))


def citation_line(tags: str | None = None) -> Column:
    """authors (year). title. doi:... pmid:..., or ADAPTER:id without either, then tags in brackets."""
    names = F.coalesce(F.when(F.size("authors") > 0, F.array_join("authors", ", ")), F.lit("(no author listed)"))
    given = lambda kind: F.when(F.trim(kind) != "", F.concat(F.lit(f"{kind}:"), kind))
    both = F.concat_ws(" ", given("doi"), given("pmid"))
    identifier = F.when(both != "", both).otherwise(F.concat_ws(":", "adapter", "record_id"))
    year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    line = F.concat(names, F.lit(" ("), year, F.lit("). "), F.coalesce("title", F.lit("")), F.lit(". "), identifier)
    return line if tags is None else F.concat(line, F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, "/"), F.lit("]"))).otherwise(""))


def coverage_line() -> Column:
    """The source padded to 20 characters, then its status and, where there is one, the reason."""
    source = F.when(F.length("source") < 20, F.rpad("source", 20, " ")).otherwise(F.col("source"))
    return F.concat(F.lit("  "), source, F.lit(" "), "status", F.coalesce(F.concat(F.lit(" -- "), F.when(F.col("reason") != "", F.col("reason"))), F.lit("")))
