"""Held-out marks and bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(key: str, folds: int = 4) -> Column:
    """crc32(key as text) mod folds; null for a null key."""
    return F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(folds))


def is_held_out(key: str, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(remainder(key, folds) == fold, F.lit(False))
