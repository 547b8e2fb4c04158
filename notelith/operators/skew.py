"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000
MAX_HOT_KEYS = 10_000


def join_by_key(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with one row per key, whose ``size`` says how many rows the key has (null keys meet nothing).

    Keys with more than max(hot_rows, n_rows / MAX_HOT_KEYS) rows number MAX_HOT_KEYS at most, so they are broadcast;
    the rows of all other keys are shuffled to them. No task gets a whole hot key.
    """
    hot_from = max(hot_rows, n_rows // MAX_HOT_KEYS)
    hot = groups.where(F.col(size) > hot_from)
    cold = groups.where(F.col(size) <= hot_from)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)
