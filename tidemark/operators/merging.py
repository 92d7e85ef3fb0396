"""Combining candle tables by key: stored ones win, or newer ones do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.candles import CANDLE_COLUMNS

KEY = ["symbol", "tf", "ts"]
VALUES = [c for c in CANDLE_COLUMNS if c not in KEY]


def ranked(tables: list[DataFrame], keep_source: bool = False) -> DataFrame:
    """One candle per key from the first table that has it, as an aggregate: no window, no sort of groups.

    Rows without ts are left out. Within a table a key's rows are alike to the order of tables; ties go to the least
    values, so that results do not depend on the partitioning.
    """
    parts = [t.where("ts is not null").select(*KEY, F.lit(k).alias("source_tier"), *VALUES) for k, t in enumerate(tables)]
    rows = best(reduce(DataFrame.unionByName, parts))
    return rows if keep_source else rows.drop("source_tier")


def best(rows: DataFrame) -> DataFrame:
    """One candle per key of rows with source_tier: that of the least tier."""
    found = rows.groupBy(*KEY).agg(F.min(F.struct("source_tier", *VALUES)).alias("_best"))
    return found.select(*KEY, *[f"_best.{v}" for v in VALUES], "_best.source_tier")


def existing_wins(existing: DataFrame, new: DataFrame) -> DataFrame:
    return ranked([existing, new])


def newest_wins(rows: DataFrame, version: str = "version") -> DataFrame:
    """One candle per key: that of the highest version."""
    best = rows.where("ts is not null").groupBy(*KEY).agg(F.max(F.struct(version, *VALUES)).alias("_best"))
    return best.select(*KEY, *[f"_best.{v}" for v in VALUES])


def only_wanted(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored candles for just the buckets that are asked for."""
    return history.join(wanted.select(*KEY), KEY, "left_semi")
