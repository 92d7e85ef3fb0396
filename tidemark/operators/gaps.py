"""Which candles should exist, which are missing, and roll-up of minutes where all of them are there."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import CLOSE, OPEN
from tidemark.functions import session, timeframes

KEY = ["symbol", "tf", "ts"]


def expected(symbols: DataFrame, days: DataFrame, labels: Iterable[str], start: dt.datetime | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """symbol, tf, ts: every bucket of the session on each of days (d), for each of symbols (symbol).

    start: the earliest bucket; as_of: only buckets closed by then. Symbols and days are short lists that are paired on
    purpose; slots come from an expression, so the result is generated where it is used. Days are a calendar's, some
    hundred a year at any size of the data, and go to every task.
    """
    spans = F.array(*[F.struct(F.lit(t).alias("tf"), F.sequence(F.lit(0), F.lit(CLOSE - OPEN - 1), F.lit(timeframes.seconds(t))).alias("slots")) for t in labels])
    rows = symbols.select("symbol").distinct().join(F.broadcast(days.select("d").distinct())).select("symbol", "d", F.explode(spans).alias("s"))
    rows = rows.select("symbol", F.col("s.tf").alias("tf"), "d", F.explode("s.slots").alias("slot"))
    rows = rows.select("symbol", "tf", (F.col("d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("slot") + OPEN).cast("decimal(18,6)"))).alias("ts"))
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if as_of is not None:
        rows = rows.where(F.col("ts") < session.bucket(F.lit(as_of).cast("timestamp_ntz"), timeframes.seconds_column("tf")))
    return rows


def missing(wanted: DataFrame, candles: DataFrame) -> DataFrame:
    return wanted.join(candles.select(*KEY), KEY, "left_anti")


def earliest_missing(gaps: DataFrame) -> DataFrame:
    """symbol, ts: where a scan for this symbol has to begin."""
    return gaps.groupBy("symbol").agg(F.min("ts").alias("ts"))


def residual_counts(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("symbol", "tf").agg(F.count("*").alias("n_missing"))


def rolled_up(minutes: DataFrame, labels: Iterable[str], truncate_at_close: bool = False) -> DataFrame:
    """Candles of longer timeframes from one-minute ones, only where every minute of the bucket is there.

    Timeframes that are no whole number of minutes have none. A session's last bucket that the close cuts short can
    only be complete with truncate_at_close.
    """
    whole = [t for t in labels if timeframes.seconds(t) > 60 and timeframes.seconds(t) % 60 == 0]
    source = minutes.where("tf = '1m'").drop("tf")
    if not whole:
        return minutes.where(F.lit(False))
    widths = F.array(*[F.struct(F.lit(t).alias("tf"), F.lit(timeframes.seconds(t)).alias("width")) for t in whole])
    rows = source.where(session.in_hours("ts")).withColumn("t", F.explode(widths)).withColumn("bucket", session.bucket("ts", F.col("t.width")))
    bars = rows.groupBy("symbol", F.col("t.tf").alias("tf"), F.col("t.width").alias("width"), "bucket").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count_distinct("ts").alias("n"),
    )
    room = F.least(F.col("width"), F.lit(CLOSE) - session.second_of_day("bucket")) if truncate_at_close else F.col("width")
    return bars.where(F.col("n") * 60 == room).select("symbol", "tf", F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume")


def coverage(wanted_keys: DataFrame, candles: DataFrame, gaps: DataFrame, min_candles: int = 15) -> DataFrame:
    """symbol, tf, n_candles, n_missing, status for each of wanted_keys (symbol, tf)."""
    have = candles.groupBy("symbol", "tf").agg(F.count("*").alias("n_candles"))
    rows = wanted_keys.select("symbol", "tf").distinct().join(have, ["symbol", "tf"], "left").join(residual_counts(gaps), ["symbol", "tf"], "left")
    rows = rows.select("symbol", "tf", F.coalesce("n_candles", F.lit(0)).alias("n_candles"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))
    status = F.when(F.col("n_candles") < min_candles, "INSUFFICIENT").when(F.col("n_missing") > 0, "DATA MISSING").otherwise("OK")
    return rows.withColumn("status", status)


def overall(report: DataFrame) -> DataFrame:
    """One row: all_ok, any_missing, any_insufficient."""
    return report.agg(F.bool_and(F.col("status") == "OK").alias("all_ok"), F.bool_or(F.col("status") == "DATA MISSING").alias("any_missing"), F.bool_or(F.col("status") == "INSUFFICIENT").alias("any_insufficient"))
