"""OHLCV candles from ticks, and latest values. A tick table has symbol, ts, ltp, qty and seq (its order among equal times)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import session, timeframes, trading_days

CANDLE_COLUMNS = ["symbol", "tf", "ts", "open", "high", "low", "close", "volume"]


def with_buckets(ticks: DataFrame, labels: Iterable[str]) -> DataFrame:
    """A row per tick and timeframe, ts replaced by its bucket. One scan feeds all timeframes."""
    widths = F.array(*[F.struct(F.lit(t).alias("tf"), F.lit(timeframes.seconds(t)).alias("width")) for t in labels])
    rows = ticks.withColumn("_tf", F.explode(widths))
    return rows.withColumns({"tf": F.col("_tf.tf"), "bucket": session.bucket("ts", F.col("_tf.width"))}).drop("_tf")


def first_last() -> tuple[Column, Column]:
    order = F.struct("ts", "seq")
    return F.min_by("ltp", order), F.max_by("ltp", order)


def ohlcv(ticks: DataFrame, labels: Iterable[str], calendar: DataFrame | None = None, session_only: bool = True) -> DataFrame:
    """Candles per symbol and timeframe. Ticks without symbol, time or price make none; a missing quantity counts as 0.

    With a calendar only trading days count, without one all weekdays; session_only=False keeps ticks outside the
    session, earlier ones in the first bucket. Aggregation begins in each task, so busy symbols are no skew.
    """
    valid = ticks.where("symbol is not null and symbol <> '' and ts is not null and ltp is not null")
    if session_only:
        valid = trading_days.only_sessions(valid, calendar)
    opens, closes = first_last()
    rows = with_buckets(valid.withColumn("qty", F.coalesce("qty", F.lit(0.0))), labels)
    bars = rows.groupBy("symbol", "tf", "bucket").agg(opens.alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), closes.alias("close"), F.sum("qty").alias("volume"))
    return bars.withColumnRenamed("bucket", "ts").select(*CANDLE_COLUMNS)


def closed(candles: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Candles whose bucket ended before the one that holds as_of."""
    width = timeframes.seconds_column("tf")
    return candles.where(F.col("ts") < session.bucket(F.lit(as_of).cast("timestamp_ntz"), width))


def latest(ticks: DataFrame, order: str = "seq") -> DataFrame:
    """symbol, ltp: the price that arrived last, also from ticks without a time."""
    return ticks.where("symbol is not null and ltp is not null").groupBy("symbol").agg(F.max_by("ltp", order).alias("ltp"))


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as one aggregate without sorting groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def retained(df: DataFrame, seconds: Column | int, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows not older than seconds before the newest of their key, that age included."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    width = F.lit(seconds) if isinstance(seconds, int) else seconds
    age = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), width.cast("decimal(18,6)"))
    return df.join(newest, keys).where(F.col(ts) >= F.col("_newest") - age).drop("_newest")


def retention_seconds(label: str, retention_minutes: int = 30, min_candles: int = 15) -> int:
    """How much history a timeframe needs: the window, or min_candles bars if that is longer."""
    return max(retention_minutes * 60, min_candles * timeframes.seconds(label))
