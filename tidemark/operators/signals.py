"""Breakouts of the previous candle: the first tick beyond its high or low, once per candle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars, session, timeframes
from tidemark.functions import trading_days as calendar_days
from tidemark.operators import candles as candle_ops


def previous_levels(candles: DataFrame) -> DataFrame:
    """candles with ref_ts, ref_high, ref_low of the candle before, whatever gap lies between."""
    series = Window.partitionBy("symbol", "tf").orderBy("ts")
    return candles.withColumns({f"ref_{c}": F.lag(c).over(series) for c in ("ts", "high", "low")})


def breakouts(ticks: DataFrame, reference_tf: str = "1m", calendar: DataFrame | None = None, exchange: str = "NSE") -> DataFrame:
    """symbol, exchange, ref_ts, ts, seq, side, price: at most one signal per symbol and reference candle.

    Every tick is compared with the last candle that closed before its own bucket. That candle is the same for a whole
    bucket, so it is looked up by equality on the bucket, not as of each tick. The first breach on either side counts.
    """
    valid = calendar_days.only_sessions(ticks.where("symbol is not null and ts is not null and ltp is not null"), calendar)
    bars = candle_ops.ohlcv(valid, [reference_tf], calendar)
    levels = previous_levels(bars).where("ref_ts is not null").select("symbol", F.col("ts").alias("bucket"), "ref_ts", "ref_high", "ref_low")
    rows = valid.withColumn("bucket", session.bucket("ts", timeframes.seconds(reference_tf))).join(levels, ["symbol", "bucket"])
    hits = rows.withColumn("side", scalars.breakout_side("ltp", "ref_high", "ref_low")).where("side is not null")
    first = hits.groupBy("symbol", "ref_ts").agg(F.min(F.struct("ts", "seq", "side", F.col("ltp").alias("price"))).alias("s"))
    return first.select("symbol", F.lit(exchange).alias("exchange"), "ref_ts", "s.ts", "s.seq", "s.side", "s.price")
