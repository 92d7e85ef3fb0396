"""The feed's connection log: classes of events, days that never started, outages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONNECT, LOST = "CONNECT", "DISCONNECTED"
STARTED, AGAIN, NOT_STARTED = "DAY_STARTED", "RECONNECTED", "DAY_NOT_STARTED"


def classified(events: DataFrame) -> DataFrame:
    """events (event, ts_ms, day, ...), each connect named: the first of its day starts it, others come after a loss."""
    order = Window.partitionBy("day", "event").orderBy("ts_ms")
    first = F.row_number().over(order) == 1
    return events.withColumn("event", F.when(F.col("event") == CONNECT, F.when(first, STARTED).otherwise(AGAIN)).otherwise(F.col("event")))


def of_day(events: DataFrame, day) -> DataFrame:
    return events.where(F.col("day") == F.lit(day)).orderBy("ts_ms")


def not_started(trading_days: DataFrame, events: DataFrame) -> DataFrame:
    """event, day: trading days (d) without any event."""
    return trading_days.join(events.select(F.col("day").alias("d")).distinct(), "d", "left_anti").select(F.lit(NOT_STARTED).alias("event"), F.col("d").alias("day"))


def outages(events: DataFrame, seq: str | None = None) -> DataFrame:
    """day, lost_ms, back_ms: each loss and the next connect of its day, null if there was none.

    seq is a column that orders events of one ts_ms; where it leaves ties, or without it, losses come before connects.
    """
    # Read from the day's end: a frame that only grows costs one pass, one that shrinks is gone through again for each row.
    connect = F.col("event").isin(CONNECT, AGAIN, STARTED)
    order = [F.col("ts_ms").desc(), *([F.col(seq).desc()] if seq else []), connect.desc()]
    after = Window.partitionBy("day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    back = F.min(F.when(connect, F.col("ts_ms"))).over(after)
    return events.withColumn("back_ms", back).where(F.col("event") == LOST).select("day", F.col("ts_ms").alias("lost_ms"), "back_ms")
