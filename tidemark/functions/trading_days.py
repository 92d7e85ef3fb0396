"""The trading calendar: which days trade, when the next session opens, how far back to load.

A calendar is a small table of dates, each a holiday or a special opening; its size depends on years, not on data.
Special openings outrank holidays, and those outrank weekdays. All functions take the moment they are asked about.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CLOSE, OPEN, PRE_CONNECT
from tidemark.functions import session

HOLIDAY, SPECIAL = "holiday", "special_open"


def flags(calendar: DataFrame) -> DataFrame:
    """d, special, holiday: one row per date that the calendar names."""
    return calendar.groupBy("d").agg(F.max(F.col("kind") == SPECIAL).alias("special"), F.max(F.col("kind") == HOLIDAY).alias("holiday"))


def with_trading_day(df: DataFrame, calendar: DataFrame, ts: str = "ts", name: str = "is_trading_day") -> DataFrame:
    """df with a flag: whether the date of ts trades."""
    named = F.broadcast(flags(calendar).withColumnRenamed("d", "_d"))  # at most a row per day of the calendar's years
    joined = df.withColumn("_on", F.col(ts).cast("date")).join(named, F.col("_on") == F.col("_d"), "left")
    trades = F.when(F.coalesce("special", F.lit(False)), True).when(F.coalesce("holiday", F.lit(False)), False).otherwise(F.weekday("_on") < 5)
    return joined.withColumn(name, trades).drop("_on", "_d", "special", "holiday")


def with_market_open(df: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """df with is_open (in the session) and is_connectable (from shortly before it)."""
    df = with_trading_day(df, calendar, ts, "_trades")
    return df.withColumns({
        "is_open": F.col("_trades") & session.in_hours(ts),
        "is_connectable": F.col("_trades") & session.in_hours(ts, PRE_CONNECT, CLOSE),
    }).drop("_trades")


def only_sessions(df: DataFrame, calendar: DataFrame | None, ts: str = "ts") -> DataFrame:
    """Rows in session hours of trading days; without a calendar, of weekdays."""
    if calendar is None:
        return df.where(session.in_session(ts))
    return with_trading_day(df.where(session.in_hours(ts)), calendar, ts, "_trades").where("_trades").drop("_trades")


def days(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """d: all dates from first to last."""
    dates = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day")) if first <= last else F.array().cast("array<date>")
    return spark.range(1).select(F.explode(dates).alias("d"))


def trading_days(spark: SparkSession, calendar: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    return with_trading_day(days(spark, first, last), calendar, "d").where("is_trading_day").select("d")


def lookback_days(min_candles: int, longest_tf: int) -> int:
    """Trading days that hold min_candles of the longest timeframe, and one more."""
    return math.ceil(min_candles * longest_tf / 60 / ((CLOSE - OPEN) / 60)) + 1


def lookback_start(spark: SparkSession, calendar: DataFrame, today: dt.date, min_candles: int, longest_tf: int) -> DataFrame:
    """start: the open of the trading day that is lookback_days() before today."""
    n = lookback_days(min_candles, longest_tf)
    # Each date that the calendar names can cost a trading day, each week has five others.
    named = calendar.select("d").distinct().where(F.col("d") < F.lit(today)).count()
    back = trading_days(spark, calendar, today - dt.timedelta(days=7 * (-(-(n + named) // 5) + 1)), today - dt.timedelta(days=1))
    chosen = back.orderBy(F.desc("d")).limit(n)
    return chosen.agg(F.min("d").alias("d")).select(_at("d", OPEN).alias("start"))


def _at(day: Column | str, secs: int) -> Column:
    day = F.col(day) if isinstance(day, str) else day
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(secs))


def next_open(spark: SparkSession, calendar: DataFrame, now: dt.datetime, opens: int = OPEN, horizon_days: int | None = None) -> DataFrame:
    """opens_at, seconds: the first opening after now, and how long until then.

    Without a horizon there always is one: in the week after the last date that the calendar names, weekdays trade.
    """
    last = now.date() + dt.timedelta(days=horizon_days or 0)
    if horizon_days is None:
        known = calendar.agg(F.max("d")).first()[0]
        last = max(now.date(), known or now.date()) + dt.timedelta(days=8)
    ahead = trading_days(spark, calendar, now.date(), last).select(_at("d", opens).alias("opens_at"))
    wait = F.unix_millis(F.col("opens_at").cast("timestamp")) - F.unix_millis(F.lit(now).cast("timestamp_ntz").cast("timestamp"))
    return ahead.where(F.col("opens_at") > F.lit(now).cast("timestamp_ntz")).agg(F.min("opens_at").alias("opens_at")).select("opens_at", F.greatest(wait / 1000, F.lit(0.0)).alias("seconds"))


def seconds_until_pre_connect(spark: SparkSession, calendar: DataFrame, now: dt.datetime) -> DataFrame:
    """As next_open(), for the moment at which feeds connect, at most 15 days ahead."""
    return next_open(spark, calendar, now, PRE_CONNECT, 15)


def seconds_until_close(now: dt.datetime) -> float:
    return max(0.0, CLOSE - (now - now.replace(hour=0, minute=0, second=0, microsecond=0)).total_seconds())


def refreshed(calendar: DataFrame, fetched: DataFrame, today: dt.date) -> DataFrame:
    """The calendar with fetched holidays (d) in place of those from today on; past ones and special openings stay."""
    kept = calendar.where((F.col("kind") == SPECIAL) | (F.col("d") < F.lit(today)))
    new = fetched.where(F.col("d") >= F.lit(today)).select("d", F.lit(HOLIDAY).alias("kind"))
    return kept.union(new).distinct().orderBy("kind", "d")


def is_stale(calendar: DataFrame, refreshed_on: dt.date | None, today: dt.date, most_days: int = 7) -> bool:
    """Whether the calendar was never refreshed, not for some days, or knows no holiday to come."""
    if refreshed_on is None or (today - refreshed_on).days > most_days:
        return True
    return calendar.where((F.col("kind") == HOLIDAY) & (F.col("d") >= F.lit(today))).isEmpty()
