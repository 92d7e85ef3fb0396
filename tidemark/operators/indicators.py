"""Windowed indicators over candles, per symbol and timeframe in order of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def series() -> WindowSpec:
    return Window.partitionBy("symbol", "tf").orderBy("ts")


def register(name: str, fn: Callable[..., DataFrame]) -> None:
    """Adds an indicator: a function from candles (and settings) to rows of symbol, tf, ts and value."""
    _REGISTRY[name] = fn


def compute(name: str, candles: DataFrame, **settings) -> DataFrame:
    return _REGISTRY[name](candles, **settings).withColumn("indicator", F.lit(name))


def true_range(candles: DataFrame) -> DataFrame:
    """candles with tr; a first bar has its own range, as greatest() passes over missing values."""
    before = F.lag("close").over(series())
    return candles.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def directional_movement(candles: DataFrame) -> DataFrame:
    """candles with plus_dm and minus_dm.

    The fall counts by its size whichever way the low went, and is compared with the rise that was kept: equal moves
    leave only the fall. First bars have 0 for both.
    """
    up, down = F.col("high") - F.lag("high").over(series()), F.abs(F.col("low") - F.lag("low").over(series()))
    moved = candles.withColumns({"_up": up, "_down": down})
    plus = F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    moved = moved.withColumn("plus_dm", plus)
    minus = F.when((F.col("_down") > F.col("plus_dm")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)
    return moved.withColumn("minus_dm", minus).drop("_up", "_down")


def full_mean(value: Column | str, n: int) -> Column:
    """Mean of the last n rows, null until there are n values."""
    rows = series().rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(rows) == n, F.avg(value).over(rows))


def adx(candles: DataFrame, di_length: int = 14, adx_smoothing: int = 14) -> DataFrame:
    """symbol, tf, ts, plus_di, minus_di, dx, value, ready. All windows share one sort per series.

    ready tells that the series has enough rows for the indicator to be asked; value follows once the means are full,
    and is null while any of its parts has nothing to divide by.
    """
    rows = directional_movement(true_range(candles)).withColumns({"_tr": full_mean("tr", di_length), "_plus": full_mean("plus_dm", di_length), "_minus": full_mean("minus_dm", di_length)})
    rows = rows.withColumns({"plus_di": F.try_divide(F.col("_plus"), F.col("_tr")) * 100, "minus_di": F.try_divide(F.col("_minus"), F.col("_tr")) * 100})
    rows = rows.withColumn("dx", F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")) * 100)
    needed = max(di_length, adx_smoothing) + 1
    ready = F.count("*").over(Window.partitionBy("symbol", "tf")) >= needed
    return rows.withColumn("value", full_mean("dx", adx_smoothing)).withColumn("ready", ready).select("symbol", "tf", "ts", "plus_di", "minus_di", "dx", "value", "ready")


def last_values(rows: DataFrame, k: int = 3) -> DataFrame:
    """symbol, tf, values: the last k non-null values in order of time, nulls before them if there are fewer.

    Kept as the greatest k by time, not as the whole series: only rows whose rank from the end is at most k are gathered.
    """
    back = Window.partitionBy("symbol", "tf").orderBy(F.desc("ts"))
    some = rows.where("ready and value is not null").withColumn("_rank", F.row_number().over(back)).where(F.col("_rank") <= k)
    got = some.groupBy("symbol", "tf").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("_got"))
    keys = rows.select("symbol", "tf").distinct().join(got, ["symbol", "tf"], "left")
    padded = F.concat(F.array_repeat(F.lit(None).cast("double"), k), F.coalesce("_got", F.array().cast("array<double>")))
    return keys.select("symbol", "tf", F.slice(padded, -k, k).alias("values"))


def latest_value(rows: DataFrame) -> DataFrame:
    """symbol, tf, ts, value, ready: each series' newest row."""
    return rows.groupBy("symbol", "tf").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"), F.max_by("ready", "ts").alias("ready"))


register("adx", adx)
