"""Order-book depth: snapshots from feed rows, the latest book, best prices, rolling history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import candles


def snapshots(messages: DataFrame) -> DataFrame:
    """symbol, ts_ms, ltp, bids, asks of parsed depth messages (symbol, data). Without a time, or without any level, none."""
    d = lambda name: F.col(f"data.{name}")
    rows = messages.select(
        scalars.resolved_symbol(d("symbol"), "symbol").alias("symbol"), d("ltt").alias("ts_ms"), d("ltp").alias("ltp"),
        scalars.first_filled(d("bids"), d("buy"), d("depth.buy")).alias("bids"), scalars.first_filled(d("asks"), d("sell"), d("depth.sell")).alias("asks"),
    )
    levels = F.coalesce(F.size("bids"), F.lit(0)) + F.coalesce(F.size("asks"), F.lit(0))
    return rows.where(F.col("symbol").isNotNull() & F.col("ts_ms").isNotNull() & (levels > 0))


def latest(books: DataFrame) -> DataFrame:
    return candles.last_rows(books, ["symbol"], ["ts_ms"])


def best(books: DataFrame) -> DataFrame:
    """symbol, ts_ms, best_bid, best_ask: the first level of each side of the latest book, null where a side is empty."""
    return latest(books).select("symbol", "ts_ms", scalars.head("bids")["price"].alias("best_bid"), scalars.head("asks")["price"].alias("best_ask"))


def history(books: DataFrame, seconds: int = 1800) -> DataFrame:
    """Books of each symbol's last seconds, counted from its newest one."""
    newest = books.groupBy("symbol").agg(F.max("ts_ms").alias("_newest"))
    return books.join(newest, "symbol").where(F.col("ts_ms") >= F.col("_newest") - seconds * 1000).drop("_newest")


def log_rows(books: DataFrame) -> DataFrame:
    """symbol, ts_ms, ltp, raw_json: how books are kept in the depth log."""
    return books.select("symbol", "ts_ms", "ltp", F.to_json(F.struct("bids", "asks")).alias("raw_json"))
