"""Gap repair from ranked sources: stored candles, ticks, historical candles, roll-up of minutes.

One plan covers all symbols and timeframes. Tiers are unioned and the best one per key is taken by aggregation; only
the roll-up needs a second step, as it reads the finished minutes.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import timeframes
from tidemark.operators import candles, gaps, merging

TIERS = ["local", "ticks", "history", "rollup"]


@dataclass(frozen=True)
class Filled:
    candles: DataFrame  # with source_tier: its place in TIERS
    missing: DataFrame  # what no source has


def fill(wanted: DataFrame, local: DataFrame, ticks: DataFrame, history: DataFrame, labels: list[str], calendar: DataFrame | None, as_of: dt.datetime) -> Filled:
    """Fills the gaps of local at wanted (symbol, tf, ts). Candles of local that were not asked for stay.

    Ticks are read from each symbol's earliest gap on, and not at all for symbols without one.
    """
    ordered = sorted(labels, key=timeframes.seconds)
    open_gaps = gaps.missing(wanted, local)
    since = gaps.earliest_missing(open_gaps).withColumnRenamed("ts", "_since")
    needed = ticks.join(since, "symbol").where(F.col("ts") >= F.col("_since")).drop("_since")
    built = candles.closed(candles.ohlcv(needed, ordered, calendar), as_of)
    found = merging.only_wanted(history, open_gaps)
    first = merging.ranked([local, built, found], keep_source=True)
    minutes = first.where("tf = '1m'").drop("source_tier")
    rolled = merging.only_wanted(gaps.rolled_up(minutes, [t for t in ordered if t != "1m"]), open_gaps) if "1m" in ordered else local.where(F.lit(False))
    done = merging.best(first.unionByName(rolled.withColumn("source_tier", F.lit(3))))
    return Filled(done, gaps.missing(wanted, done))


def filled_by_tier(filled: Filled) -> DataFrame:
    """symbol, tf, source, n_candles: how many candles came from where."""
    names = F.array(*[F.lit(t) for t in TIERS])
    return filled.candles.groupBy("symbol", "tf", F.get(names, F.col("source_tier")).alias("source")).agg(F.count("*").alias("n_candles"))
