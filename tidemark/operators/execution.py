"""Replay of signals through a single position with a stop: stop levels, first hits, the ledger, squaring off.

Order intents only; nothing is sent anywhere.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars

LEDGER = "trade bigint, symbol string, side string, entry_ts timestamp_ntz, entry_seq bigint, entry_price double, stop double, exit_ts timestamp_ntz, exit_seq bigint, exit_price double"
#: Widths of time slices, each a whole number of the one before: within the least a stop's first hit is searched tick by
#: tick, in wider ones by their extremes. A signal meets at most the slices of its own next wider one on each level.
SLICES = (3_600, 86_400, 64 * 86_400)


def with_stops(signals: DataFrame, fraction: float = 0.002) -> DataFrame:
    return signals.withColumn("stop", scalars.stop_price("side", "price", fraction))


def _extremes(moments: DataFrame) -> DataFrame:
    """symbol, level, parent, slice, lo, hi: the extremes of slices of every width; the widest ones share one parent."""
    at = lambda k: F.floor(F.col("second") / SLICES[k])
    levels = [F.struct(F.lit(k).alias("level"), (at(k + 1) if k + 1 < len(SLICES) else F.lit(0).cast("bigint")).alias("parent"), at(k).alias("slice")) for k in range(len(SLICES))]
    least = moments.groupBy("symbol", "slice").agg(F.min("x_price").alias("lo"), F.max("x_price").alias("hi"))
    rows = least.withColumn("second", F.col("slice") * SLICES[0]).select("symbol", "lo", "hi", F.explode(F.array(*levels)).alias("l"))
    return rows.groupBy("symbol", "l.level", "l.parent", "l.slice").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def first_hits(signals: DataFrame, ticks: DataFrame) -> DataFrame:
    """signals (with stop) with exit_ts, exit_seq, exit_price: the first later tick of the symbol at or beyond the stop.

    Ticks are summed up as the extremes of slices of several widths. A signal asks the later slices of its own hour's
    day, then those of its day's span, then later spans; from the first one that reaches the stop it goes down to the
    hour, and is then joined to the ticks of that hour and its own alone. All of it are joins by equality on the slice
    above, so a signal meets some hundred rows however long the history is.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    moments = ticks.where("symbol is not null and ts is not null and ltp is not null").select("symbol", F.col("ts").alias("x_ts"), F.col("seq").alias("x_seq"), F.col("ltp").alias("x_price"))
    moments = moments.withColumn("slice", F.floor(seconds("x_ts") / SLICES[0]))
    extremes = _extremes(moments)
    key = ["symbol", "ts", "seq"]
    keyed = signals.select(*key, "side", "stop", seconds("ts").alias("second"))
    reach = F.when(F.col("side") == "BUY", F.col("lo") <= F.col("stop")).otherwise(F.col("hi") >= F.col("stop"))
    own = lambda k: F.floor(F.col("second") / SLICES[k])
    asks = F.array(*[F.struct(F.lit(k).alias("level"), (own(k + 1) if k + 1 < len(SLICES) else F.lit(0).cast("bigint")).alias("parent"), own(k).alias("own")) for k in range(len(SLICES))])
    asked = keyed.select(*key, "side", "stop", F.explode(asks).alias("a")).select(*key, "side", "stop", "a.*")
    later = asked.join(extremes, ["symbol", "level", "parent"]).where((F.col("slice") > F.col("own")) & reach)
    # Slices of a lower level come before all later ones of a higher level.
    place = later.groupBy(*key, "side", "stop").agg(F.min(F.struct("level", "slice")).alias("p")).select(*key, "side", "stop", "p.level", "p.slice")
    for level in reversed(range(1, len(SLICES))):
        # The level is part of the key, no filter, so that all joins read one shuffle of the extremes.
        inside = place.where(F.col("level") == level).select(*key, "side", "stop", (F.col("level") - 1).alias("level"), F.col("slice").alias("parent"))
        first = inside.join(extremes, ["symbol", "level", "parent"]).where(reach).groupBy(*key, "side", "stop").agg(F.min("slice").alias("slice"))
        place = place.where(F.col("level") < level).unionByName(first.withColumn("level", F.lit(level - 1)))
    hours = keyed.select(*key, "side", "stop", own(0).alias("slice")).unionByName(place.drop("level"))
    hit = scalars.stop_hit("side", "x_price", "stop") & (F.struct("x_ts", "x_seq") > F.struct("ts", "seq"))
    found = hours.join(moments, ["symbol", "slice"]).where(hit).groupBy(*key).agg(F.min(F.struct("x_ts", "x_seq", "x_price")).alias("x"))
    exits = found.select(*key, F.col("x.x_ts").alias("exit_ts"), F.col("x.x_seq").alias("exit_seq"), F.col("x.x_price").alias("exit_price"))
    return signals.join(exits, key, "left")


def chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The signals that find no open position: each is the first one after the exit of the one before, found by bisection."""
    rows = rows.sort_values(["ts", "seq", "symbol"], kind="stable", ignore_index=True)
    ts, seq, exit_ts = rows["ts"].to_numpy(), rows["seq"].to_numpy(), rows["exit_ts"].to_numpy()
    exit_seq = rows["exit_seq"].fillna(0).to_numpy(np.int64)
    taken, at = [], 0
    while at < len(rows):
        taken.append(at)
        if np.isnat(exit_ts[at]):
            break  # it stays open
        same, after = np.searchsorted(ts, exit_ts[at], "left"), np.searchsorted(ts, exit_ts[at], "right")
        at = int(same + np.searchsorted(seq[same:after], exit_seq[at], "right"))
    out = rows.iloc[taken].assign(trade=np.arange(1, len(taken) + 1), entry_ts=ts[taken], entry_seq=seq[taken], entry_price=rows["price"].to_numpy()[taken])
    return out[[c.split()[0] for c in LEDGER.split(", ")]].astype({"exit_seq": "Int64"})


def ledger(exits: DataFrame, account: str | None = None) -> DataFrame:
    """Trades of a single position over first_hits() rows: signals that come while it is open are dropped.

    The chain is sequential by nature: one group, or one per account column, that holds signals (some hundred bytes
    each), not ticks, and takes one bisection per trade.
    """
    columns = ["symbol", "side", "ts", "seq", "price", "stop", "exit_ts", "exit_seq", "exit_price"]
    if account is None:
        return exits.select(*columns).groupBy().applyInPandas(chain, LEDGER)
    return exits.select(account, *columns).groupBy(account).applyInPandas(lambda key, rows: chain(rows).assign(**{account: key[0]}), f"{LEDGER}, {account} {exits.schema[account].dataType.simpleString()}")


def square_off(trades: DataFrame, prices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """trades with those still open closed at as_of by the last price (symbol, ltp) known; reason tells how each ended."""
    closed = trades.join(prices.select("symbol", "ltp"), "symbol", "left")
    is_open = F.col("exit_ts").isNull()
    return closed.withColumns({
        "reason": F.when(is_open, "SQUARE_OFF").otherwise("STOP"),
        "exit_price": F.when(is_open, F.col("ltp")).otherwise(F.col("exit_price")),
        "exit_ts": F.when(is_open, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("exit_ts")),
    }).drop("ltp")


def closing_orders(positions: DataFrame) -> DataFrame:
    """Order intents that flatten positions (symbol, exchange, quantity); flat ones need none."""
    return positions.where("quantity <> 0").select("symbol", "exchange", scalars.closing_side("quantity").alias("side"), F.abs("quantity").alias("quantity"))


def order_intents(trades: DataFrame) -> DataFrame:
    """ts, symbol, side, price, kind: an entry per trade and an exit per closed one."""
    entry = trades.select(F.col("entry_ts").alias("ts"), "symbol", "side", F.col("entry_price").alias("price"), F.lit("ENTRY").alias("kind"))
    leave = trades.where("exit_ts is not null").select(F.col("exit_ts").alias("ts"), "symbol", scalars.opposite("side").alias("side"), F.col("exit_price").alias("price"), F.lit("EXIT").alias("kind"))
    return entry.union(leave)
