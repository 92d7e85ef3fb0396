"""The same dataflows over unbounded input: candles, latest prices, depth, signals, and the position of a strategy.

Event times of streams are TIMESTAMP in a UTC session and hold IST wall clock, as watermarks need that type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import scalars, session, timeframes, trading_days
from tidemark.operators import candles, signals
from tidemark.sources import files, sinks


def messages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """value, arrived: feed messages that land as text files, in the order of files' times, names and lines.

    The number of files per batch is what bounds a batch, as a queue's size would. A file is what a feed writes in some
    seconds; it is read as a whole, as lines have no number otherwise.
    """
    whole = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    lines = whole.select(F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return lines.where("value <> ''").select("value", F.struct("modified", "file", "line").alias("arrived"))


def ticks(raw: DataFrame) -> DataFrame:
    """Ticks of messages(), seq being when they arrived."""
    return files.quote_messages(raw, seq="arrived" if "arrived" in raw.columns else None)


def candle_stream(tick_stream: DataFrame, labels: Iterable[str], delay: str = "2 minutes", session_only: bool = True, calendar: DataFrame | None = None) -> DataFrame:
    """Candles that are final: a bucket is emitted once the watermark has passed it. Later ticks are dropped and counted by Spark.

    With a calendar its special sessions and holidays hold, as in batch; without one all weekdays trade.
    """
    valid = tick_stream.where("symbol is not null and ts is not null and ltp is not null").withColumn("qty", F.coalesce("qty", F.lit(0.0)))
    valid = valid.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    if session_only:
        valid = trading_days.only_sessions(valid, calendar)
    rows = candles.with_buckets(valid, labels)
    rows = rows.withColumn("bucket", F.col("bucket").cast("timestamp")).withWatermark("bucket", delay)
    opens, closes = candles.first_last()
    bars = rows.groupBy("symbol", "tf", "bucket").agg(opens.alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), closes.alias("close"), F.sum("qty").alias("volume"))
    return bars.withColumnRenamed("bucket", "ts").select(*candles.CANDLE_COLUMNS)


def latest_stream(tick_stream: DataFrame) -> DataFrame:
    """For update mode: each symbol's price that arrived last."""
    return tick_stream.groupBy("symbol").agg(F.max_by("ltp", "seq").alias("ltp"))


def _trigger(every: str | None) -> dict:
    """Without an interval what is there is worked off, and the query ends."""
    return {"processingTime": every} if every else {"availableNow": True}


def upsert_candles(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, also: Iterable[Callable[[DataFrame], None]] = ()) -> StreamingQuery:
    """Keeps a candle table up to date, and gives each batch to other sinks too.

    A batch that is run again after a failure writes the same partitions again; other sinks see it again.
    """

    def save(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        for sink in (lambda df: sinks.upsert_candles(df, path), *also):
            sink(rows)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def append_depth(raw: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    from tidemark.operators import depth

    rows = depth.log_rows(files.depth_messages(raw))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def first_signals(signal_stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Of signals (symbol, ref_ts, ...) the first one per symbol and reference candle, its state kept as long as the watermark."""
    return signal_stream.withWatermark("ref_ts", delay).dropDuplicatesWithinWatermark(["symbol", "ref_ts"])


def breakout_stream(tick_stream: DataFrame, bars: DataFrame, reference_tf: str = "1m", delay: str = "2 minutes", calendar: DataFrame | None = None, exchange: str = "NSE") -> DataFrame:
    """signals.breakouts() over a stream of ticks and the candles known so far (of reference_tf, a table).

    Each tick meets the levels of its bucket by equality. The first breach of a reference candle is final once the
    watermark has passed its bucket.
    """
    levels = signals.previous_levels(bars.where(F.col("tf") == reference_tf)).where("ref_ts is not null")
    levels = levels.select("symbol", F.col("ts").alias("bucket"), "ref_ts", "ref_high", "ref_low")
    valid = tick_stream.where("symbol is not null and ts is not null and ltp is not null").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = trading_days.only_sessions(valid, calendar).withColumn("bucket", session.bucket("ts", timeframes.seconds(reference_tf))).join(levels, ["symbol", "bucket"])
    hits = rows.withColumn("side", scalars.breakout_side("ltp", "ref_high", "ref_low")).where("side is not null")
    hits = hits.withColumn("bucket", F.col("bucket").cast("timestamp")).withWatermark("bucket", delay)
    first = hits.groupBy("symbol", "ref_ts", "bucket").agg(F.min(F.struct("ts", "seq", "side", F.col("ltp").alias("price"))).alias("s"))
    return first.select("symbol", F.lit(exchange).alias("exchange"), "ref_ts", "s.ts", "s.seq", "s.side", "s.price")


POSITION_EVENTS = "kind string, symbol string, side string, price double, ts timestamp, seq long"
FILLS = "symbol string, action string, side string, price double, ts timestamp"


def positions(events: DataFrame, fraction: float = 0.002) -> DataFrame:
    """Fills of a single position over a stream of signals and ticks (kind 'signal' or 'tick', account, and POSITION_EVENTS).

    State per account: the open position. Signals while one is open are dropped; a tick at or beyond the stop closes it.
    Within a batch events are taken in the order of ts and seq.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out = []
        for e in pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable").itertuples(index=False):
            if held is None and e.kind == "signal":
                stop = e.price * (1 - fraction if e.side == "BUY" else 1 + fraction)
                held = (e.symbol, e.side, stop)
                out.append((e.symbol, "ENTRY", e.side, e.price, e.ts))
            elif held is not None and e.kind == "tick" and e.symbol == held[0] and (e.price <= held[2] if held[1] == "BUY" else e.price >= held[2]):
                out.append((e.symbol, "EXIT", "SELL" if held[1] == "BUY" else "BUY", e.price, e.ts))
                held = None
        if held is None:
            state.remove()
        else:
            state.update(held)
        yield pd.DataFrame(out, columns=["symbol", "action", "side", "price", "ts"])

    keyed = events.withColumn("account", F.coalesce("account", F.lit("main"))) if "account" in events.columns else events.withColumn("account", F.lit("main"))
    return keyed.groupBy("account").applyInPandasWithState(step, FILLS, "symbol string, side string, stop double", "append", GroupStateTimeout.NoTimeout)
