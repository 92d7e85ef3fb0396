"""Starting a day: backfill and live feed beside each other or one after the other, and a log of how the feed fares.

Candles of the stream and of the backfill go to tables of their own, so that neither rewrites what the other writes;
read together, the stream's candle stays where both have one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.config import EngineConfig
from tidemark.functions import trading_days
from tidemark.operators import connections, merging
from tidemark.sources import files, sinks
from tidemark.streaming import flows

#: Seconds before the open at which it is too late to wait for a backfill, and at which the feed starts otherwise.
PARALLEL_SECONDS, LEAD_SECONDS = 60, 30
#: Seconds without data after which the feed counts as idle.
IDLE_SECONDS = 60


@dataclass(frozen=True)
class Start:
    parallel: bool  # backfill beside the live feed, or before it
    wait_seconds: float  # from now until the feed starts, at least


def plan(spark: SparkSession, calendar: DataFrame, now: dt.datetime) -> Start:
    """In the session, and shortly before it, the feed starts at once and the backfill beside it; else the backfill comes first."""
    moment = spark.createDataFrame([(now,)], "ts timestamp_ntz")
    if trading_days.with_market_open(moment, calendar).first()["is_open"]:
        return Start(True, 0.0)
    seconds = trading_days.next_open(spark, calendar, now).first()["seconds"]
    return Start(True, 0.0) if seconds <= PARALLEL_SECONDS else Start(False, seconds - LEAD_SECONDS)


def run(start: Start, backfill: Callable[[], DataFrame], feed: Callable[[], StreamingQuery], path: str, sleep: Callable[[float], None]) -> tuple[StreamingQuery, Future]:
    """Starts both as planned. The backfill's candles go to backfill_path(path); a failed one does not stop the feed, its future tells."""
    pool = ThreadPoolExecutor(1)
    done = pool.submit(lambda: sinks.upsert_candles(backfill(), backfill_path(path)))
    pool.shutdown(wait=not start.parallel)
    if not start.parallel:
        sleep(max(0.0, start.wait_seconds))
    return feed(), done


def feeds(spark: SparkSession, config: EngineConfig, quotes: str, depth: str, root: str, calendar: DataFrame | None = None, every: str | None = "1 second", also: Iterable[Callable[[DataFrame], None]] = ()) -> list[StreamingQuery]:
    """Starts both feeds: candles of the quotes that land in one folder, books of those in another, under root.

    The queue limits of config bound the files of a batch. Each query has its own checkpoint, so one that fails is started
    again by itself. every=None works off what has landed.
    """
    limits = config.queue_limits
    bars = flows.candle_stream(flows.ticks(flows.messages(spark, quotes, limits["quote"])), config.timeframes, calendar=calendar)
    return [
        flows.upsert_candles(bars, f"{root}/candles", f"{root}/checkpoints/candles", every, also),
        flows.append_depth(flows.messages(spark, depth, limits["depth"]), f"{root}/depth", f"{root}/checkpoints/depth", every),
    ]


def backfill_path(path: str) -> str:
    return f"{path.rstrip('/')}_backfill"


def candles(spark: SparkSession, path: str) -> DataFrame:
    """The stream's candles at path, and the backfill's where the stream has none, as for ticks that came too late for it."""
    return merging.existing_wins(files.candle_table(spark, path), files.candle_table(spark, backfill_path(path)))


class FeedLog(StreamingQueryListener):
    """Connection log rows of a stream: (event, ts_ms, day, mode, note), given to write one at a time.

    A start connects. A failure disconnects; a clean end leaves no row. Batches without data for IDLE_SECONDS are noted
    once until data comes again. Spark starts a failed query again from its checkpoint when it is asked to.
    """

    def __init__(self, write: Callable[[tuple], None], mode: str, now: Callable[[], dt.datetime]):
        self.write, self.mode, self.now = write, mode, now
        self.last_data: dt.datetime | None = None
        self.idle = False

    def _row(self, event: str, note: str | None = None) -> None:
        now = self.now()
        self.write((event, int(now.replace(tzinfo=now.tzinfo or dt.timezone.utc).timestamp() * 1000), now.date(), self.mode, note))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.last_data, self.idle = self.now(), False
        self._row(connections.CONNECT)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.seen(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.seen(0)

    def seen(self, rows: int) -> None:
        now = self.now()
        if rows:
            self.last_data, self.idle = now, False
        elif not self.idle and self.last_data and (now - self.last_data).total_seconds() >= IDLE_SECONDS:
            self.idle = True
            self._row("IDLE", f"{(now - self.last_data).total_seconds():.0f}")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self._row(connections.LOST, event.exception[:500])
