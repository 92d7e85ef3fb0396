import datetime as dt
import json
import os

from pyspark.sql import functions as F
from tests.helpers import sf_dir
from tidemark import catalog
from tidemark.config import EngineConfig
from tidemark.operators import candles, signals
from tidemark.sources import files
from tidemark.streaming import flows, live


def test_stream_of_candles_equals_batch(spark, tmp_path):
    ticks = files.event_ticks(spark.read.parquet(f"{sf_dir()}/events.parquet"))
    ticks.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    flows.upsert_candles(flows.candle_stream(stream, ["15m"], "1 second"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {tuple(r) for r in files.candle_table(spark, str(tmp_path / "out")).select(*candles.CANDLE_COLUMNS).collect()}
    want = {tuple(r) for r in candles.ohlcv(ticks, ["15m"]).collect()}
    assert got <= want and len(want) - len(got) <= 5  # buckets that the watermark has not passed stay open


def test_messages_become_ticks(spark, tmp_path):
    rows = [{"type": "market_data", "data": {"symbol": "NSE:a", "ltp": 5.0, "ltt": 1704254400000}}, {"type": "x"}, {"status": "error"}, {"type": "market_data", "data": {"ltp": 5.0}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    q = flows.ticks(flows.messages(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("quotes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["symbol"], r["ltp"], r["qty"]) for r in spark.table("quotes").collect()] == [("A", 5.0, 0.0)]


def test_the_last_price_over_files_and_partitions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    say = lambda s, p: json.dumps({"type": "market_data", "data": {"symbol": s, "ltp": p, "ltt": 1704254400000}})
    (tmp_path / "in/b.txt").write_text("\n".join(say(s, float(k)) for k in range(50) for s in "AB"))
    (tmp_path / "in/a.txt").write_text("\n".join([say("A", 7.0), say("A", 3.0)]))
    os.utime(tmp_path / "in/b.txt", (1_700_000_000, 1_700_000_000))
    os.utime(tmp_path / "in/a.txt", (1_700_000_100, 1_700_000_100))
    rows = flows.ticks(flows.messages(spark, str(tmp_path / "in"))).repartition(3)
    q = flows.latest_stream(rows).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["symbol"]: r["ltp"] for r in spark.table("latest").collect()} == {"A": 3.0, "B": 49.0}


def _stream(spark, ticks, path):
    ticks.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_special_sessions_in_a_stream(spark, tmp_path):
    ticks, days = catalog.ticks(spark, sf_dir()), catalog.calendar(spark)
    stream = _stream(spark, ticks, str(tmp_path / "in"))
    flows.upsert_candles(flows.candle_stream(stream, ["15m"], "1 second", calendar=days), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    of = lambda df: {tuple(r) for r in df.select(*candles.CANDLE_COLUMNS).collect() if r["ts"].day in (20, 26)}
    got = of(files.candle_table(spark, str(tmp_path / "out")))
    assert got == of(candles.ohlcv(ticks, ["15m"], days)) and {r[2].day for r in got} == {20}


def test_breakouts_in_a_stream(spark, tmp_path):
    ticks, days = catalog.ticks(spark, sf_dir()), catalog.calendar(spark)
    bars = candles.ohlcv(ticks, ["60m"], days)
    q = flows.breakout_stream(_stream(spark, ticks, str(tmp_path / "in")), bars, "60m", "1 second", days).writeStream.format("memory").queryName("signals").trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = ({tuple(r) for r in df.collect()} for df in (spark.table("signals"), signals.breakouts(ticks, "60m", days)))
    last = max(r[3] for r in want).replace(minute=0)
    assert got <= want and all(r[3] >= last - dt.timedelta(hours=1) for r in want - got)


def test_backfill_beside_the_stream_gives_the_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 3)
    ticks = catalog.ticks(spark, sf_dir()).where(F.col("ts").cast("date") == F.lit(day.date()))
    days, path = catalog.calendar(spark), str(tmp_path / "out")
    want = {tuple(r) for r in candles.ohlcv(ticks, ["15m"], days).collect()}
    stream = _stream(spark, ticks, str(tmp_path / "in"))
    feed = lambda: flows.upsert_candles(flows.candle_stream(stream, ["15m"], "1 second", calendar=days), path, str(tmp_path / "ck"))
    start = live.plan(spark, days, day.replace(hour=12))
    assert start == live.Start(True, 0.0)
    query, done = live.run(start, lambda: candles.ohlcv(ticks, ["15m"], days), feed, path, lambda s: None)
    query.awaitTermination()
    done.result(120)
    assert {tuple(r) for r in live.candles(spark, path).collect()} == want


def test_both_feeds(spark, tmp_path):
    for name in ("quotes", "depth"):
        (tmp_path / name).mkdir()
    ms = lambda m: 1704254400000 + m * 60_000
    quotes = [{"type": "market_data", "data": {"symbol": "NSE:A", "ltp": 5.0 + m, "ltt": ms(m), "last_trade_quantity": 1}} for m in range(20)]
    (tmp_path / "quotes/a.txt").write_text("\n".join(map(json.dumps, quotes)))
    books = [{"type": "market_data", "data": {"symbol": "A", "ltt": ms(m), "bids": [{"price": 1.0 + m, "quantity": 1}]}} for m in range(3)]
    (tmp_path / "depth/a.txt").write_text("\n".join(map(json.dumps, books)))
    seen = []
    for q in live.feeds(spark, EngineConfig(), str(tmp_path / "quotes"), str(tmp_path / "depth"), str(tmp_path / "out"), every=None, also=[lambda df: seen.append(df.count())]):
        q.awaitTermination()
    got = {(r["tf"], r["ts"].minute): (r["open"], r["close"], r["volume"]) for r in files.candle_table(spark, str(tmp_path / "out/candles")).collect()}
    assert got["1m", 40] == (15.0, 15.0, 1.0) and got["5m", 35] == (10.0, 14.0, 5.0) and sum(seen) == len(got)
    assert spark.read.parquet(str(tmp_path / "out/depth")).count() == 3


def test_when_the_feed_starts(spark):
    days = catalog.calendar(spark)
    at = lambda d, h, m, s=0: live.plan(spark, days, dt.datetime(2024, 1, d, h, m, s))
    assert at(3, 9, 14, 0) == live.Start(True, 0.0) and at(3, 9, 13, 59) == live.Start(False, 31.0)
    assert at(26, 12, 0).parallel is False and at(20, 12, 0).parallel is True
    slept = []
    live.run(live.Start(False, 31.0), lambda: spark.createDataFrame([], "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double"), lambda: None, "/tmp/none", slept.append)
    assert slept == [31.0]


def test_the_feed_log():
    rows, clock = [], [dt.datetime(2024, 1, 3, 10)]
    log = live.FeedLog(rows.append, "quote", lambda: clock[0])
    log.onQueryStarted(None)
    for seconds, n in ((30, 0), (60, 0), (90, 0), (100, 5), (150, 0), (161, 0)):
        clock[0] = dt.datetime(2024, 1, 3, 10) + dt.timedelta(seconds=seconds)
        log.seen(n)
    log.onQueryTerminated(type("E", (), {"exception": None}))
    log.onQueryTerminated(type("E", (), {"exception": "gone"}))
    assert [(r[0], r[4]) for r in rows] == [("CONNECT", None), ("IDLE", "60"), ("IDLE", "61"), ("DISCONNECTED", "gone")]
    assert rows[0][1:4] == (1704276000000, dt.date(2024, 1, 3), "quote")


def test_positions_over_a_stream(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 3, 10, 0, s)
    events = [("signal", "A", "BUY", 100.0, t(0), 1), ("signal", "B", "BUY", 50.0, t(1), 2), ("tick", "A", None, 99.9, t(2), 3), ("tick", "A", None, 99.8, t(3), 4), ("signal", "B", "SELL", 50.0, t(4), 5)]
    spark.createDataFrame(events, flows.POSITION_EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flows.POSITION_EVENTS).parquet(str(tmp_path / "in"))
    q = flows.positions(stream).writeStream.format("memory").queryName("fills").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["symbol"], r["action"], r["side"]) for r in spark.table("fills").orderBy("ts").collect()] == [("A", "ENTRY", "BUY"), ("A", "EXIT", "SELL"), ("B", "ENTRY", "SELL")]
