import datetime as dt
import json

import pandas as pd
import pytest

from pyspark.sql import functions as F
from tidemark import schemas
from tidemark.functions import session
from tidemark.operators import candles, connections, depth, execution, gaps, indicators, merging
from tidemark.sources import files, sinks

DAY = dt.datetime(2024, 1, 3)


def at(h, m, s=0):
    return DAY.replace(hour=h, minute=m, second=s)


def tick_rows(spark, rows):
    return spark.createDataFrame([("A", t, float(p), float(q), k) for k, (t, p, q) in enumerate(rows)], schemas.TICK)


def test_bars_by_hand(spark):
    ticks = tick_rows(spark, [(at(10, 0, 1), 10, 1), (at(10, 0, 20), 12, 2), (at(10, 0, 40), 9, 3), (at(10, 1, 5), 11, 4)])
    bars = candles.ohlcv(ticks, ["1m"])
    got = [tuple(r)[2:] for r in bars.orderBy("ts").collect()]
    assert got == [(at(10, 0), 10, 12, 9, 9, 6), (at(10, 1), 11, 11, 11, 11, 4)]
    assert [r["ts"] for r in candles.closed(bars, at(10, 1, 30)).collect()] == [at(10, 0)]


def test_ticks_with_nulls_make_no_bars(spark):
    rows = spark.createDataFrame([(None, at(10, 0), 1.0, 1.0, 1), ("A", None, 1.0, 1.0, 2), ("A", at(10, 0), None, 1.0, 3), ("", at(10, 0), 1.0, 1.0, 4), ("A", at(10, 0), 5.0, None, 5)], schemas.TICK)
    assert [tuple(r)[3:] for r in candles.ohlcv(rows, ["1m"]).collect()] == [(5.0, 5.0, 5.0, 5.0, 0.0)]
    assert candles.ohlcv(rows.limit(0), ["1m"]).count() == 0


def _minutes(spark, minutes):
    return spark.createDataFrame([("A", "1m", at(10, m), 1.0 + m, 2.0 + m, 0.5, 1.5, 1.0) for m in minutes], schemas.CANDLE)


def test_roll_up_needs_every_minute(spark):
    full = gaps.rolled_up(_minutes(spark, range(5)), ["5m", "90s"]).collect()
    assert [(r["tf"], r["ts"], r["open"], r["high"], r["volume"]) for r in full] == [("5m", at(10, 0), 1.0, 6.0, 5.0)]
    assert gaps.rolled_up(_minutes(spark, [0, 1, 3, 4]), ["5m"]).count() == 0


def test_expected_is_present_or_missing(spark):
    days = spark.createDataFrame([(DAY.date(),)], "d date")
    want = gaps.expected(spark.createDataFrame([("A",), ("B",)], "symbol string"), days, ["15m", "60m"])
    assert want.count() == 2 * (25 + 7)
    have = spark.createDataFrame([("A", "15m", at(9, 15), 1.0, 1.0, 1.0, 1.0, 1.0)], schemas.CANDLE)
    assert gaps.missing(want, have).count() == 2 * 32 - 1


def test_merges(spark):
    one = spark.createDataFrame([("A", "1m", at(10, 0), 1.0, 1.0, 1.0, 1.0, 1.0)], schemas.CANDLE)
    two = one.withColumn("open", F.lit(9.0))
    assert merging.existing_wins(one, two).first()["open"] == 1.0
    assert merging.existing_wins(one, one).count() == 1
    both = one.withColumn("version", F.lit(0)).union(two.withColumn("version", F.lit(1)))
    assert merging.newest_wins(both).first()["open"] == 9.0


def _series(spark, rows):
    return spark.createDataFrame([("A", "1m", DAY + dt.timedelta(minutes=k), float(h), float(h), float(low), float(low), 0.0) for k, (h, low) in enumerate(rows)], schemas.CANDLE)


@pytest.mark.parametrize(("second", "plus", "minus"), [((12, 6), 0.0, 2.0), ((11, 11), 0.0, 3.0), ((14, 7), 4.0, 0.0)])
def test_equal_moves_leave_the_fall(spark, second, plus, minus):
    rows = indicators.directional_movement(_series(spark, [(10, 8), second])).orderBy("ts").collect()
    assert (rows[0]["plus_dm"], rows[0]["minus_dm"]) == (0.0, 0.0)
    assert (rows[1]["plus_dm"], rows[1]["minus_dm"]) == (plus, minus)


def test_adx_warm_up(spark):
    for n, ready, values in ((14, False, 0), (26, True, 0), (27, True, 1)):
        rows = indicators.adx(_series(spark, [(100 + (k * 7) % 11, 90 + (k * 5) % 7) for k in range(n)])).orderBy("ts").collect()
        assert rows[-1]["ready"] is ready and sum(r["value"] is not None for r in rows) == values
    assert all(r["value"] is None for r in indicators.adx(_series(spark, [(5, 5)] * 40)).collect())


def test_adx_against_a_loop(spark):
    bars = [(100 + (k * 37) % 23 + k % 5, 80 + (k * 29) % 17) for k in range(60)]
    got = [r["value"] for r in indicators.adx(_series(spark, bars)).orderBy("ts").collect()]
    tr, up, down = [], [], []
    for k, (h, low) in enumerate(bars):
        ph, pl = bars[k - 1] if k else (h, low)
        pc = bars[k - 1][1] if k else None
        tr.append(max([h - low] + ([abs(h - pc), abs(low - pc)] if k else [])))
        rise, fall = (h - ph, abs(low - pl)) if k else (0, 0)
        up.append(rise if rise > fall and rise > 0 else 0)
        down.append(fall if fall > up[-1] and fall > 0 else 0)
    mean = lambda x, k: sum(x[k - 13 : k + 1]) / 14 if k >= 13 and None not in x[k - 13 : k + 1] else None
    dx = []
    for k in range(60):
        t, p, m = mean(tr, k), mean(up, k), mean(down, k)
        dx.append(None if t is None or p + m == 0 else 100 * abs(p - m) / (p + m))
    for k in range(60):
        want = mean(dx, k)
        assert (got[k] is None) == (want is None) and (want is None or abs(got[k] - want) < 1e-9)


def test_last_values_are_padded(spark):
    s = spark.createDataFrame([("A", "1m", at(10, 0), 5.0, True), ("B", "1m", at(10, 0), None, False)], "symbol string, tf string, ts timestamp_ntz, value double, ready boolean")
    assert {r["symbol"]: r["values"] for r in indicators.last_values(s, 3).collect()} == {"A": [None, None, 5.0], "B": [None, None, None]}


def test_chain_drops_signals_while_open():
    t = lambda m: pd.Timestamp(at(10, m))
    rows = pd.DataFrame([("A", "BUY", t(0), 1, 10.0, 9.98, t(5), 9, 9.0), ("B", "BUY", t(3), 5, 1.0, 0.9, t(4), 8, 0.8), ("B", "SELL", t(6), 12, 1.0, 1.1, pd.NaT, None, None), ("A", "BUY", t(7), 20, 1.0, 1.1, t(8), 21, 1.0)], columns=["symbol", "side", "ts", "seq", "price", "stop", "exit_ts", "exit_seq", "exit_price"])
    assert list(execution.chain(rows)["entry_seq"]) == [1, 12]
    assert execution.chain(rows.iloc[:0]).empty


def test_depth(spark):
    lvl = lambda p: [{"price": p, "quantity": 1}]
    books = [
        {"type": "market_data", "data": {"symbol": "NSE:A", "ltt": 1, "bids": lvl(9.0), "asks": lvl(11.0)}},
        {"type": "market_data", "symbol": "a", "data": {"ltt": 2, "bids": [], "depth": {"buy": lvl(8.0), "sell": []}}},
        {"type": "market_data", "data": {"symbol": "A", "ltt": 3, "bids": [], "asks": []}},
        {"type": "other", "data": {"symbol": "A", "ltt": 4, "bids": lvl(1.0)}},
    ]
    raw = spark.createDataFrame([(json.dumps(b),) for b in books] + [("{broken",), (None,)], "value string")
    got = files.depth_messages(raw)
    assert got.count() == 2
    best = depth.best(got).first()
    assert (best["symbol"], best["ts_ms"], best["best_bid"], best["best_ask"]) == ("A", 2, 8.0, None)
    assert json.loads(depth.log_rows(got).where("ts_ms = 1").first()["raw_json"])["bids"][0]["price"] == 9.0


def test_connections(spark):
    log = spark.createDataFrame([("CONNECT", 1), ("DISCONNECTED", 2), ("CONNECT", 5), ("DISCONNECTED", 7)], "event string, ts_ms bigint").withColumn("day", F.lit(DAY.date()))
    assert [r["event"] for r in connections.classified(log).orderBy("ts_ms").collect()] == ["DAY_STARTED", "DISCONNECTED", "RECONNECTED", "DISCONNECTED"]
    assert {(r["lost_ms"], r["back_ms"]) for r in connections.outages(log).collect()} == {(2, 5), (7, None)}


def test_outages_take_one_pass_over_a_day_and_order_equal_times(spark):
    log = spark.createDataFrame([(4, "CONNECT", 5, "a"), (1, "CONNECT", 5, "a"), (2, "DISCONNECTED", 5, "a"), (5, "DISCONNECTED", 5, "a"), (6, "CONNECT", 9, "a")], "event_id long, event string, ts_ms long, day string")
    rows = connections.outages(log, "event_id")
    assert sorted((r["lost_ms"], r["back_ms"]) for r in rows.collect()) == [(5, 5), (5, 9)]
    assert [(r["lost_ms"], r["back_ms"]) for r in connections.outages(log).collect()] == [(5, 5), (5, 5)]  # without ids
    # A frame that shrinks is gone through again for each row.
    assert "unboundedfollowing" not in rows._jdf.queryExecution().executedPlan().toString().lower()


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("exchange,symbol\nNSE, tcs \nnse,TCS\n,X\nBSE,ABC\n")
    listed = files.instruments(spark, str(tmp_path / "s.csv"))
    assert [r["key"] for r in listed.collect()] == ["NSE:TCS", "BSE:ABC"]
    assert {r["exchange"]: r["symbols"] for r in files.by_exchange(listed).collect()} == {"NSE": "TCS", "BSE": "ABC"}
    (tmp_path / "c.json").write_text(json.dumps({"holidays": ["2024-01-26", "bad"], "special_open": []}))
    assert [(str(r["d"]), r["kind"]) for r in files.calendar(spark, str(tmp_path / "c.json")).collect()] == [("2024-01-26", "holiday")]
    assert files.calendar(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "h.json").write_text(json.dumps({"CM": [{"tradingDate": "26-Jan-2024"}], "FO": [{"Date": "15/08/2024"}, {"trade_date": "2024-01-26"}]}))
    assert {str(r["d"]) for r in files.fetched_holidays(spark, str(tmp_path / "h.json")).collect()} == {"2024-01-26", "2024-08-15"}


def test_tick_tables(spark):
    typed = spark.createDataFrame([("A", 1704254400000, 7, 5.0, None), ("A", 1704254400000, 8, None, 3)], "symbol string, timestamp bigint, ingest_ns bigint, ltp double, last_quantity bigint")
    assert [tuple(r) for r in files.typed_ticks(typed).collect()] == [("A", at(9, 30), 5.0, 0.0, 7)]
    raw = spark.createDataFrame([("A", 1704254400000, 7, '{"ltp":"5.5","last_trade_quantity":2}'), ("A", 1, 1, '{"ltp":"x"}'), ("A", 1, 1, None)], "symbol string, timestamp bigint, ingest_ns bigint, raw_json string")
    assert [tuple(r) for r in files.json_ticks(raw).collect()] == [("A", at(9, 30), 5.5, 2.0, 7)]
    assert raw.select(session.to_epoch_ms(session.from_epoch_ms("timestamp")).alias("ms")).first()["ms"] == 1704254400000


def test_candle_file_with_nanoseconds(spark, tmp_path):
    pd.DataFrame({"timestamp": pd.to_datetime(["2024-01-03 09:15"]).tz_localize("Asia/Kolkata"), "open": [1], "high": [1.0], "low": [1.0], "close": [1.0], "volume": [1]}).to_parquet(tmp_path / "a.parquet", coerce_timestamps=None)
    assert files.candle_file(spark, str(tmp_path / "a.parquet"), "A", "1m").first()["ts"] == at(9, 15)
    assert files.candle_file(spark, str(tmp_path / "none.parquet"), "A", "1m").count() == 0


def test_first_hits_over_long_gaps(spark):
    """Stops that are hit in the same hour, day, span of days, a later span, or never, against a loop."""
    import random

    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 2, 9, 15)
    moments = sorted(start + dt.timedelta(seconds=rnd.choice([40, 4_000, 90_000, 3_000_000, 40_000_000]) * rnd.random() * 3) for _ in range(400))
    ticks = [(rnd.choice("AB"), t, 100 + rnd.gauss(0, 1) * (1 + 3 * (k % 17 == 0)), 1.0, k) for k, t in enumerate(moments)]
    found = [(s, "NSE", t, t, k, rnd.choice(["BUY", "SELL"]), p, 100 + rnd.uniform(-6, 6)) for s, t, p, _, k in ticks[::5]]
    rows = spark.createDataFrame(found, schemas.SIGNAL + ", stop double")
    got = {r["seq"]: (r["exit_ts"], r["exit_seq"]) for r in execution.first_hits(rows, spark.createDataFrame(ticks, schemas.TICK)).collect()}
    for s, _, _, t, k, side, _, stop in found:
        later = [(x, q) for symbol, x, p, _, q in ticks if symbol == s and (x, q) > (t, k) and (p <= stop if side == "BUY" else p >= stop)]
        assert got[k] == (min(later) if later else (None, None))


def test_the_chain_against_a_loop():
    import random

    rnd = random.Random(4)
    for _ in range(30):
        rows = []
        for k in range(rnd.randint(1, 40)):
            m = rnd.randint(0, 30)
            out = None if rnd.random() < 0.05 else m + rnd.randint(0, 6)
            rows.append(("A", "BUY", pd.Timestamp(at(10, m)), k, 1.0, 0.9, pd.NaT if out is None else pd.Timestamp(at(10, out)), None if out is None else k + 1, 0.9))
        rnd.shuffle(rows)
        frame = pd.DataFrame(rows, columns=["symbol", "side", "ts", "seq", "price", "stop", "exit_ts", "exit_seq", "exit_price"])
        want, free = [], None
        for r in sorted(rows, key=lambda r: (r[2], r[3])):
            if free is None or (r[2], r[3]) > free:
                want.append(r[3])
                if r[6] is pd.NaT:
                    break
                free = (r[6], r[7])
        assert list(execution.chain(frame)["entry_seq"]) == want


def test_broken_files_give_no_rows(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is no table PAR1")
    (tmp_path / "empty.parquet").write_bytes(b"")
    for name in ("bad", "empty", "none"):
        assert files.candle_file(spark, str(tmp_path / f"{name}.parquet"), "A", "1m").count() == 0
    (tmp_path / "all").mkdir()
    (tmp_path / "all/x.parquet").write_bytes(b"PAR1 broken PAR1")
    _minutes(spark, [1, 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
    assert files.readable(spark, str(tmp_path / "all"), schemas.CANDLE).count() == 2


def test_an_upsert_reads_its_days_alone(spark, tmp_path):
    path = str(tmp_path / "candles")
    sinks.upsert_candles(_minutes(spark, [0, 1]).union(_minutes(spark, [0]).withColumn("ts", F.col("ts") + F.expr("interval 5 days"))), path)
    fresh = _minutes(spark, [1]).withColumn("day", F.col("ts").cast("date"))
    plan = sinks.stored_beside(fresh, path)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "day" in scan and "2024-01-03" in scan and "tf" in scan
    assert sinks.stored_beside(fresh, path).count() == 2
    sinks.upsert_candles(_minutes(spark, []), path)
    assert files.candle_table(spark, path).count() == 3


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "candles")
    old = _minutes(spark, [0, 1]).union(_minutes(spark, [0]).withColumn("symbol", F.lit("B")))
    sinks.upsert_candles(old, path)
    sinks.upsert_candles(_minutes(spark, [1, 2]).withColumn("open", F.lit(99.0)), path)
    got = {(r["symbol"], r["ts"].minute): r["open"] for r in files.candle_table(spark, path).collect()}
    assert got == {("A", 0): 1.0, ("A", 1): 99.0, ("A", 2): 99.0, ("B", 0): 1.0}
