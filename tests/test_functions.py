import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tidemark import schemas
from tidemark.config import EngineConfig
from tidemark.functions import scalars, session, timeframes, trading_days


@pytest.mark.parametrize(("label", "seconds"), [("5s", 5), ("30s", 30), ("1m", 60), ("5m", 300), ("1m30s", 90), ("15m", 900), ("5M", 300), ("1h30m", 1800), ("5ms", 300)])
def test_timeframes(label, seconds):
    assert timeframes.seconds(label) == seconds


@pytest.mark.parametrize("label", ["1h", "0m", ""])
def test_no_timeframes(label):
    with pytest.raises(ValueError):
        timeframes.seconds(label)


BUCKETS = [("09:15:03", "5s", "09:15:00"), ("09:15:07", "5s", "09:15:05"), ("09:17:42", "5m", "09:15:00"), ("09:21:00", "5m", "09:20:00"), ("09:16:10", "90s", "09:15:00"), ("09:16:31", "90s", "09:16:30"), ("09:14:59", "1m", "09:15:00"), ("15:30:00", "1m", "15:30:00"), ("09:23:00", "7m", "09:22:00"), ("15:29:59.999", "60m", "15:15:00")]


@pytest.mark.parametrize(("time", "tf", "want"), BUCKETS)
def test_buckets(spark, time, tf, want):
    got = spark.sql(f"select timestamp_ntz '2024-01-03 {time}' ts").select(session.bucket("ts", timeframes.seconds(tf)).alias("b")).first()["b"]
    assert got == dt.datetime.fromisoformat(f"2024-01-03 {want}")
    assert session.bucket_of(dt.datetime.fromisoformat(f"2024-01-03 {time}"), timeframes.seconds(tf)) == got


@given(st.datetimes(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)), st.sampled_from([5, 60, 90, 420, 900, 3600]))
def test_bucket_of_a_bucket_is_itself(moment, tf):
    b = session.bucket_of(moment, tf)
    assert session.bucket_of(b, tf) == b
    assert b <= max(moment, b.replace(hour=9, minute=15, second=0))


@pytest.mark.parametrize(("tf", "n"), [("5s", 4500), ("30s", 750), ("1m", 375), ("90s", 250), ("5m", 75), ("7m", 54), ("15m", 25), ("60m", 7)])
def test_slots_of_a_session(tf, n):
    assert len(session.slots(timeframes.seconds(tf))) == n


@pytest.mark.parametrize(("tf", "n"), [(300, 2), (900, 2), (3600, 4)])
def test_lookback_days(tf, n):
    assert trading_days.lookback_days(15, tf) == n


def test_special_opening_outranks_holiday_and_weekday(spark):
    sat, wed = dt.date(2024, 1, 6), dt.date(2024, 1, 3)
    for day, kinds, want in [(wed, [], True), (wed, ["holiday"], False), (wed, ["special_open"], True), (wed, ["holiday", "special_open"], True), (sat, [], False), (sat, ["holiday"], False), (sat, ["special_open"], True), (sat, ["holiday", "special_open"], True)]:
        calendar = spark.createDataFrame([(day, k) for k in kinds], schemas.CALENDAR)
        df = spark.createDataFrame([(day,)], "ts date")
        assert trading_days.with_trading_day(df, calendar).first()["is_trading_day"] is want


def test_calendar_refresh_keeps_the_past(spark):
    d = dt.date
    old = spark.createDataFrame([(d(2024, 1, 1), "holiday"), (d(2024, 6, 1), "holiday"), (d(2024, 7, 1), "special_open")], schemas.CALENDAR)
    new = spark.createDataFrame([(d(2024, 5, 5),), (d(2023, 1, 1),)], "d date")
    got = {(r["d"], r["kind"]) for r in trading_days.refreshed(old, new, d(2024, 3, 1)).collect()}
    assert got == {(d(2024, 1, 1), "holiday"), (d(2024, 5, 5), "holiday"), (d(2024, 7, 1), "special_open")}
    assert trading_days.is_stale(old, None, d(2024, 1, 1)) and trading_days.is_stale(old, d(2024, 12, 1), d(2024, 12, 2))
    assert not trading_days.is_stale(old, d(2024, 3, 1), d(2024, 3, 2))


def test_openings_far_ahead(spark):
    d = dt.date(2024, 1, 1)
    closed = spark.createDataFrame([(d + dt.timedelta(days=k), "holiday") for k in range(800)], schemas.CALENDAR)
    r = trading_days.next_open(spark, closed, dt.datetime(2024, 1, 3, 12)).first()
    assert r["opens_at"] == dt.datetime(2026, 3, 11, 9, 15)
    back = trading_days.lookback_start(spark, closed, d + dt.timedelta(days=800), 15, 3600).first()["start"]
    assert back == dt.datetime(2023, 12, 26, 9, 15)
    assert trading_days.next_open(spark, closed.limit(0), dt.datetime(2024, 1, 5, 16)).first()["opens_at"] == dt.datetime(2024, 1, 8, 9, 15)


def test_scalars(spark):
    row = spark.sql("select ' nse:reliance ' a, '' b, cast(null as string) c, '05-Jan-2026' d1, '2026-01-05' d2, '05/01/2026' d3, 'x' d4").select(
        *[scalars.normal_symbol(c).alias(c) for c in "abc"], *[scalars.any_date(f"d{k}").alias(f"d{k}") for k in range(1, 5)], scalars.mode_label(F.lit(" quote ")).alias("m")
    ).first()
    assert row["a"] == "RELIANCE" and row["b"] is None and row["c"] is None and row["m"] == "Quote"
    assert row["d1"] == row["d2"] == row["d3"] == dt.date(2026, 1, 5) and row["d4"] is None


def test_sides_and_stops(spark):
    rows = spark.sql("select * from values (12.0), (12.01), (8.99), (9.0) t(p)").select(scalars.breakout_side("p", F.lit(12.0), F.lit(9.0)).alias("s")).collect()
    assert [r["s"] for r in rows] == [None, "BUY", "SELL", None]
    r = spark.range(1).select(scalars.stop_price(F.lit("BUY"), F.lit(100.0)).alias("b"), scalars.stop_price(F.lit("SELL"), F.lit(100.0)).alias("s"), scalars.stop_hit(F.lit("BUY"), F.lit(99.8), F.lit(99.8)).alias("h"), scalars.closing_side(F.lit(-3)).alias("c")).first()
    assert (r["b"], r["s"], r["h"], r["c"]) == (pytest.approx(99.8), pytest.approx(100.2), True, "BUY")


def test_config_from_environment():
    c = EngineConfig.from_env({"TIMEFRAMES": "1m, 15m", "MIN_CANDLES": "20"})
    assert c.timeframes == ("1m", "15m") and c.min_candles == 20 and c.retention_minutes == 30
