"""Registry of the market queries and their DuckDB twins, over the events table as ticks.

Types of events are symbols, values are prices, props' k is the quantity, ids give the order of equal times. The
calendar of January 2024 used here is a fixture: 26 January is a holiday, Saturday 20 January a special session.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalars, session, timeframes, trading_days
from tidemark.operators import candles, connections, depth, execution, gaps, indicators, merging, signals
from tidemark.plans import backfill
from tidemark.sources import files

HOLIDAY, SPECIAL = dt.date(2024, 1, 26), dt.date(2024, 1, 20)
FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 1, 30)
AS_OF = dt.datetime(2024, 1, 18, 12, 7)
TODAY = dt.date(2024, 1, 29)
#: Beyond the last event: days on which the feed has not started.
LATER = dt.date(2024, 2, 29)

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(fn: Callable) -> Callable:
        _queries[name] = fn
        if sql:
            _sql[name] = sql
        return fn

    return add


# ---- what the queries share, in Spark and in SQL


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return files.event_ticks(events(spark, d))


def calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(HOLIDAY, "holiday"), (SPECIAL, "special_open")], schemas.CALENDAR)


def bars(spark: SparkSession, d: str, *labels: str) -> DataFrame:
    return candles.ohlcv(ticks(spark, d), labels, calendar(spark))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d).select("symbol").distinct()


def wanted(spark: SparkSession, d: str, *labels: str) -> DataFrame:
    return gaps.expected(symbols(spark, d), trading_days.trading_days(spark, calendar(spark), FIRST, LAST), labels)


TICKS = "ticks AS (SELECT event_type AS symbol, ts, value AS ltp, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, event_id AS seq FROM events)"


def _secs(c: str) -> str:
    return f"(hour({c}) * 3600 + minute({c}) * 60 + CAST(floor(second({c})) AS BIGINT))"


def _trades(c: str) -> str:
    return f"(CAST({c} AS DATE) = DATE '{SPECIAL}' OR (CAST({c} AS DATE) <> DATE '{HOLIDAY}' AND isodow({c}) < 6))"


def _bucket(c: str, width: str | int) -> str:
    return f"(CAST(CAST({c} AS DATE) AS TIMESTAMP) + to_seconds(CAST(33300 + greatest({_secs(c)} - 33300, 0) - (greatest({_secs(c)} - 33300, 0) % {width}) AS BIGINT)))"


def _frames(labels: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"('{t}', {timeframes.seconds(t)})" for t in labels) + ") AS frames(tf, width)"


SESSION = f"{TICKS}, live AS (SELECT * FROM ticks WHERE {_secs('ts')} >= 33300 AND {_secs('ts')} < 55800 AND {_trades('ts')})"


def _bars(*labels: str) -> str:
    return (
        f"{SESSION}, tagged AS (SELECT live.*, tf, width, {_bucket('ts', 'width')} AS bucket FROM live, {_frames(labels)}), "
        "bars AS (SELECT symbol, tf, any_value(width) AS width, bucket AS ts, arg_min(ltp, (ts, seq)) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, (ts, seq)) AS close, sum(qty) AS volume FROM tagged GROUP BY symbol, tf, bucket)"
    )


BAR = "symbol, tf, ts, open, high, low, close, volume"


def _wanted(*labels: str) -> str:
    return (
        f"tdays AS (SELECT CAST(d AS DATE) AS d FROM generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY) AS g(d) WHERE {_trades('d')}), "
        f"wanted AS (SELECT symbol, tf, width, CAST(d AS TIMESTAMP) + to_seconds(CAST(33300 + k * width AS BIGINT)) AS ts FROM (SELECT DISTINCT symbol FROM ticks), tdays, {_frames(labels)}, (SELECT unnest(range(0, 22500)) AS k) WHERE k * width < 22500)"
    )


GAPS = "gaps AS (SELECT w.symbol, w.tf, w.ts FROM wanted w ANTI JOIN bars b ON w.symbol = b.symbol AND w.tf = b.tf AND w.ts = b.ts)"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return candles.ohlcv(ticks(spark, d), ["15m"])


# ---- projections and filters


@query("tick_projection", f"WITH {TICKS} SELECT symbol, ts, ltp, qty, seq FROM ticks")
def _(spark, d):
    return ticks(spark, d)


def _add_bucket(label: str) -> None:
    width = timeframes.seconds(label)

    @query(f"session_bucket_{label}", f"SELECT event_id AS seq, {_bucket('ts', width)} AS bucket FROM events")
    def _(spark, d):
        return events(spark, d).select(F.col("event_id").alias("seq"), session.bucket("ts", width).alias("bucket"))


for _label in ("5s", "90s", "7m", "15m"):
    _add_bucket(_label)


@query("in_session_ticks", f"WITH {SESSION} SELECT symbol, ts, ltp, qty, seq FROM live")
def _(spark, d):
    return trading_days.only_sessions(ticks(spark, d), calendar(spark))


@query("weekday_session_ticks", f"WITH {TICKS} SELECT symbol, ts, ltp, qty, seq FROM ticks WHERE {_secs('ts')} >= 33300 AND {_secs('ts')} < 55800 AND isodow(ts) < 6")
def _(spark, d):
    return trading_days.only_sessions(ticks(spark, d), None)


@query("trading_days", f"SELECT CAST(d AS DATE) AS d FROM generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY) AS g(d) WHERE {_trades('d')}")
def _(spark, d):
    return trading_days.trading_days(spark, calendar(spark), FIRST, LAST)


@query("market_open_flag", f"SELECT event_id AS seq, {_trades('ts')} AND {_secs('ts')} >= 33300 AND {_secs('ts')} < 55800 AS is_open, {_trades('ts')} AND {_secs('ts')} >= 33240 AND {_secs('ts')} < 55800 AS is_connectable FROM events")
def _(spark, d):
    rows = events(spark, d).select(F.col("event_id").alias("seq"), "ts")
    return trading_days.with_market_open(rows, calendar(spark)).drop("ts")


@query("symbol_normalize", "SELECT event_id AS seq, nullif(trim(list_extract(string_split(upper(trim(' nse:' || event_type || ' ')), ':'), -1)), '') AS symbol, upper('NSE:' || event_type) AS key, 'quote_' || lower(regexp_replace(event_type, '[^A-Za-z0-9_]', '', 'g')) AS table_key FROM events")
def _(spark, d):
    raw = F.concat(F.lit(" nse:"), "event_type", F.lit(" "))
    return events(spark, d).select(F.col("event_id").alias("seq"), scalars.normal_symbol(raw).alias("symbol"), scalars.instrument_key(F.lit("nse "), "event_type").alias("key"), scalars.table_key("event_type").alias("table_key"))


@query("timeframe_seconds", "SELECT * FROM (VALUES ('5s', 5), ('1m30s', 90), ('5M', 300), ('1h30m', 1800), ('5ms', 300), ('1h', NULL), ('0m', NULL)) AS t(label, seconds)")
def _(spark, d):
    rows = spark.createDataFrame([(t,) for t in ("5s", "1m30s", "5M", "1h30m", "5ms", "1h", "0m")], "label string")
    return rows.select("label", timeframes.seconds_column("label").cast("int").alias("seconds"))


@query("epoch_round_trip", "SELECT event_id AS seq, ts + INTERVAL 330 MINUTE AS ist, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events")
def _(spark, d):
    rows = events(spark, d).select(F.col("event_id").alias("seq"), F.unix_millis(F.date_trunc("millisecond", F.col("ts").cast("timestamp"))).alias("ms"), "ts")
    ist = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("ts"))
    return rows.select("seq", ist.alias("ist"), session.to_epoch_ms(session.from_epoch_ms("ms")).alias("ms"))


# ---- candles


def _add_bars(name: str, *labels: str) -> None:
    @query(name, f"WITH {_bars(*labels)} SELECT {BAR} FROM bars")
    def _(spark, d):
        return bars(spark, d, *labels)


for _label in ("1m", "5m", "15m", "60m"):
    _add_bars(f"ohlcv_{_label}", _label)
_add_bars("ohlcv_multi_tf", "1m", "5m", "15m", "60m")


@query("ohlcv_live_compat", f"WITH {TICKS} SELECT symbol, '15m' AS tf, {_bucket('ts', 900)} AS ts, arg_min(ltp, (ts, seq)) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, (ts, seq)) AS close, sum(qty) AS volume FROM ticks GROUP BY symbol, {_bucket('ts', 900)}")
def _(spark, d):
    return candles.ohlcv(ticks(spark, d), ["15m"], session_only=False)


@query("closed_candles_asof", f"WITH {_bars('15m', '60m')} SELECT {BAR} FROM bars WHERE ts < {_bucket(f"TIMESTAMP '{AS_OF}'", 'width')}")
def _(spark, d):
    return candles.closed(bars(spark, d, "15m", "60m"), AS_OF)


@query("latest_ltp", f"WITH {TICKS} SELECT symbol, arg_max(ltp, seq) AS ltp FROM ticks GROUP BY symbol")
def _(spark, d):
    return candles.latest(ticks(spark, d))


@query("latest_candle", f"WITH {_bars('15m')} SELECT {BAR} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY ts DESC) = 1")
def _(spark, d):
    return candles.last_rows(bars(spark, d, "15m"), ["symbol", "tf"], ["ts"])


@query("rolling_retention", f"WITH {_bars('15m')} SELECT {BAR} FROM bars QUALIFY ts >= max(ts) OVER (PARTITION BY symbol, tf) - to_seconds({candles.retention_seconds('15m')})")
def _(spark, d):
    return candles.retained(bars(spark, d, "15m"), candles.retention_seconds("15m"), ["symbol", "tf"])


# ---- gaps, merging, backfill


@query("expected_buckets", f"WITH {TICKS}, {_wanted('15m', '60m')} SELECT symbol, tf, ts FROM wanted")
def _(spark, d):
    return wanted(spark, d, "15m", "60m")


@query("missing_candles", f"WITH {_bars('15m', '60m')}, {_wanted('15m', '60m')}, {GAPS} SELECT * FROM gaps")
def _(spark, d):
    return gaps.missing(wanted(spark, d, "15m", "60m"), bars(spark, d, "15m", "60m"))


@query("earliest_missing", f"WITH {_bars('15m')}, {_wanted('15m')}, {GAPS} SELECT symbol, min(ts) AS ts FROM gaps GROUP BY symbol")
def _(spark, d):
    return gaps.earliest_missing(gaps.missing(wanted(spark, d, "15m"), bars(spark, d, "15m")))


@query("residual_missing_counts", f"WITH {_bars('15m', '60m')}, {_wanted('15m', '60m')}, {GAPS} SELECT symbol, tf, count(*) AS n_missing FROM gaps GROUP BY symbol, tf")
def _(spark, d):
    return gaps.residual_counts(gaps.missing(wanted(spark, d, "15m", "60m"), bars(spark, d, "15m", "60m")))


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    """Minute candles dense enough to be rolled up: all events of a day of the week fall on one session clock."""
    rows = events(spark, d).select("event_type", "value", "event_id", (F.col("event_id") % 375).alias("m"))
    ts = F.lit(dt.datetime(2024, 1, 3)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("m") * 60 + 33300).cast("decimal(18,6)"))
    bar = rows.select(F.col("event_type").alias("symbol"), F.lit("1m").alias("tf"), ts.alias("ts"), "value", "event_id")
    return bar.groupBy("symbol", "tf", "ts").agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))


MINUTES = "minutes AS (SELECT event_type AS symbol, TIMESTAMP '2024-01-03 09:15:00' + to_minutes(event_id % 375) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, event_id % 375)"
ROLLED = f"rolled AS (SELECT symbol, tf, {_bucket('ts', 'width')} AS bucket, any_value(width) AS width, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n FROM minutes, {_frames(('5m', '15m', '60m'))} GROUP BY ALL)".replace("GROUP BY ALL", f"GROUP BY symbol, tf, {_bucket('ts', 'width')}")


@query("rollup_derive", f"WITH {MINUTES}, {ROLLED} SELECT symbol, tf, bucket AS ts, open, high, low, close, volume FROM rolled WHERE n * 60 = width")
def _(spark, d):
    return gaps.rolled_up(_minutes(spark, d), ["5m", "15m", "60m"])


@query("rollup_to_close", f"WITH {MINUTES}, {ROLLED} SELECT symbol, tf, bucket AS ts, open, high, low, close, volume FROM rolled WHERE n * 60 = least(width, 55800 - {_secs('bucket')})")
def _(spark, d):
    return gaps.rolled_up(_minutes(spark, d), ["5m", "15m", "60m"], truncate_at_close=True)


def _report(spark: SparkSession, d: str) -> DataFrame:
    need, have = wanted(spark, d, "15m", "60m"), bars(spark, d, "15m", "60m")
    return gaps.coverage(need, have, gaps.missing(need, have), 150)


REPORT = f"{_bars('15m', '60m')}, {_wanted('15m', '60m')}, {GAPS}, report AS (SELECT k.symbol, k.tf, coalesce(h.n, 0) AS n_candles, coalesce(g.n, 0) AS n_missing, CASE WHEN coalesce(h.n, 0) < 150 THEN 'INSUFFICIENT' WHEN coalesce(g.n, 0) > 0 THEN 'DATA MISSING' ELSE 'OK' END AS status FROM (SELECT DISTINCT symbol, tf FROM wanted) k LEFT JOIN (SELECT symbol, tf, count(*) AS n FROM bars GROUP BY ALL) h USING (symbol, tf) LEFT JOIN (SELECT symbol, tf, count(*) AS n FROM gaps GROUP BY ALL) g USING (symbol, tf))"


@query("coverage_report", f"WITH {REPORT} SELECT * FROM report")
def _(spark, d):
    return _report(spark, d)


@query("coverage_overall", f"WITH {REPORT} SELECT bool_and(status = 'OK') AS all_ok, bool_or(status = 'DATA MISSING') AS any_missing, bool_or(status = 'INSUFFICIENT') AS any_insufficient FROM report")
def _(spark, d):
    return gaps.overall(_report(spark, d))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candles built from even and from odd events: two sources that disagree on shared keys."""
    part = lambda k: candles.ohlcv(ticks(spark, d).where(F.col("seq") % 2 == k), ["15m"], calendar(spark))
    return part(0), part(1)


HALVES = f"{SESSION}, " + ", ".join(
    f"half{k} AS (SELECT symbol, '15m' AS tf, {_bucket('ts', 900)} AS bucket, arg_min(ltp, (ts, seq)) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, (ts, seq)) AS close, sum(qty) AS volume FROM live WHERE seq % 2 = {k} GROUP BY symbol, {_bucket('ts', 900)})" for k in (0, 1)
)
BUCKETED = "symbol, tf, bucket AS ts, open, high, low, close, volume"


@query("merge_existing_wins", f"WITH {HALVES} SELECT {BUCKETED} FROM half0 UNION ALL SELECT {BUCKETED} FROM half1 ANTI JOIN half0 USING (symbol, tf, bucket)")
def _(spark, d):
    return merging.existing_wins(*_halves(spark, d))


@query("upsert_newest_wins", f"WITH {HALVES} SELECT {BUCKETED} FROM half1 UNION ALL SELECT {BUCKETED} FROM half0 ANTI JOIN half1 USING (symbol, tf, bucket)")
def _(spark, d):
    old, new = _halves(spark, d)
    return merging.newest_wins(old.withColumn("version", F.lit(0)).union(new.withColumn("version", F.lit(1))))


@query("history_semi_join", f"WITH {HALVES} SELECT {BUCKETED} FROM half1 ANTI JOIN half0 USING (symbol, tf, bucket)")
def _(spark, d):
    local, history = _halves(spark, d)
    return merging.only_wanted(history, gaps.missing(wanted(spark, d, "15m"), local))


def _filled(spark: SparkSession, d: str) -> backfill.Filled:
    """Stored: candles of every third event; ticks: every event not divisible by 5; history: all candles."""
    all_ticks, labels = ticks(spark, d), ["1m", "15m"]
    local = candles.ohlcv(all_ticks.where("seq % 3 = 0"), labels, calendar(spark))
    return backfill.fill(wanted(spark, d, *labels), local, all_ticks.where("seq % 5 <> 0"), bars(spark, d, *labels), labels, calendar(spark), dt.datetime(2024, 2, 1))


def _part(name: str, where: str) -> str:
    return f"{name} AS (SELECT symbol, tf, bucket AS ts, arg_min(ltp, (t.ts, seq)) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, (t.ts, seq)) AS close, sum(qty) AS volume FROM tagged t WHERE {where} GROUP BY symbol, tf, bucket)"


_BEST = "best AS (SELECT * FROM (SELECT 0 AS source_tier, * FROM loc UNION ALL SELECT 1, * FROM built UNION ALL SELECT 2, * FROM hist) QUALIFY row_number() OVER (PARTITION BY symbol, tf, ts ORDER BY source_tier) = 1)"
FILL = (
    f"{_bars('1m', '15m')}, {_wanted('1m', '15m')}, {_part('loc', 'seq % 3 = 0')}, g0 AS (SELECT symbol, tf, ts FROM wanted ANTI JOIN loc USING (symbol, tf, ts)), since AS (SELECT symbol, min(ts) AS s FROM g0 GROUP BY symbol), "
    f"{_part('built', 'seq % 5 <> 0 AND ts >= (SELECT s FROM since WHERE since.symbol = t.symbol)')}, hist AS (SELECT {BAR} FROM bars SEMI JOIN g0 USING (symbol, tf, ts)), {_BEST}, "
    f"mins AS (SELECT * FROM best WHERE tf = '1m'), r AS (SELECT symbol, '15m' AS tf, {_bucket('ts', 900)} AS b, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM mins GROUP BY symbol, {_bucket('ts', 900)} HAVING count(*) = 15), "
    "done AS (SELECT * FROM best UNION ALL SELECT 3, symbol, tf, b, open, high, low, close, volume FROM r WHERE NOT EXISTS (SELECT 1 FROM best x WHERE x.symbol = r.symbol AND x.tf = r.tf AND x.ts = r.b))"
)


@query("gap_fill_tiers", f"WITH {FILL} SELECT {BAR}, source_tier FROM done")
def _(spark, d):
    return _filled(spark, d).candles


@query("gap_fill_report", f"WITH {FILL} SELECT symbol, tf, list_extract(['local', 'ticks', 'history', 'rollup'], source_tier + 1) AS source, count(*) AS n_candles FROM done GROUP BY symbol, tf, source_tier")
def _(spark, d):
    return backfill.filled_by_tier(_filled(spark, d))


@query("lookback_start", f"SELECT min(d) + INTERVAL 33300 SECOND AS start FROM (SELECT CAST(d AS TIMESTAMP) AS d FROM generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '{TODAY - dt.timedelta(days=1)}', INTERVAL 1 DAY) AS g(d) WHERE {_trades('d')} ORDER BY d DESC LIMIT {trading_days.lookback_days(15, 3600)})")
def _(spark, d):
    return trading_days.lookback_start(spark, calendar(spark), TODAY, 15, 3600)


#: A moment on the evening before the special session.
EVENING = dt.datetime(2024, 1, 19, 17, 0)


def _opening(secs: int) -> str:
    return f"SELECT min(opens) AS opens_at, CAST(epoch(min(opens) - TIMESTAMP '{EVENING}') AS DOUBLE) AS seconds FROM (SELECT d + INTERVAL {secs} SECOND AS opens FROM generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LATER}', INTERVAL 1 DAY) AS g(d) WHERE {_trades('d')}) WHERE opens > TIMESTAMP '{EVENING}'"


@query("next_open", _opening(33_300))
def _(spark, d):
    return trading_days.next_open(spark, calendar(spark), EVENING)


@query("pre_connect_wait", _opening(33_240))
def _(spark, d):
    return trading_days.seconds_until_pre_connect(spark, calendar(spark), EVENING)


@query("calendar_refresh", f"SELECT DATE '{SPECIAL}' AS d, 'special_open' AS kind UNION SELECT DISTINCT CAST(ts AS DATE), 'holiday' FROM events WHERE CAST(ts AS DATE) >= DATE '{AS_OF.date()}'")
def _(spark, d):
    fetched = events(spark, d).select(F.col("ts").cast("date").alias("d"))
    return trading_days.refreshed(calendar(spark), fetched, AS_OF.date())


# ---- feeds and stored tables of other shapes


def _epoch_ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


IST_MS = "CAST(date_trunc('millisecond', ts) AS TIMESTAMP) + INTERVAL 330 MINUTE"


@query("typed_ticks", f"SELECT event_type AS symbol, {IST_MS} AS ts, value AS ltp, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(user_id AS DOUBLE) END AS qty, event_id AS seq FROM events WHERE event_id % 10 <> 3")
def _(spark, d):
    """A table in which each tenth price and each fourth quantity is missing."""
    some = lambda c, gone: F.when(~gone, F.col(c))
    rows = events(spark, d).select(F.col("event_type").alias("symbol"), _epoch_ms().alias("timestamp"), F.col("event_id").alias("ingest_ns"), some("value", F.col("event_id") % 10 == 3).alias("ltp"), some("user_id", F.col("event_id") % 4 == 0).alias("last_quantity"))
    return files.typed_ticks(rows)


@query("json_ticks", f"SELECT event_type AS symbol, {IST_MS} AS ts, value AS ltp, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(user_id AS DOUBLE) END AS qty, event_id AS seq FROM events WHERE event_id % 10 <> 3")
def _(spark, d):
    """Raw rows of which each tenth has no number for a price, and each fourth no quantity."""
    price = F.when(F.col("event_id") % 10 == 3, "none").otherwise(F.col("value").cast("string"))
    raw = F.to_json(F.struct(price.alias("ltp"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("last_trade_quantity")))
    return files.json_ticks(events(spark, d).select(F.col("event_type").alias("symbol"), _epoch_ms().alias("timestamp"), F.col("event_id").alias("ingest_ns"), raw.alias("raw_json")))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Feed messages: with a symbol of their own, with that of their envelope, without price, of another type, errors, broken ones."""
    kind = F.col("event_id") % 6
    data = F.struct(
        F.when(kind == 0, F.concat(F.lit("nse:"), "event_type")).alias("symbol"), F.when(kind != 2, F.col("value")).alias("ltp"),
        _epoch_ms().alias("ltt"), F.when(kind == 1, F.col("user_id").cast("double")).alias("last_trade_quantity"),
    )
    envelope = F.struct(F.when(kind == 3, "order").otherwise("market_data").alias("type"), F.when(kind == 4, "error").alias("status"), F.concat(F.lit(" "), "event_type").alias("symbol"), F.when(kind != 4, data).alias("data"))
    raw = F.to_json(envelope)
    return events(spark, d).select("event_id", F.when(kind == 5, F.substring(raw, 1, 30)).otherwise(raw).alias("value"))


@query("quote_messages", f"SELECT upper(event_type) AS symbol, {IST_MS} AS ts, value AS ltp, CASE event_id % 6 WHEN 1 THEN CAST(user_id AS DOUBLE) ELSE 0.0 END AS qty, event_id AS seq FROM events WHERE event_id % 6 < 2")
def _(spark, d):
    return files.quote_messages(_messages(spark, d), seq="event_id")


@query("feed_errors", "SELECT count(*) AS n FROM events WHERE event_id % 6 = 4")
def _(spark, d):
    return files.feed_errors(_messages(spark, d)).agg(F.count("*").alias("n"))


@query("history_candles", f"WITH {_bars('15m')} SELECT symbol, tf, ts + INTERVAL 330 MINUTE AS ts, open, high, low, close, volume FROM bars")
def _(spark, d):
    rows = bars(spark, d, "15m")
    raw = F.to_json(F.struct(F.col("tf").alias("interval"), "open", "high", "low", "close", "volume"))
    return files.history_candles(rows.select("symbol", _epoch_ms().alias("timestamp"), raw.alias("raw_json"))).select(*candles.CANDLE_COLUMNS)


@query("instruments_by_exchange", "SELECT r_name AS exchange, string_agg(n_name, ',' ORDER BY n_nationkey) AS symbols FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    listed = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return files.by_exchange(listed.select(F.col("r_name").alias("exchange"), F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("position")))


@query("date_forms", "SELECT event_id AS seq, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS DATE) END AS d FROM events")
def _(spark, d):
    """Dates in three forms, and texts that are none."""
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format("ts", "dd-MMM-yyyy")).when(kind == 1, F.date_format("ts", " yyyy-MM-dd ")).when(kind == 2, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.date_format("ts", "yyyy.MM.dd"))
    return events(spark, d).select(F.col("event_id").alias("seq"), scalars.any_date(text).alias("d"))


@query("mode_labels", "SELECT event_id AS seq, upper(event_type[1]) || lower(event_type[2:]) AS mode FROM events")
def _(spark, d):
    return events(spark, d).select(F.col("event_id").alias("seq"), scalars.mode_label(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("mode"))


# ---- indicators


TR = "WITH {bars}, lagged AS (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY ts)), moved AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr, CASE WHEN high - ph > abs(low - pl) AND high - ph > 0 THEN high - ph ELSE 0.0 END AS plus_dm FROM lagged), dm AS (SELECT *, CASE WHEN abs(low - pl) > plus_dm AND abs(low - pl) > 0 THEN abs(low - pl) ELSE 0.0 END AS minus_dm FROM moved)"
_W = "OVER (PARTITION BY symbol, tf ORDER BY ts ROWS 13 PRECEDING)"


def _mean(c: str) -> str:
    return f"CASE WHEN count({c}) {_W} = 14 THEN avg({c}) {_W} END"


ADX = (
    TR.replace("{bars}", _bars("15m", "60m"))
    + f", m AS (SELECT *, {_mean('tr')} AS a, {_mean('plus_dm')} AS p, {_mean('minus_dm')} AS q FROM dm), di AS (SELECT *, 100 * p / nullif(a, 0) AS plus_di, 100 * q / nullif(a, 0) AS minus_di FROM m), x AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di), adx AS (SELECT *, {_mean('dx')} AS value, count(*) OVER (PARTITION BY symbol, tf) >= 15 AS ready FROM x)"
)


@query("true_range", TR.replace("{bars}", _bars("15m")) + " SELECT symbol, tf, ts, tr FROM dm")
def _(spark, d):
    return indicators.true_range(bars(spark, d, "15m")).select("symbol", "tf", "ts", "tr")


@query("directional_movement", TR.replace("{bars}", _bars("15m")) + " SELECT symbol, tf, ts, plus_dm, minus_dm FROM dm")
def _(spark, d):
    return indicators.directional_movement(bars(spark, d, "15m")).select("symbol", "tf", "ts", "plus_dm", "minus_dm")


def _adx(spark: SparkSession, d: str) -> DataFrame:
    return indicators.compute("adx", bars(spark, d, "15m", "60m"))


@query("adx_14", f"{ADX} SELECT symbol, tf, ts, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di, round(dx, 6) AS dx, round(value, 6) AS value, ready FROM adx")
def _(spark, d):
    return _adx(spark, d).select("symbol", "tf", "ts", *[F.round(c, 6).alias(c) for c in ("plus_di", "minus_di", "dx", "value")], "ready")


@query("adx_latest", f"{ADX} SELECT symbol, tf, round(value, 6) AS value FROM adx QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY ts DESC) = 1")
def _(spark, d):
    return indicators.latest_value(_adx(spark, d)).select("symbol", "tf", F.round("value", 6).alias("value"))


@query("adx_last3", f"{ADX}, k AS (SELECT symbol, tf, value, row_number() OVER (PARTITION BY symbol, tf ORDER BY ts DESC) AS n FROM adx WHERE ready AND value IS NOT NULL) SELECT symbol, tf, round(max(CASE WHEN n = 3 THEN value END), 6) AS v1, round(max(CASE WHEN n = 2 THEN value END), 6) AS v2, round(max(CASE WHEN n = 1 THEN value END), 6) AS v3 FROM (SELECT DISTINCT symbol, tf FROM adx) LEFT JOIN k USING (symbol, tf) GROUP BY symbol, tf")
def _(spark, d):
    rows = indicators.last_values(_adx(spark, d), 3)
    return rows.select("symbol", "tf", *[F.round(F.get("values", k), 6).alias(f"v{k + 1}") for k in range(3)])


# ---- signals and execution


@query("prev_candle_levels", f"WITH {_bars('60m')} SELECT symbol, tf, ts, lag(ts) OVER w AS ref_ts, lag(high) OVER w AS ref_high, lag(low) OVER w AS ref_low FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY ts)")
def _(spark, d):
    return signals.previous_levels(bars(spark, d, "60m")).select("symbol", "tf", "ts", "ref_ts", "ref_high", "ref_low")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.breakouts(ticks(spark, d), "60m", calendar(spark))


SIGNALS = (
    f"{_bars('60m')}, refs AS (SELECT symbol, ts + INTERVAL 1 MICROSECOND AS known, ts AS ref_ts, high, low FROM bars), known_levels AS (SELECT l.symbol, l.ts, l.seq, l.ltp, r.ref_ts, r.high, r.low FROM (SELECT *, {_bucket('ts', 3600)} AS bucket FROM live) l ASOF JOIN refs r ON l.symbol = r.symbol AND l.bucket >= r.known), "
    "hits AS (SELECT *, CASE WHEN ltp > high THEN 'BUY' WHEN ltp < low THEN 'SELL' END AS side FROM known_levels), signals AS (SELECT symbol, 'NSE' AS exchange, ref_ts, ts, seq, side, ltp AS price FROM hits WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ref_ts ORDER BY ts, seq) = 1)"
)
STOPS = f"{SIGNALS}, stops AS (SELECT *, CASE WHEN side = 'BUY' THEN price * (1 - 0.002) ELSE price * (1 + 0.002) END AS stop FROM signals)"
EXITS = f"{STOPS}, exits AS (SELECT s.*, x.ts AS exit_ts, x.seq AS exit_seq, x.ltp AS exit_price FROM stops s LEFT JOIN LATERAL (SELECT ts, seq, ltp FROM live l WHERE l.symbol = s.symbol AND (l.ts, l.seq) > (s.ts, s.seq) AND CASE WHEN s.side = 'BUY' THEN ltp <= stop ELSE ltp >= stop END ORDER BY ts, seq LIMIT 1) x ON true)"
LEDGER = (
    EXITS.replace("WITH ", "")
    + ", ordered AS (SELECT *, row_number() OVER (ORDER BY ts, seq, symbol) AS n FROM exits), trades AS (SELECT 1 AS trade, * FROM ordered WHERE n = 1 UNION ALL SELECT t.trade + 1, o.* FROM trades t JOIN ordered o ON o.n = (SELECT min(n) FROM ordered WHERE (ts, seq) > (t.exit_ts, t.exit_seq)))"
)
TRADES = "CAST(trade AS BIGINT) AS trade, symbol, side, ts AS entry_ts, seq AS entry_seq, price AS entry_price, stop, exit_ts, exit_seq, exit_price"


@query("breakout_signals", f"WITH {SIGNALS} SELECT * FROM signals")
def _(spark, d):
    return _signals(spark, d)


@query("stoploss_levels", f"WITH {STOPS} SELECT * FROM stops")
def _(spark, d):
    return execution.with_stops(_signals(spark, d))


def _exits(spark: SparkSession, d: str) -> DataFrame:
    live = trading_days.only_sessions(ticks(spark, d), calendar(spark))
    return execution.first_hits(execution.with_stops(_signals(spark, d)), live)


@query("stoploss_first_hit", f"WITH {EXITS} SELECT * FROM exits")
def _(spark, d):
    return _exits(spark, d)


@query("position_ledger", f"WITH RECURSIVE {LEDGER} SELECT {TRADES} FROM trades")
def _(spark, d):
    return execution.ledger(_exits(spark, d))


@query("order_intents", f"WITH RECURSIVE {LEDGER} SELECT ts, symbol, side, price, 'ENTRY' AS kind FROM trades UNION ALL SELECT exit_ts, symbol, CASE side WHEN 'BUY' THEN 'SELL' ELSE 'BUY' END, exit_price, 'EXIT' FROM trades WHERE exit_ts IS NOT NULL")
def _(spark, d):
    return execution.order_intents(execution.ledger(_exits(spark, d)))


@query("square_off", f"WITH RECURSIVE {LEDGER} SELECT CAST(trade AS BIGINT) AS trade, symbol, side, ts AS entry_ts, seq AS entry_seq, price AS entry_price, stop, coalesce(exit_ts, TIMESTAMP '2024-01-31 15:30:00') AS exit_ts, exit_seq, CASE WHEN exit_ts IS NULL THEN (SELECT arg_max(ltp, k.seq) FROM ticks k WHERE k.symbol = trades.symbol) ELSE exit_price END AS exit_price, CASE WHEN exit_ts IS NULL THEN 'SQUARE_OFF' ELSE 'STOP' END AS reason FROM trades")
def _(spark, d):
    return execution.square_off(execution.ledger(_exits(spark, d)), candles.latest(ticks(spark, d)), dt.datetime(2024, 1, 31, 15, 30))


@query("closing_orders", "SELECT symbol, exchange, CASE WHEN quantity > 0 THEN 'SELL' ELSE 'BUY' END AS side, CAST(abs(quantity) AS BIGINT) AS quantity FROM (SELECT event_type AS symbol, 'NSE' AS exchange, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS quantity FROM events GROUP BY event_type) WHERE quantity <> 0")
def _(spark, d):
    held = events(spark, d).groupBy(F.col("event_type").alias("symbol")).agg(F.sum(F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)).alias("quantity"))
    return execution.closing_orders(held.withColumn("exchange", F.lit("NSE")))


# ---- depth and connections


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Depth messages made from events: some with bids and asks, some with other names, some with an empty side or none."""
    e, price = events(spark, d), F.col("value")
    level = lambda p: F.array(F.struct(p.alias("price"), F.col("user_id").alias("quantity")))
    none = F.array().cast(schemas.LEVELS)
    kind = F.col("event_id") % 4
    data = F.struct(
        F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ltt"), price.alias("ltp"),
        F.when(kind == 0, level(price - 1)).otherwise(none).alias("bids"), F.when(kind < 2, level(price + 1)).otherwise(none).alias("asks"),
        F.when(kind == 2, level(price - 2)).alias("buy"), F.when(kind == 2, level(price + 2)).alias("sell"),
        F.struct(none.alias("buy"), none.alias("sell")).alias("depth"),
    )
    return depth.snapshots(e.select(F.lit(None).cast("string").alias("symbol"), data.alias("data")))


BOOKS = "books AS (SELECT upper(event_type) AS symbol, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, value AS ltp, CASE event_id % 4 WHEN 0 THEN value - 1 WHEN 2 THEN value - 2 END AS bid, CASE event_id % 4 WHEN 0 THEN value + 1 WHEN 1 THEN value + 1 WHEN 2 THEN value + 2 END AS ask FROM events WHERE event_id % 4 < 3)"


@query("depth_snapshots", f"WITH {BOOKS} SELECT symbol, ts_ms, ltp, bid, ask FROM books")
def _(spark, d):
    return _books(spark, d).select("symbol", "ts_ms", "ltp", scalars.head("bids")["price"].alias("bid"), scalars.head("asks")["price"].alias("ask"))


@query("best_bid_ask", f"WITH {BOOKS} SELECT symbol, ts_ms, bid AS best_bid, ask AS best_ask FROM books QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) = 1")
def _(spark, d):
    return depth.best(_books(spark, d))


@query("depth_log", f"WITH {BOOKS} SELECT symbol, ts_ms, ltp, bid, ask FROM books")
def _(spark, d):
    """Prices read back from the log's JSON."""
    price = lambda side: scalars.json_number("raw_json", f"$.{side}[0].price")
    return depth.log_rows(_books(spark, d)).select("symbol", "ts_ms", "ltp", price("bids").alias("bid"), price("asks").alias("ask"))


@query("depth_history", f"WITH {BOOKS} SELECT symbol, ts_ms, ltp FROM books QUALIFY ts_ms >= max(ts_ms) OVER (PARTITION BY symbol) - 86400000")
def _(spark, d):
    return depth.history(_books(spark, d), 86_400).select("symbol", "ts_ms", "ltp")


def _connections(spark: SparkSession, d: str) -> DataFrame:
    """A log made from all events: those with ids divisible by three connect, the others lose the connection."""
    rows = events(spark, d)
    kind = F.when(F.col("event_id") % 3 == 0, connections.CONNECT).otherwise(connections.LOST)
    return rows.select("event_id", kind.alias("event"), (F.unix_millis(F.col("ts").cast("timestamp")) * 100 + F.col("event_id") % 100).alias("ts_ms"), F.col("ts").cast("date").alias("day"))


LOG = "log AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'CONNECT' ELSE 'DISCONNECTED' END AS event, CAST(epoch_us(ts) // 1000 AS BIGINT) * 100 + event_id % 100 AS ts_ms, CAST(ts AS DATE) AS day FROM events)"


@query("connection_classify", f"WITH {LOG} SELECT event_id, ts_ms, day, CASE WHEN event <> 'CONNECT' THEN event WHEN row_number() OVER (PARTITION BY day, event ORDER BY ts_ms) = 1 THEN 'DAY_STARTED' ELSE 'RECONNECTED' END AS event FROM log")
def _(spark, d):
    return connections.classified(_connections(spark, d)).select("event_id", "ts_ms", "day", "event")


@query("connections_of_day", f"WITH {LOG} SELECT event_id, ts_ms, day, event FROM log WHERE day = DATE '{AS_OF.date()}'")
def _(spark, d):
    return connections.of_day(_connections(spark, d), AS_OF.date()).select("event_id", "ts_ms", "day", "event")


@query("day_not_started", f"WITH {LOG} SELECT 'DAY_NOT_STARTED' AS event, CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LATER}', INTERVAL 1 DAY) AS g(d) WHERE {_trades('d')} AND CAST(d AS DATE) NOT IN (SELECT day FROM log)")
def _(spark, d):
    return connections.not_started(trading_days.trading_days(spark, calendar(spark), FIRST, LATER), _connections(spark, d))


@query("feed_outages", f"WITH {LOG} SELECT day, ts_ms AS lost_ms, back_ms FROM (SELECT *, min(CASE WHEN event = 'CONNECT' THEN ts_ms END) OVER (PARTITION BY day ORDER BY ts_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back_ms FROM log) WHERE event = 'DISCONNECTED'")
def _(spark, d):
    return connections.outages(_connections(spark, d), "event_id")


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
