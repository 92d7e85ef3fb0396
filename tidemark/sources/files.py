"""Readers of files: instruments, calendar, ticks of several shapes, candles, logs. Every schema is explicit."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import scalars, session
from tidemark.operators import depth


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """exchange, symbol, key, position: rows with both fields, upper-cased; of equal keys the first line."""
    rows = spark.read.schema(schemas.INSTRUMENT).option("header", True).csv(path)
    rows = rows.select(F.upper(scalars.strip("exchange")).alias("exchange"), F.upper(scalars.strip("symbol")).alias("symbol"), F.monotonically_increasing_id().alias("line"))
    rows = rows.where("exchange <> '' and symbol <> ''").withColumn("key", scalars.instrument_key("exchange", "symbol"))
    first = rows.groupBy("key").agg(F.min(F.struct("line", "exchange", "symbol")).alias("r"))
    return first.select("r.exchange", "r.symbol", "key", F.col("r.line").alias("position")).orderBy("position")


def by_exchange(listed: DataFrame) -> DataFrame:
    """exchange, symbols: an exchange's symbols in the order of the file, comma-joined."""
    symbols = F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))), lambda x: x["symbol"])
    return listed.groupBy("exchange").agg(F.array_join(symbols, ",").alias("symbols"))


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """d, kind of a calendar file. A missing file, or one that cannot be read, gives no rows; dates that are none are left out."""
    empty = spark.createDataFrame([], schemas.CALENDAR)
    try:
        rows = spark.read.schema(schemas.CALENDAR_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return empty
    kinds = [rows.select(F.explode(c).alias("text"), F.lit(kind).alias("kind")) for c, kind in (("holidays", "holiday"), ("special_open", "special_open"))]
    return kinds[0].union(kinds[1]).select(F.to_date(F.try_to_timestamp("text", F.lit("yyyy-MM-dd"))).alias("d"), "kind").where("d is not null").distinct()


def fetched_holidays(spark: SparkSession, path: str) -> DataFrame:
    """d: holidays of an exchange's response, over all its segments, in any of its field names and date forms."""
    row = "array<struct<tradingDate:string,trade_date:string,Date:string>>"
    rows = spark.read.schema(f"CM {row}, FO {row}").option("multiLine", True).json(path)
    listed = rows.select(F.explode(F.concat(F.coalesce("CM", F.array().cast(row)), F.coalesce("FO", F.array().cast(row)))).alias("r"))
    return listed.select(scalars.any_date(F.coalesce("r.tradingDate", "r.trade_date", "r.Date")).alias("d")).where("d is not null").distinct()


def write_calendar(table: DataFrame, path: str) -> None:
    """One JSON object with both lists. A calendar has a few dates a year."""
    listed = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.date_format("d", "yyyy-MM-dd"))))
    table.agg(listed("holiday").alias("holidays"), listed("special_open").alias("special_open")).coalesce(1).write.mode("overwrite").json(path)


def typed_ticks(rows: DataFrame) -> DataFrame:
    """Ticks of a table with symbol, timestamp (epoch ms), ingest_ns, ltp and last_quantity. Only these columns are read."""
    return rows.where("ltp is not null").select("symbol", session.from_epoch_ms("timestamp").alias("ts"), "ltp", F.coalesce("last_quantity", F.lit(0)).cast("double").alias("qty"), F.col("ingest_ns").alias("seq"))


def json_ticks(rows: DataFrame) -> DataFrame:
    """Ticks of a table with symbol, timestamp, ingest_ns and raw_json; rows whose price is no number are left out."""
    parsed = rows.select("symbol", session.from_epoch_ms("timestamp").alias("ts"), scalars.json_number("raw_json", "$.ltp").alias("ltp"), F.coalesce(scalars.json_number("raw_json", "$.last_trade_quantity"), F.lit(0.0)).alias("qty"), F.col("ingest_ns").alias("seq"))
    return parsed.where("ltp is not null")


def event_ticks(events: DataFrame) -> DataFrame:
    """Ticks of the benchmark's event table: types as symbols, values as prices, times as IST wall clock."""
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("ltp"), scalars.json_number("props", "$.k").alias("qty"), F.col("event_id").alias("seq"))


def history_candles(rows: DataFrame) -> DataFrame:
    """Candles of a table with symbol, timestamp and raw_json that holds prices, volume and the interval."""
    number = lambda name: scalars.json_number("raw_json", f"$.{name}").alias(name)
    return rows.select("symbol", F.get_json_object("raw_json", "$.interval").alias("tf"), session.from_epoch_ms("timestamp").alias("ts"), *[number(n) for n in ("open", "high", "low", "close", "volume")])


def candle_partitions(spark: SparkSession, path: str) -> DataFrame:
    """A candle table partitioned by tf, symbol and day, with day as the partition column; none yet gives no rows."""
    schema = f"{schemas.CANDLE}, day date"
    try:
        return spark.read.schema(schema).parquet(path).where("ts is not null")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def candle_table(spark: SparkSession, path: str) -> DataFrame:
    return candle_partitions(spark, path).drop("day")


def readable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of those Parquet files, and of those row groups before the first broken one in a file, that can be read."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def candle_file(spark: SparkSession, path: str, symbol: str, tf: str) -> DataFrame:
    """A single-series candle file from elsewhere: wall-clock times as they are, times with a zone (nanoseconds too) as IST.

    A missing or broken file, or one without the columns of a candle, gives no rows, a file that breaks off those before.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        rows = spark.read.option("ignoreCorruptFiles", True).parquet(path)
    except (AnalysisException, SparkException):
        return spark.createDataFrame([], schemas.CANDLE)
    kind = rows.schema["timestamp"].dataType.simpleString() if "timestamp" in rows.columns else ""
    to_ist = lambda c: F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), c.cast("timestamp_ntz"))
    ts = {"timestamp_ntz": F.col("timestamp"), "timestamp": to_ist(F.col("timestamp")), "bigint": to_ist(F.timestamp_micros((F.col("timestamp") / 1000).cast("bigint")))}.get(kind)
    if ts is None or not {"open", "high", "low", "close", "volume"} <= {*rows.columns}:
        return spark.createDataFrame([], schemas.CANDLE)
    values = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return rows.select(F.lit(symbol).alias("symbol"), F.lit(tf).alias("tf"), ts.alias("ts"), *values).where("ts is not null")


def depth_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    """Books of raw JSON messages; what is no depth message or has no levels is left out."""
    parsed = messages.select(F.from_json(F.col(column).cast("string"), schemas.DEPTH_MESSAGE).alias("m")).select("m.*")
    return depth.snapshots(parsed.where("type = 'market_data'"))


def quote_messages(messages: DataFrame, column: str = "value", seq: str | None = None) -> DataFrame:
    """Ticks of raw JSON messages; broken JSON, other types and quotes without symbol or price are left out.

    seq: the column that tells in which order messages came, of any type that has an order.
    """
    order = F.col(seq) if seq else F.lit(0).cast("bigint")
    parsed = messages.select(F.from_json(F.col(column).cast("string"), schemas.QUOTE_MESSAGE).alias("m"), order.alias("seq"))
    rows = parsed.where("m.type = 'market_data'").select(
        scalars.resolved_symbol("m.data.symbol", "m.symbol").alias("symbol"), session.from_epoch_ms("m.data.ltt").alias("ts"),
        F.col("m.data.ltp").alias("ltp"), F.coalesce("m.data.last_trade_quantity", F.lit(0.0)).alias("qty"), "seq",
    )
    return rows.where("symbol is not null and ltp is not null")


def feed_errors(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages by which the feed reports an error."""
    parsed = messages.select(F.col(column).cast("string").alias("raw"), F.from_json(F.col(column).cast("string"), schemas.QUOTE_MESSAGE).alias("m"))
    return parsed.where("m.status = 'error'").select("raw")


def connection_log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(schemas.CONNECTION).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.CONNECTION)
