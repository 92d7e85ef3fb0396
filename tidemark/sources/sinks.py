"""Writers: candle upserts, append-only logs, order intents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import merging
from tidemark.sources import files

PARTITIONS = ["tf", "symbol", "day"]


def upsert_candles(new: DataFrame, path: str) -> None:
    """Writes candles to a table partitioned by timeframe, symbol and day; of equal keys the new candle stays.

    Only partitions that new has rows in are rewritten, and only those of its days and timeframes are read. Merged rows
    go to a staging folder first, as a plan must not read what it overwrites. Each partition is then replaced as a
    whole; several of them are not one atomic commit, so a run that fails between them has to be repeated, which gives
    the same table. A table has one writer at a time.
    """
    spark = new.sparkSession
    fresh = new.where("ts is not null").withColumn("day", F.col("ts").cast("date"))
    stored = stored_beside(fresh, path).drop("day")
    rows = stored.withColumn("version", F.lit(0)).unionByName(fresh.select(*stored.columns).withColumn("version", F.lit(1)))
    merged = merging.newest_wins(rows).withColumn("day", F.col("ts").cast("date"))
    staging = f"{path.rstrip('/')}_staging_{uuid.uuid4().hex}"
    merged.write.parquet(staging)
    ready = spark.read.schema(f"{schemas.CANDLE}, day date").parquet(staging)
    ready.repartition(*PARTITIONS).sortWithinPartitions("ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    _remove(spark, staging)


def stored_beside(fresh: DataFrame, path: str) -> DataFrame:
    """Stored candles, with day, of the partitions that fresh (with day) has rows in. The filter on days and timeframes
    prunes partitions before anything is listed or read; it is two dates and a few labels, however many rows are new."""
    bounds = fresh.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.collect_set("tf").alias("tfs")).first()
    stored = files.candle_partitions(fresh.sparkSession, path)
    if bounds["first"] is None:
        return stored.where(F.lit(False))
    near = stored.where(F.col("day").between(F.lit(bounds["first"]), F.lit(bounds["last"])) & F.col("tf").isin(bounds["tfs"]))
    return near.join(fresh.select(*PARTITIONS).distinct(), PARTITIONS, "left_semi")


def _remove(spark, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def append_depth(books: DataFrame, path: str) -> None:
    """Depth log rows by day, sorted for range reads by symbol and time."""
    from tidemark.functions import session
    from tidemark.operators import depth

    rows = depth.log_rows(books).withColumn("day", session.from_epoch_ms("ts_ms").cast("date"))
    rows.repartition("day").sortWithinPartitions("symbol", "ts_ms").write.mode("append").partitionBy("day").parquet(path)


def append_connections(events: DataFrame, path: str) -> None:
    events.select("event", "ts_ms", "day", "mode", "note").write.mode("append").parquet(path)


def append_orders(intents: DataFrame, path: str) -> None:
    intents.write.mode("append").parquet(path)
