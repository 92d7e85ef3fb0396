"""Pieces that several text operators use: reading tables, shared folders, offsets, Arrow plumbing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Only a local session, whose executors share the driver's disk, may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    path = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Folders that this driver has made and not removed.
_made: list[str] = []


def made() -> int:
    """How many folders there are now; see release()."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Removes the folders made since made() gave that number, but for the last ones. Only for when nothing that reads them will run again."""
    gone = _made[since : len(_made) - last]
    for path in gone:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        _made.remove(path)


def stored(df: DataFrame, codec: str = "zstd", narrow: int = 1) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors.

    narrow: of how many shuffle partitions one task writes a file. They are sized for texts; tables of a few numbers a row
    would be so many tiny files, each of which costs a shared file system several calls.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if narrow > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // narrow))
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that a function of arrow_rows() gets at once, but for a longer single text.
SLICE_BYTES = 4 << 20
_TEXTS = ("text", "text_a", "text_b", "data")


def sliced(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text, so that a task's memory does not follow the length of its texts."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for name in _TEXTS:
        if name in batch.schema.names:
            sizes += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + (most or SLICE_BYTES), side="right")))
        yield batch.slice(start, end - start)
        start = end


def together(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches joined up to so many bytes: what many texts share is then worked out once for them. None grows past that but by its last batch."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= (most or SLICE_BYTES):
            yield _joined(some)
            some, size = [], 0
    if some:
        yield _joined(some)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def arrow_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function of a few rows of bounded text; empty results are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


#: Rows of an Arrow batch, at most: one value for all operators, as plans read it when they run.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are kept short, as one text may have megabytes. This holds for the session from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null ones as empty ones."""
    return [t or "" for t in batch.column(name).to_pylist()]


def spread(df: DataFrame, column: str = "text") -> DataFrame:
    """Enough input partitions for the cores where the table has only a few files or row groups."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def running_totals(df: DataFrame, block: str, order: str, totals: dict[str, str]) -> DataFrame:
    """For each (name: value) in totals, name is the sum of value over all rows before, by block and then by order.

    Blocks follow each other by their least order. Only one row per block meets in a single task.
    """
    sums = df.groupBy(block).agg(F.min(order).alias("_least"), *[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    before = Window.orderBy(F.col("_least").asc_nulls_first(), F.col(block)).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(block), *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals])
    inside = Window.partitionBy(block).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, block)
    for n, v in totals.items():
        joined = joined.withColumn(n, (F.col(f"_before_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).cast("long"))
    return joined.drop(*[f"_before_{n}" for n in totals])


def count_of(array: str, field: str, value: int) -> Column:
    """How many structs of an array have a value in a field."""
    return F.size(F.filter(array, lambda x: x[field] == value)).cast("long")


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
