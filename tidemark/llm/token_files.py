"""Token ids in ORC: run-length encoded integers in stripes, row indexes, Bloom filters on document ids.

Files are in ascending doc_id order (null ids first), so that stripe and row-group statistics
prune by id and stripes can be read in parallel. A row keeps where its ids begin in its file; the start in the whole
collection adds the ids of the files before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import shared
from tidemark.llm.encoding import default_path, encoder

FILE_SCHEMA = "doc_id long, file_start long, ids array<int>"
END = (0).to_bytes(4, "little")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, stripe_mb: int = 16, index_rows: int = 1000, compress: str = "zstd") -> None:
    """Encodes docs (doc_id, text; other columns are left out) and writes them to path.

    A null or empty text has the end id alone; whole texts are encoded, however long. Repeated rows are written as
    often as they come; rows of one id, or of none, may lie in several files. No rows: a folder without ids, which
    read() accepts.
    """
    name = tokenizer or default_path()
    shared.small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = encoder(name), 0
        for batch in shared.together(batches):
            parts = [ids + END for ids in own.many(shared.texts_of(batch))]
            ends = np.cumsum([0, *[len(p) // 4 for p in parts]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ends[:-1] + at), lists], ["doc_id", "file_start", "ids"])
            at += int(ends[-1])

    # The range sort comes before the encoding: sampling for its bounds then encodes nothing.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash splits what rows of one id there are
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    (
        rows.mapInArrow(encode, FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", index_rows)
        .option("orc.stripe.size", stripe_mb << 20)
        .option("orc.compress", compress)
        .option("maxRecordsPerFile", 0)  # a task writes one file, as file_start counts from its beginning
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file_start, ids and the file each row lies in. Filters on doc_id reach stripe statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).select("*", F.col("_metadata.file_name").alias("file"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    shared.small_batches(spark)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        ends, values = lists.offsets.to_numpy(), np.asarray(lists.values, dtype="<u4")
        crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("file_start"), pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())], ["file", "doc_id", "file_start", "n_tokens", "ids_crc32"])

    rows = shared.arrow_rows(read(spark, path), digest, "file string, doc_id long, file_start long, n_tokens long, ids_crc32 long")
    rows = shared.stored(rows)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # part files are numbered in the order of the ranges
    before = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("file_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_dir(spark)
    write(shared.read(spark, sf_dir, "documents"), path)
    return digests(spark, path)
