"""Exact histogram of encoded lengths, and the answers its suffix sums give for every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm.encoding import default_path, encoder

#: Lengths whose running totals one task adds up.
BLOCK = 4096


def histogram(docs: DataFrame, tokenizer: str | None = None, end_ids: int = 1) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length, end_ids added to each.

    Null and empty texts have end_ids alone; repeated rows count each time; no rows give no rows. Other columns are
    left out. Each task adds up its own documents first, so a third of all rows of one length is one row per task.
    """
    name = tokenizer or default_path()
    shared.small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(name), Counter()
        for batch in shared.together(batches):
            seen.update(len(ids) // 4 + end_ids for ids in own.many(shared.texts_of(batch)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    counts = shared.spread(docs.select("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def totals(hist: DataFrame) -> DataFrame:
    """One row per length that occurs, taken as context limit.

    n_docs have this length; docs_over and tokens_over are of longer documents, docs_within and tokens_within of the
    others; truncated_total is what stays when each document is cut at the limit; quantile is the share of documents
    within. A limit between two lengths has the row of the lower one, but for truncated_total, which answer() adds.
    """
    hist = shared.stored(hist.withColumn("tokens", F.col("n_docs") * F.col("n_tokens")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    rows = shared.running_totals(hist, "block", "n_tokens", {"docs_before": "n_docs", "tokens_before": "tokens"})
    all_docs, all_tokens = hist.agg(F.sum("n_docs"), F.sum("tokens")).first()
    rows = rows.withColumn("all_docs", F.lit(all_docs)).withColumn("all_tokens", F.lit(all_tokens))
    within, tokens_within = F.col("docs_before") + F.col("n_docs"), F.col("tokens_before") + F.col("tokens")
    rows = rows.withColumn("docs_within", within).withColumn("tokens_within", tokens_within)
    rows = rows.withColumn("docs_over", F.col("all_docs") - F.col("docs_within")).withColumn("tokens_over", F.col("all_tokens") - F.col("tokens_within"))
    return rows.select(
        "n_tokens", "n_docs", "docs_within", "tokens_within", "docs_over", "tokens_over",
        (F.col("tokens_within") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def answer(table: DataFrame, limit: int) -> DataFrame:
    """For any limit, one row: documents and tokens within it, and all tokens when documents are cut at it."""
    within = F.col("n_tokens") <= limit
    sums = table.agg(*[F.coalesce(F.sum(F.when(c, x)), F.lit(0)).alias(n) for n, c, x in (
        ("docs_within", within, F.col("n_docs")), ("tokens_within", within, F.col("n_docs") * F.col("n_tokens")), ("over", ~within, F.col("n_docs")),
    )])
    return sums.select("docs_within", "tokens_within", (F.col("tokens_within") + F.col("over") * limit).alias("truncated_total"))


def quantile(table: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least share of all documents are within."""
    return table.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op10_length_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(histogram(shared.read(spark, sf_dir, "documents")))
