"""Counts of keys over a whole corpus without a row per key: blocks of documents ask, ranges of keys answer.

A block is some megabytes of whole texts. It sends each of its distinct keys once with its count, sorted, one row for
each range of keys; a range adds up what all blocks sent, which is its part of the count table, and answers every block
in the block's own order. So a frequent key comes once from each block, and a group holds one range of keys. Where
there are more ranges than keys in a block, rows hold single keys: there are never more rows than distinct keys of
blocks. Keys keep 24 bits more than the corpus' number of bytes needs, at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm import shared

#: Text bytes of a block, and of the corpus behind one range of keys.
BLOCK_BYTES, PART_BYTES = 4 << 20, 1 << 20
#: Blocks of a partition are numbered in so many bits, texts of a block likewise.
BLOCK_BITS, ROW_BITS = 19, 24
_SPARE_BITS = 24


@dataclass(frozen=True)
class Space:
    """How keys are cut to their leading bits and dealt out to ranges."""

    bits: int
    parts: int

    def cut(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.bits)

    def part(self, cut: np.ndarray) -> np.ndarray:
        return (((cut >> np.uint64(self.bits - 32)) * np.uint64(self.parts)) >> np.uint64(32)).astype(np.int64)


def space(docs: DataFrame, part_bytes: int = PART_BYTES) -> Space:
    n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return Space(min(64, max(32, max(1, n).bit_length() + _SPARE_BITS)), min(1 << 31, max(1, -(-n // part_bytes))))


def packed(values: np.ndarray) -> bytes:
    """Numbers byte place by byte place, compressed: the high places of small ones are zeros."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


Block = tuple[int, list, list[bytes]]


def in_blocks(docs: DataFrame, fn: Callable[[int, list, list[bytes]], pa.RecordBatch | None], schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """fn(number, doc_ids, texts) of every block of docs (doc_id, text); a longer text is a block of its own.

    doc_id is a number, or a struct of some, which comes as a dict. A second pass over the same table cuts the same blocks; matched() makes sure of it.
    """
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in _blocks(batches, block_bytes):
            out = fn(number, ids, texts)
            if out is not None and out.num_rows:
                yield out

    return _steady(docs.select(_id(docs), "text")).mapInArrow(run, schema)


def _steady(docs: DataFrame) -> DataFrame:
    """docs with rows in the same order each time: files are, what comes from other tasks is not until it is sorted."""
    docs = shared.spread(docs)
    if "Exchange" not in docs._jdf.queryExecution().executedPlan().toString():
        return docs
    return docs.sortWithinPartitions(F.xxhash64("text"), "doc_id")


def _id(docs: DataFrame) -> Column:
    return F.col("doc_id") if _id_type(docs) != "bigint" else F.col("doc_id").cast("long").alias("doc_id")


def _id_type(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kind if kind.startswith("struct") else "bigint"


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    number = TaskContext.get().partitionId() << BLOCK_BITS
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if texts and (size + len(raw) > block_bytes or len(texts) >> ROW_BITS):
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(doc)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield number, ids, texts


def mark(ids: list, texts: list[bytes]) -> int:
    """A checksum by which both passes over a block are known to be alike."""
    found = zlib.crc32(repr(ids).encode())
    for t in texts:
        found = zlib.crc32(t, zlib.crc32(str(len(t)).encode(), found))
    return found


ASKED = "part long, block long, mark long, n int, keys binary, many binary"
ANSWERED = "block long, part long, mark long, n int, sums binary"


def answered(docs: DataFrame, keys_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], into: Space, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Corpus counts of each block's keys. keys_of(texts): the distinct cut keys of a block, sorted, and their counts."""

    def ask(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch | None:
        value, many = keys_of(texts)
        if not len(value):
            return None
        part = into.part(value)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        end = np.concatenate([begin[1:], [len(part)]])
        spans = list(zip(begin.tolist(), end.tolist(), strict=True))
        keys = [packed(np.diff(value[a:b], prepend=np.uint64(0))) for a, b in spans]
        rows = len(spans)
        columns = [part[begin], np.full(rows, number), np.full(rows, mark(ids, texts)), (end - begin).astype(np.int32)]
        arrays = [*map(pa.array, columns), pa.array(keys, pa.binary()), pa.array([packed(many[a:b]) for a, b in spans], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in ASKED.split(", ")])

    def add(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = [np.cumsum(unpacked(k, n), dtype=np.uint64) for k, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
        many = [unpacked(m, n) for m, n in zip(table.column("many").to_pylist(), sizes, strict=True)]
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(where, np.concatenate(many))[where].astype("<u8")
        out = pa.array([packed(s) for s in np.split(sums, np.cumsum(sizes)[:-1])], pa.binary())
        return table.select(["block", "part", "mark", "n"]).append_column("sums", out)

    return in_blocks(docs, ask, ASKED, block_bytes).groupBy("part").applyInArrow(add, ANSWERED)


TEXTS = "block long, mark long, doc_ids array<{id}>, size long, packed binary"


def matched(docs: DataFrame, answers: DataFrame, fn: Callable[[int, list, list[bytes], np.ndarray], pa.Table], schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """fn(number, doc_ids, texts, counts) of every block; counts are in the order of the block's distinct keys."""

    kind = pa.int64() if _id_type(docs) == "bigint" else to_arrow_type(docs.schema["doc_id"].dataType)  # inferred ones have sorted fields

    def pack(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        whole = np.array([len(texts), *map(len, texts)], "<i8").tobytes() + b"".join(texts)
        columns = [[number], [mark(ids, texts)], [ids], [len(whole)], [pa.compress(whole, codec="zstd", asbytes=True)]]
        types = [pa.int64(), pa.int64(), pa.list_(kind), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in TEXTS.split(", ")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1 or any(m != left.column("mark")[0].as_py() for m in right.column("mark").to_pylist()):
            raise RuntimeError("documents changed between two passes over them")
        row = left.to_pylist()[0]
        data = pa.decompress(row["packed"], row["size"], codec="zstd", asbytes=True)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<i8", n, 8))])
        texts = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        answer = sorted(zip(right.column("part").to_pylist(), right.column("sums").to_pylist(), right.column("n").to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, np.uint64), *[unpacked(s, k) for _, s, k in answer]])
        return fn(row["block"], row["doc_ids"], texts, counts.astype(np.int64))

    texts = in_blocks(docs, pack, TEXTS.format(id=_id_type(docs)), block_bytes)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)
