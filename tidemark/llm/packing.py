"""Packing of documents into fixed windows by minimum bin slack.

A document longer than a window fills whole windows with its first ids; what remains is shorter than a window. Only
how many remainders there are of each length is gathered, so the plan is made from fewer numbers than a window has
ids, at any size of the corpus. Each step takes the longest length left and finds, by a subset-sum bitset, the
multiset of other lengths that comes closest to the window; it is repeated as often as the counts allow. Where even
the closest leaves slack, one more remainder is cut to fill it and its rest goes back among the lengths. Documents
get their places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import shared
from tidemark.llm.encoding import default_path, encoder

WINDOW = 1024
END = (0).to_bytes(4, "little")
TOKENS = "doc_id long, block long, row long, n_tokens long, rest int, rest_rank long, full_before long, crcs array<long>, ids binary"


class _Lengths:
    """How many remainders of each length are left, as rank ranges of the length they had at first."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if n > 0 and c > 0}
        self.ranges = {n: [(n, 0, c, 0)] for n, c in self.left.items()}

    def take(self, length: int, times: int) -> list[tuple[int, int, int, int]]:
        """times remainders of a length: (first length, rank from, rank to, start within the remainder)."""
        taken, ranges = [], self.ranges[length]
        self.left[length] -= times
        while times:
            origin, lo, hi, start = ranges.pop()
            n = min(times, hi - lo)
            taken.append((origin, lo, lo + n, start))
            if lo + n < hi:
                ranges.append((origin, lo + n, hi, start))
            times -= n
        if not self.left[length]:
            del self.left[length], self.ranges[length]
        return taken

    def give(self, length: int, ranges: list[tuple[int, int, int, int]]) -> None:
        for origin, lo, hi, start in ranges:
            self.ranges.setdefault(length, []).append((origin, lo, hi, start))
            self.left[length] = self.left.get(length, 0) + hi - lo


def closest(left: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest one up to room."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in left if n <= room), reverse=True):
        most, chunk = min(left[length], room // length), 1
        while most:
            n = min(chunk, most)
            layers.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            most, chunk = most - n, chunk * 2
        if reach >> room & 1:
            break
    rest, used = reach.bit_length() - 1, defaultdict(int)
    for length, n, before in reversed(layers):
        if not before >> rest & 1:
            used[length] += n
            rest -= length * n
    return dict(used)


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple], int]:
    """Places of all remainders, and how many sequences they make.

    A place (rest, lo, hi, part_start, part_length, sequence, offset) holds for the remainders of length rest with
    ranks from lo to before hi; each next rank has the next sequence.
    """
    lengths, places, sequence = _Lengths(counts), [], 0
    while lengths.left:
        longest = max(lengths.left)
        rest = dict(lengths.left)
        rest[longest] -= 1
        used = closest({n: c for n, c in rest.items() if c}, window - longest)
        used[longest] = used.get(longest, 0) + 1
        slack = window - sum(n * c for n, c in used.items())
        spare = {n: c - used.get(n, 0) for n, c in lengths.left.items() if c > used.get(n, 0)}
        if slack and not spare:
            return _last(lengths, places, sequence)
        cut = max(spare, key=lambda n: (spare[n], n)) if slack else 0
        times = min(lengths.left[n] // (c + (n == cut)) for n, c in used.items())
        if slack:
            times = min(times, lengths.left[cut] // (used.get(cut, 0) + 1))
        offset = 0
        for length, many in sorted(used.items(), reverse=True):
            for _ in range(many):
                offset = _place(lengths.take(length, times), length, places, sequence, offset)
        if slack:
            taken = lengths.take(cut, times)
            _place(taken, slack, places, sequence, offset)
            lengths.give(cut - slack, [(o, lo, hi, start + slack) for o, lo, hi, start in taken])
        sequence += times
    return places, sequence


def _place(taken: list, length: int, places: list, sequence: int, offset: int) -> int:
    for origin, lo, hi, start in taken:
        places.append((origin, lo, hi, start, length, sequence, offset))
        sequence += hi - lo
    return offset + length


def _last(lengths: _Lengths, places: list, sequence: int) -> tuple[list[tuple], int]:
    """What is left fills less than a window: sequences of powers of two hold it, which need no padding."""
    items = [(n, r) for n, c in sorted(lengths.left.items(), reverse=True) for r in lengths.take(n, c)]
    items = [(n, (o, k, k + 1, start)) for n, (o, lo, hi, start) in items for k in range(lo, hi)]
    total = sum(n for n, _ in items)
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    room, offset = sizes.pop(0), 0
    for length, (origin, lo, hi, start) in items:
        while length:
            if not room:
                sequence, room, offset = sequence + 1, sizes.pop(0), 0
            part = min(length, room)
            places.append((origin, lo, hi, start, part, sequence, offset))
            start, length, room, offset = start + part, length - part, room - part, offset + part
    return places, sequence + 1


def encoded(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Writes docs' ids (end id included) to the shared folder, with ranks within each task and checksums of pieces.

    block and row name a document, whatever its doc_id; crcs are those of its whole windows and of its remainder.
    """
    name = tokenizer or default_path()
    shared.small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, row, full, ranks = encoder(name), TaskContext.get().partitionId(), 0, 0, defaultdict(int)
        for batch in shared.together(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.many(shared.texts_of(batch)), strict=True):
                ids += END
                n = len(ids) // 4
                rest = n % window
                crcs = [zlib.crc32(ids[at : at + 4 * window]) for at in range(0, len(ids), 4 * window)]
                rows.append((doc_id, block, row, n, rest, ranks[rest], full, crcs, ids))
                ranks[rest] += 1
                row, full = row + 1, full + n // window
            if not rows:
                continue
            fields = [f.split()[0] for f in TOKENS.split(", ")]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)

    return shared.stored(shared.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(encode, TOKENS))


def pieces(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where each piece of encoded() documents goes.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and block and row, which join to the
    ids. No documents: no pieces.
    """
    spark = tokens.sparkSession
    light = tokens.drop("ids")
    by_block = light.groupBy("block", "rest").agg(F.count("*").alias("n"))
    before = lambda key: Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_block.withColumn("rank_base", F.coalesce(F.sum("n").over(before(["rest"])), F.lit(0)))
    # At most one count per length of a window, at any size of the corpus.
    counts = {r["rest"]: r["n"] for r in by_block.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    places, n_sequences = plan({n: c for n, c in counts.items() if n}, window)
    ranked = light.join(bases.select("block", "rest", "rank_base"), ["block", "rest"]).withColumn("rank", F.col("rank_base") + F.col("rest_rank"))
    rests = _placed(ranked.select("doc_id", "block", "row", "n_tokens", "rest", "rank", F.element_at("crcs", -1).alias("ids_crc32")), places)
    cut_lengths = sorted({p[0] for p in places if p[4] != p[0]})
    uncut = rests.where(F.col("length") == F.col("rest")).drop("rest")
    full_blocks = light.groupBy("block").agg(F.sum(F.floor(F.col("n_tokens") / window)).alias("n"))
    full_blocks = full_blocks.select("block", (F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + n_sequences).alias("full_base"))
    fulls = light.where(F.col("n_tokens") >= window).join(full_blocks, "block")
    fulls = fulls.select("*", F.posexplode(F.slice("crcs", 1, F.floor(F.col("n_tokens") / window).cast("int"))).alias("k", "ids_crc32")).select(
        "doc_id", "block", "row", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        "ids_crc32", F.col("n_tokens").alias("doc_tokens"), (F.col("full_base") + F.col("full_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    out = uncut.unionByName(fulls)
    if cut_lengths:
        cut = rests.where(F.col("rest").isin(cut_lengths) & (F.col("length") < F.col("rest"))).drop("rest", "ids_crc32")
        ids = tokens.where(F.col("rest").isin(cut_lengths)).select("block", "row", "ids")
        out = out.unionByName(_checksums(cut.join(ids, ["block", "row"])))
    return out


class _Places:
    """The plan by length and rank: stretches of ranks that have the same parts, found by bisection."""

    def __init__(self, places: list[tuple]):
        rest, lo, hi, *_ = self.columns = np.array(places, np.int64).reshape(-1, 7).T
        self.starts = np.unique(np.concatenate([self.key(rest, lo), self.key(rest, hi)]))
        first, last = (np.searchsorted(self.starts, self.key(rest, x)) for x in (lo, hi))
        stretch = np.repeat(first, last - first) + np.arange((last - first).sum()) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        order = np.argsort(stretch, kind="stable")
        self.part = np.repeat(np.arange(len(rest)), last - first)[order]
        self.bounds = np.searchsorted(stretch[order], np.arange(len(self.starts) + 1))

    @staticmethod
    def key(rest: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (rest << 47) + rank

    def of(self, rest: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part of each of these remainders: which of them it belongs to, and the place."""
        at = np.searchsorted(self.starts, self.key(rest, rank), side="right") - 1
        n = self.bounds[at + 1] - self.bounds[at]
        which = np.repeat(np.arange(len(rest)), n)
        return which, self.part[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[at], n)]


PLACED = "doc_id long, block long, row long, rest int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placed(ranked: DataFrame, places: list[tuple]) -> DataFrame:
    """The pieces of remainders. The plan that goes to every task has some thousand places, by the window alone."""
    if not places:
        return ranked.sparkSession.createDataFrame([], PLACED)
    known = ranked.sparkSession.sparkContext.broadcast(_Places(places))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(pa.array(batch.column("rest").to_numpy() > 0))
        if not batch.num_rows:
            return None
        plan_of = known.value
        rest, rank, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("rest", "rank", "n_tokens"))
        which, place = plan_of.of(rest, rank)
        _, lo, _, part_start, part_length, sequence, offset = (c[place] for c in plan_of.columns)
        own = batch.take(pa.array(which))
        columns = [own.column("doc_id"), own.column("block"), own.column("row"), own.column("rest"), pa.array((n - rest)[which] + part_start), pa.array(part_length)]
        columns += [own.column("ids_crc32"), own.column("n_tokens"), pa.array(sequence + rank[which] - lo), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PLACED.split(", ")])

    return shared.arrow_rows(ranked, run, PLACED)


def _checksums(cut: DataFrame) -> DataFrame:
    names = [f.name for f in cut.schema if f.name != "ids"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = zip(batch.column("ids").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist(), strict=True)
        crcs = [zlib.crc32(ids[4 * start : 4 * (start + length)]) for ids, start, length in spans]
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(crcs, pa.int64())], [*names, "ids_crc32"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "ids")
    return shared.arrow_rows(cut, run, f"{ddl}, ids_crc32 long")


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Packs docs (doc_id, text; other columns are left out) into windows; see pieces() for the columns.

    A null or empty text is its end id alone; whole texts are packed, however long; repeated rows are packed as often
    as they come. No rows give no pieces.
    """
    return pieces(encoded(docs, window, tokenizer), window)


def filled(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, ids as little-endian unsigned 32-bit integers."""
    part = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    parts = pieces.join(tokens.select("block", "row", "ids"), ["block", "row"]).select("sequence_id", "offset", part.alias("part"))
    # A sequence has at most a window of ids, so its parts fit a task.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: F.hex(x["part"]))
    return parts.groupBy("sequence_id").agg(F.unhex(F.array_join(ordered, "")).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.read(spark, sf_dir, "documents"))
