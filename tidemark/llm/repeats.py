"""Removal of every byte that a 400-byte string covers which also starts anywhere else, by prefix-free parsing.

1. The parse: a rolling hash of a text's bytes sets triggers, positions whose hash is the least in some window, so that
   equal stretches have theirs at the same places. A phrase reaches from a trigger over the ones after it, 120 bytes at
   least; the parse is a text's list of phrases. The phrases of the whole corpus are ordered by range and their equals
   counted (see exchange). Each 400-byte string holds a whole phrase that depends on it alone, so only text around
   phrases that occur again can repeat; all other text is done with here.
2. The dictionary: what is left is parsed once more, by the least hash in each 400-byte string, so that a string
   belongs to exactly one trigger and equal strings to equal triggers. The text between the outermost strings of a
   trigger is its phrase; the dictionary has each distinct one once, with the number of its occurrences. Phrases that
   occur twice repeat as a whole. For phrases that differ but stand at equal triggers, dealt out by trigger, the suffix
   array of the dictionary is made, as far as 400 bytes: strings that share a place in it are equal.
3. A join over the parse carries a phrase's result to each of its occurrences. Text that repeats is sorted once, not
   once per occurrence; no order of the whole corpus is needed, only which of its strings are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exchange, shared, words

LENGTH = 400
#: Bytes that a trigger's hash is taken over where strings are compared.
TRIGGER = 48
#: Bytes that phrases which also occur in other documents must cover in one run to count as a shared passage.
PASSAGE = 160
_BASE = 0xD1342543DE82EF95 | 1
_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UP, _DOWN = words._Powers(_BASE), words._Powers(pow(_BASE, -1, 1 << 64))
#: Phrases of one trigger that a task compares at most: about 1.5 MB, and some fifty for its suffix array.
TASK_PHRASES = 2_000
PARSE = "doc long, trigger long, first int, count int, many long, phrase_a long, phrase_b long"
SPLIT = "doc long, doc_id long, n_bytes long, n_passages long, passage_bytes long, data binary, bounds array<struct<first:int,size:int>>"


class Rolling:
    """64-bit hashes of any strings of a buffer, from running sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _UP.upto(len(data)), dtype=np.uint64)])

    def everywhere(self, length: int) -> np.ndarray:
        """Of all strings of a length, not mixed: high places depend on all bytes, which is enough for an order."""
        return (self.sums[length:] - self.sums[:-length]) * _DOWN.upto(len(self.sums))[: len(self.sums) - length]

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return words.mix((self.sums[start + length] - self.sums[start]) * _DOWN.upto(len(self.sums))[start])


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the position of its least value, the leftmost of equals; by doubling."""
    n = len(values) - width + 1
    best, span = np.arange(len(values)), 1
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)


def parse_phrases(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the phrases of a text's parse.

    With triggers in each window of gap positions, a phrase at the first one inside a string of length bytes ends before
    any place where bytes outside of the string could set a trigger: 3 * gap + span < length + 4.
    """
    gap, seed, span = parse_shape(length)
    none = np.zeros(0, np.int64)
    if len(data) < max(span, seed + gap - 1):
        return none, none, np.zeros(0, np.uint64)
    rolling = Rolling(data)
    at = triggers(rolling.everywhere(seed), gap)
    last = np.searchsorted(at, at + span - seed)
    start, end = at[last < len(at)], at[last[last < len(at)]] + seed
    return start, end, words.mix(rolling.of(start, end - start) + (end - start).astype(np.uint64))


def parse_shape(length: int) -> tuple[int, int, int]:
    """The window of a trigger, the bytes of its hash and the least bytes of a phrase, for strings of length bytes."""
    gap, seed = max(1, length * 4 // 25), max(1, min(16, length // 12))
    return gap, seed, max(length * 3 // 10, gap + seed)


def split(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row of docs (doc_id, text) with a number of its own, its bytes, and the stretches of them that may repeat, in the shared folder.

    bounds are the stretches, null where there are none; outside of them no string of length bytes occurs twice.
    n_passages and passage_bytes: runs of phrases that other documents have too, of PASSAGE bytes at least.
    """
    into = exchange.space(docs)
    gap, _, _ = parse_shape(length)

    def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        keys = [parse_phrases(np.frombuffer(t, dtype=np.uint8), length)[2] for t in texts]
        return np.unique(into.cut(np.concatenate([np.zeros(0, np.uint64), *keys])), return_counts=True)

    def cut(number: int, ids: list, texts: list[bytes], counts: np.ndarray) -> pa.Table:
        found = [parse_phrases(np.frombuffer(t, dtype=np.uint8), length) for t in texts]
        value = np.unique(into.cut(np.concatenate([np.zeros(0, np.uint64), *[k for _, _, k in found]])))
        passages, sizes, bounds = [], [], []
        for text, (start, end, keys) in zip(texts, found, strict=True):
            at = np.searchsorted(value, into.cut(keys))
            total = counts[at]
            _, where, own = np.unique(at, return_inverse=True, return_counts=True)
            elsewhere = total > own[where]
            a, b = merged(start[elsewhere], end[elsewhere]) if elsewhere.any() else (start[:0], start[:0])
            long = b - a >= PASSAGE
            passages.append(int(long.sum()))
            sizes.append(int((b - a)[long].sum()))
            again = total > 1
            if again.any() and len(text) >= length:
                a, b = merged(np.maximum(start[again] - gap + 1, 0), np.minimum(start[again] + length, len(text)))
                bounds.append([{"first": x, "size": y - x} for x, y in zip(a.tolist(), b.tolist(), strict=True) if y - x >= length] or None)
            else:
                bounds.append(None)
        uids = (number << exchange.ROW_BITS) + np.arange(len(texts))
        kinds = pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32())]))
        columns = [uids, pa.array(ids, pa.int64()), pa.array([*map(len, texts)], pa.int64()), pa.array(passages, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()), pa.array(bounds, kinds)]
        return pa.table(columns, ["doc", "doc_id", "n_bytes", "n_passages", "passage_bytes", "data", "bounds"])

    return shared.stored(exchange.matched(docs, exchange.answered(docs, keys_of, into), cut, SPLIT))


def triggers(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that have the least value of some window of width values, all of equals."""
    least, span = values, 1
    while span < width:
        step = min(span, width - span)
        least, span = np.minimum(least[: len(least) - step], least[step:]), span + step
    most, span = np.concatenate([np.zeros(width - 1, values.dtype), least, np.zeros(width - 1, values.dtype)]), 1
    while span < width:
        step = min(span, width - span)
        most, span = np.maximum(most[: len(most) - step], most[step:]), span + step
    return np.flatnonzero(most == values)


def phrases(data: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER) -> tuple | None:
    """The triggers of all strings of length bytes (positions, hashes), and the first start and the number of the strings of each."""
    if len(data) < length:
        return None
    rolling = Rolling(data)
    hashes = rolling.of(np.arange(len(data) - trigger + 1), trigger)
    place = least_positions(hashes, length - trigger + 1)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([new, [len(place)]]))
    at = place[new]
    return at, hashes[at], new, count


def _keys(data: bytes, first: np.ndarray, size: np.ndarray, place: np.ndarray) -> list[bytes]:
    """128-bit keys of phrases: their bytes and where in them the trigger is."""
    spans = zip(first.tolist(), size.tolist(), place.tolist(), strict=True)
    return [hashlib.blake2b(data[f : f + n], digest_size=16, salt=p.to_bytes(16, "little")).digest() for f, n, p in spans]


def parsed(rows: DataFrame, length: int) -> DataFrame:
    """The second parse of rows (doc, data, bounds), in the shared folder.

    A row per document and distinct phrase: many times, first at first; count strings; a 128-bit key of its bytes.
    Phrases that a document has more than once repeat anyway: rows without trigger have the stretches they cover, from
    first on, count bytes. So texts of a short period give few rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for doc, raw, bounds in zip(batch.column("doc").to_pylist(), batch.column("data"), batch.column("bounds").to_pylist(), strict=True):
            raw, seen, again = raw.as_buffer().to_pybytes(), {}, []
            for bound in bounds:
                found = phrases(np.frombuffer(raw, np.uint8, bound["size"], bound["first"]), length)
                if not found:
                    continue
                at, hashes, first, count = found
                first, size = first + bound["first"], count + length - 1
                keys = _keys(raw, first, size, at + bound["first"] - first)
                for key, f, n, h in zip(keys, first.tolist(), count.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    if key in seen:
                        seen[key][3] += 1
                        again.append((f, f + n + length - 1))
                    else:
                        seen[key] = [h, f, n, 1]
            again += [(f, f + n + length - 1) for _, f, n, many in seen.values() if many > 1]
            out += [(doc, h, f, n, many, *np.frombuffer(key, "<i8").tolist()) for key, (h, f, n, many) in seen.items()]
            if again:
                out += [(doc, None, a, b - a, 0, 0, 0) for a, b in zip(*(x.tolist() for x in merged(*np.array(again).T)), strict=True)]
        if not out:
            return None
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.split()[0] for f in PARSE.split(", ")])

    return shared.stored(shared.arrow_rows(rows, run, PARSE))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches as maximal runs: overlapping and touching ones become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Places of all strings of length bytes in their order, equal ones sharing a place: a suffix array's ranks.

    From eight bytes on, longer strings are ranked by the ranks of their parts, as many as fit a number: two at least,
    so spans double or triple, and no hash is involved.
    """
    span = min(8, length)
    n = len(data) - span + 1
    heads = np.zeros(max(n, 0), np.uint64)
    for k in range(span if n > 0 else 0):
        heads = (heads << np.uint64(8)) | data[k : k + n]
    ranks = np.unique(heads, return_inverse=True)[1].astype(np.int64)
    bits = max(1, len(data).bit_length())
    while span < length:
        parts = min(max(2, 63 // bits), -(-length // span))
        wide = min(length, parts * span)
        steps = [min(k * span, wide - span) for k in range(parts)]  # the last parts may overlap
        n, tuples = len(data) - wide + 1, np.int64(0)
        for step in steps:
            tuples = (tuples << np.int64(bits)) | ranks[step : step + max(n, 0)]
        ranks, span = np.unique(tuples, return_inverse=True)[1].astype(np.int64), wide
    return ranks


def _compare(batch: pa.RecordBatch, length: int) -> pa.RecordBatch | None:
    """Of phrases, all those of their triggers, the stretches of strings that two of them have, where a phrase occurs once."""
    data = b"".join(batch.column("bytes").to_pylist())
    count = batch.column("count").to_numpy().astype(np.int64)
    size = count + length - 1
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(count)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    rank = suffix_ranks(np.frombuffer(data, dtype=np.uint8), length)[start]
    hit = (np.bincount(rank)[rank] > 1) & (batch.column("n").to_numpy() == 1)[owner]
    if not hit.any():
        return None
    start, owner = start[hit], owner[hit]
    new = np.concatenate([[True], (start[1:] > start[:-1] + length) | (owner[1:] != owner[:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    own = owner[new]
    first = batch.column("first").to_numpy().astype(np.int64)[own] + start[new] - begin[own]
    return pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(own)), pa.array(first, pa.int32()), pa.array(start[last] + length - start[new], pa.int32())], ["doc", "first", "count"])


def _by_trigger(batches: Iterator[pa.RecordBatch], length: int, rows: int) -> Iterator[pa.RecordBatch]:
    """_compare() over rows sorted by trigger: some thousand at once, never splitting a trigger."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) < rows:
            continue
        table = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        triggers = table.column("trigger").to_numpy()
        ends = int(np.searchsorted(triggers, triggers[-1]))  # the last trigger may go on
        if ends:
            out = _compare(table.slice(0, ends), length)
            if out is not None:
                yield out
        kept = [table.slice(ends)]
    if kept and sum(b.num_rows for b in kept):
        out = _compare(pa.Table.from_batches(kept).combine_chunks().to_batches()[0], length)
        if out is not None:
            yield out


def _exploded(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Each string of the phrases as a row of its own, under a 128-bit key: for triggers with more phrases than a task should hold."""
    keys, docs, firsts, ns = [], [], [], []
    for doc, first, count, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "first", "count", "n", "bytes")), strict=True):
        keys += [hashlib.blake2b(data[k : k + length], digest_size=16).digest() for k in range(count)]
        docs += [doc] * count
        firsts += range(first, first + count)
        ns += [n] * count
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(firsts, pa.int32()), pa.array(ns, pa.int64())], ["key", "doc", "first", "n"])


def _bytes(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Cuts the phrases out of their texts."""
    out = []
    for doc, data, wanted in zip(batch.column("doc").to_pylist(), batch.column("data").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
        out += [(w["trigger"], doc, w["first"], w["count"], w["n"], data[w["first"] : w["first"] + w["size"]]) for w in wanted]
    columns = list(zip(*out, strict=True))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["trigger", "doc", "first", "count", "n", "bytes"])


def repeated(rows: DataFrame, length: int = LENGTH, task_phrases: int = TASK_PHRASES) -> DataFrame:
    """doc, first, count: stretches of bytes (from first on, count of them) to be removed from rows (doc, data, bounds).

    doc names a row. Only text inside of bounds is looked at. Stretches may overlap. Phrases of one trigger are compared
    in one task, up to task_phrases of them; those of more frequent triggers string by string, over all tasks.
    """
    parse = parsed(rows, length)
    key = ["trigger", "phrase_a", "phrase_b"]
    own = parse.where("trigger is null").select("doc", "first", "count")
    parse = parse.where("trigger is not null")
    # doc and first of one occurrence; only a phrase's sole occurrence is used for more than its bytes.
    dictionary = shared.stored(parse.groupBy(*key).agg(F.sum("many").alias("n"), F.min(F.struct("doc", "first", "count")).alias("at")))
    twice = dictionary.where("n > 1").select(*key)
    whole = parse.join(twice, key).select("doc", "first", (F.col("count") + (length - 1)).alias("count"))
    triggers = dictionary.groupBy("trigger").agg(F.count("*").alias("phrases")).where("phrases > 1")
    mixed = dictionary.join(triggers, "trigger")
    wanted = mixed.select("at.doc", F.struct("trigger", "at.first", "at.count", "n", (F.col("at.count") + (length - 1)).alias("size"), (F.col("phrases") > task_phrases).alias("many")).alias("w"))
    some, lots = (wanted.where(c).groupBy("doc").agg(F.collect_list("w").alias("wanted")) for c in ("not w.many", "w.many"))
    fields = "trigger long, doc long, first int, count int, n long, bytes binary"
    cut = shared.arrow_rows(rows.join(some, "doc"), _bytes, fields)
    ordered = cut.repartition("trigger").sortWithinPartitions("trigger")
    parts = ordered.mapInArrow(lambda batches: _by_trigger(batches, length, 2048), "doc long, first int, count int")
    out = own.union(whole).union(parts)
    if not triggers.where(F.col("phrases") > task_phrases).isEmpty():
        strings = shared.arrow_rows(shared.arrow_rows(rows.join(lots, "doc"), _bytes, fields), lambda b: _exploded(b, length), "key binary, doc long, first int, n long")
        strings = shared.stored(strings)
        found = strings.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
        out = out.union(strings.where("n = 1").join(found, "key").select("doc", "first", F.lit(length).alias("count")))
    return out


def _removed(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True):
        if spans:
            start, end = merged(*(np.array([s[k] for s in spans], np.int64) for k in ("first", "end")))
            ends = np.concatenate([[0], end])
            kept = b"".join(data[a:b] for a, b in zip(ends, [*start, len(data)], strict=True))
        else:
            start, kept = (), data
        out.append((len(data) - len(kept), len(start), kept))
    removed, spans, kept = zip(*out, strict=True)
    own = [batch.column(c) for c in ("doc_id", "n_bytes", "n_passages", "passage_bytes")]
    return pa.RecordBatch.from_arrays([*own, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_passages", "passage_bytes", "n_removed", "n_spans", "kept"])


def removed(docs: DataFrame, length: int = LENGTH, task_phrases: int = TASK_PHRASES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes and kept (bytes) for each row of docs (doc_id, text).

    A null text counts as empty; texts under length bytes lose nothing. Repeated rows repeat each other. Rows may share
    a doc_id or have none: each is judged by its own text. Kept bytes may end inside a character. Other columns are left
    out. No rows give no rows. Passages shorter than length that other documents have too are reported, not removed.
    """
    shared.small_batches(docs.sparkSession)
    rows = split(docs, length)
    suspects = rows.where("bounds is not null")
    spans = repeated(suspects.select("doc", "data", "bounds"), length, task_phrases)
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("first", (F.col("first") + F.col("count")).alias("end"))).alias("spans"))
    joined = suspects.drop("bounds").join(spans, "doc", "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_bytes", "kept"]
    found = shared.arrow_rows(joined, _removed, "doc_id long, n_bytes long, n_passages long, passage_bytes long, n_removed long, n_spans long, kept binary")
    whole = rows.where("bounds is null").withColumns({"n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": F.col("data")})
    return found.select(*names).union(whole.select(*names))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(shared.read(spark, sf_dir, "documents")).drop("kept")
