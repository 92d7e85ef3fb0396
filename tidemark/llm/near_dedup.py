"""Near-duplicate groups: SuperMinHash signatures, banding, verification on whole shingle sets, union-find.

1. Each task hashes its texts' shingles and makes SuperMinHash signatures. Documents with equal sets become one.
2. In each band's bucket the least document is the pivot; all others are verified against it, and links are joined.
   So a bucket gives at most one pair per document, however many it holds.
3. Documents that share a bucket with another group may still have links that no pivot showed. These are searched
   without loss by prefix filtering: two sets similar enough share one of their rarest shingles, and their sizes and
   the place of that shingle bound each other. Candidates are verified and joined as before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exchange, shared, words
from tidemark.llm.components import components

SLOTS, BANDS = 128, 32
_ROUND = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 56) - 1)


def _round(k: int) -> np.uint64:
    return np.uint64(_ROUND * k % (1 << 64))


def signatures(values: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: a row of slots per set. In round j each element gives the j-th slot of its own permutation the
    value j plus a random fraction; a slot keeps its least value, and a set is done once every slot is under j.

    A value is held as 7 bits of round and 56 of fraction. Permutations are shuffled step by step (Fisher-Yates), all
    elements at once. Empty sets keep the largest value everywhere.
    """
    n_sets = len(bounds) - 1
    out = np.full(n_sets * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(bounds))
    perm = None
    for j in range(slots):
        if j:
            worst = out.reshape(n_sets, slots).max(axis=1)
            going = (worst >= np.uint64(j << 56)) & (np.diff(bounds) > 0) if j == 1 else going & (worst >= np.uint64(j << 56))
            stay = going[owner]
            if not stay.any():
                break
            if not stay.all():
                values, owner = values[stay], owner[stay]
                picks = picks[stay]
                perm = perm[stay] if perm is not None else None
            if perm is None:  # only sets too small for a single round come here
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
                rows = np.arange(len(values))
                perm[rows, picks] = 0
                perm[:, 0] = picks
        random = words.mix(values + _round(2 * j + 1))
        picks = j + (words.mix(random ^ _round(1)) % np.uint64(slots - j)).astype(np.int64)
        if perm is None:
            slot = picks
        else:
            rows = np.arange(len(values))
            slot = perm[rows, picks].astype(np.int64)
            perm[rows, picks] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(out, owner * slots + slot, np.uint64(j << 56) | (random & _LOW))
    return out.reshape(n_sets, slots)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band and set."""
    rows = sig.shape[1] // bands
    parts, keys = sig.reshape(len(sig), bands, rows), np.zeros((len(sig), bands), dtype=np.uint64)
    for r in range(rows):
        keys = words.mix(keys * np.uint64(31) + parts[:, :, r] + np.arange(bands, dtype=np.uint64) * _round(1))
    return keys


def _sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    return words.shingles(*words.words(texts), size)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit key of the set) and bands; bands are null for empty sets."""
    shared.small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = _sets(shared.texts_of(batch), size)
        n = np.diff(bounds)
        keys = band_keys(signatures(values, bounds)).view(np.int64)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(words.mix(values ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (1, 2)]
        sums = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
        lists = pa.array([k if some else None for k, some in zip(keys, n > 0, strict=True)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    rows = shared.arrow_rows(shared.spread(docs.select("doc_id", "text")), run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")
    return shared.stored(rows)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole shingle sets have 100 * intersection >= percent * union."""
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
        own = {t: k for k, t in enumerate(dict.fromkeys(left + right))}
        values, bounds = _sets(list(own), size)
        good = []
        for a, b in zip(left, right, strict=True):
            x, y = (values[bounds[own[t]] : bounds[own[t] + 1]] for t in (a, b))
            least, most = sorted((len(x), len(y)))
            common = len(np.intersect1d(x, y, assume_unique=True)) if least and 100 * least >= percent * most else 0
            good.append(common > 0 and 100 * common >= percent * (least + most - common))
        return batch.select(["a", "b"]).filter(pa.array(good))

    return shared.stored(shared.arrow_rows(both, run, "a long, b long"))


def _step(n: np.ndarray | float) -> np.ndarray:
    """Sizes in steps of a twentieth."""
    return np.floor(np.log(n) / math.log(1.05) + 1e-9).astype(np.int64)


def _prefixes(values: np.ndarray, rareness: np.ndarray, percent: int) -> tuple:
    """The rarest shingles that a set must share with another one, as (key, place, role) arrays. Any order gives the same links.

    As the smaller of two sets a set shares one of its first n - 2 t n / (1 + t) + 1, as the larger one of its first
    n - t n + 1. Keys hold the shingle and the smaller set's size step; a larger set asks all steps that its shingle's
    place leaves possible, so sets that cannot be similar never meet.
    """
    n, t = len(values), percent / 100
    order = np.lexsort((values, rareness))
    ranked = values[order]
    small = ranked[: n - math.ceil(2 * t / (1 + t) * n - 1e-9) + 1]
    keys, places, roles = [words.mix(small + _round(int(_step(n)) + 1))], [np.arange(len(small))], [np.zeros(len(small), np.int64)]
    large = ranked[: n - math.ceil(t * n - 1e-9) + 1]
    place = np.arange(len(large))
    most = np.minimum(n, np.floor((n - place) * (1 + t) / t - n + 1e-9))  # from the overlap that is needed
    least = math.ceil(t * n - 1e-9)
    for step in range(int(_step(least)), int(_step(n)) + 1):
        hit = _step(np.maximum(most, 1)) >= step
        keys.append(words.mix(large[hit] + _round(step + 1)))
        places.append(place[hit])
        roles.append(np.ones(int(hit.sum()), np.int64))
    return tuple(np.concatenate(x) for x in (keys, places, roles))


def residual_pairs(nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) among nodes (doc_id, component) of different components that may be similar enough; none is missed."""
    texts = docs.select("doc_id", "text").where("text is not null").join(nodes, "doc_id")
    texts = shared.stored(texts.select(F.struct(F.col("doc_id").cast("long").alias("doc"), "component").alias("doc_id"), "text"))
    into = exchange.space(texts)

    def keys_of(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(into.cut(_sets([t.decode() for t in some], size)[0]), return_counts=True)

    def prefixes(_: int, ids: list, some: list[bytes], counts: np.ndarray) -> pa.Table:
        values, bounds = _sets([t.decode() for t in some], size)
        cut = into.cut(values)
        rareness, rows = counts[np.searchsorted(np.unique(cut), cut)], []
        for k, own in enumerate(ids):
            here = slice(bounds[k], bounds[k + 1])
            n = bounds[k + 1] - bounds[k]
            if n:
                key, place, role = _prefixes(values[here], rareness[here], percent)
                rows.append((key.view(np.int64), place, role, np.full(len(key), own["doc"]), np.full(len(key), own["component"]), np.full(len(key), n)))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 6
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["key", "place", "role", "doc_id", "component", "n"])

    # How many of the nodes have a shingle is counted exactly, at any size, so rare shingles are known to be rare.
    answers = exchange.answered(texts, keys_of, into)
    rows = shared.stored(exchange.matched(texts, answers, prefixes, "key long, place long, role long, doc_id long, component long, n long"))
    side = lambda role, p: rows.where(F.col("role") == role).select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("place", "doc_id", "component", "n")])
    needed = F.lit(percent / (100 + percent)) * (F.col("s_n") + F.col("l_n"))
    fits = (F.col("s_component") != F.col("l_component")) & (F.col("s_n") <= F.col("l_n")) & (F.least(F.col("s_n") - F.col("s_place"), F.col("l_n") - F.col("l_place")) + 1e-6 >= needed)
    found = side(0, "s").join(side(1, "l"), "key").where(fits)
    return found.select(F.least("s_doc_id", "l_doc_id").alias("a"), F.greatest("s_doc_id", "l_doc_id").alias("b")).distinct()


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are left out).

    Rows with one doc_id count as one document. Null and empty texts, and those of blanks alone, have no shingles and
    no links. A row without doc_id has no links and no component, and is kept. No rows give no rows.
    """
    base = sketched(docs, size)
    sets = base.where("bands is not null and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    sets = shared.stored(sets, narrow=4)
    buckets = sets.select("rep", F.explode("bands").alias("bucket"))
    pivots = buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("_most")).where("_most > a").drop("_most")
    members = shared.stored(buckets.join(pivots, "bucket"), narrow=4)
    pairs = members.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    first = verified(pairs, docs, size, percent)
    found = components(first)

    def placed(ids: DataFrame, name: str, component: DataFrame) -> DataFrame:
        return ids.join(component.withColumnRenamed("node", name), name, "left").withColumn("component", F.coalesce("component", name))

    known = placed(members.select("bucket", "rep"), "rep", found)
    mixed = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    nodes = known.join(mixed, "bucket", "left_semi").groupBy(F.col("rep").alias("doc_id")).agg(F.min("component").alias("component"))
    more = verified(residual_pairs(shared.stored(nodes, narrow=8), docs, size, percent), docs, size, percent)
    # Groups found so far act as single nodes.
    again = components(more.union(found.select(F.col("component"), F.col("node"))).toDF("a", "b"))
    reps = placed(sets.select("set_a", "set_b", "rep"), "rep", again).select("set_a", "set_b", F.col("component").alias("component_id"))
    # Rows without shingles, and those without id, join nothing; their keys would all be one.
    linked = base.where("bands is not null and doc_id is not null").join(reps, ["set_a", "set_b"])
    alone = base.where("bands is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")]
    return linked.select(*columns).union(alone.select(*columns))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one document of each group: the one with the least doc_id. Of rows with one doc_id one stays."""
    judged = shared.stored(groups(docs, size, percent), narrow=4)
    gone = judged.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    if judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    one = left.where("doc_id is not null").dropDuplicates(["doc_id"])
    return one.unionByName(left.where("doc_id is null"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(shared.read(spark, sf_dir, "documents"), size=4)
