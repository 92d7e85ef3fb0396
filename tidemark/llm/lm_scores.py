"""Stupid-backoff scores of every document under an n-gram model of all the others.

The relations of exploded n-grams and of counts are kept packed (see exchange): a block of documents sends each of its
distinct n-grams once to the hash range it belongs to, which adds the counts up and joins them back to the blocks.
Blocks then look their documents' n-grams up and add the logarithms per document. All n-grams are in the model,
whatever their count. What a document adds to the counts itself is taken out before it is scored: else every n-gram of
a scored text would occur, none would back off, and text that is found nowhere else would score best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exchange, shared, words

ORDER, BACKOFF = 3, 0.4
PARTS = "doc_id long, n_words long, n_backoffs long, n_base long, logs double"


def grams(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words' bounds, and for each n from 1 on: the n-gram that ends at each word, and whether the text has it."""
    hashes, bounds = words.words(texts)
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    keys, there = [], []
    value = np.zeros(len(hashes), np.uint64)
    for n in range(1, order + 1):
        back = np.concatenate([np.zeros(n - 1, np.uint64), hashes])[: len(hashes)]
        value = value + words.mix(back + np.uint64(int(words._PLACE[n]) * n % (1 << 64)))
        keys.append(words.mix(value ^ words._PLACE[32 + n]))
        there.append(place >= n - 1)
    return bounds, keys, there


def placed(keys: list[np.ndarray]) -> tuple[int, list[np.ndarray]]:
    """How many distinct keys there are in all arrays, and the place of each key among them in ascending order.

    One sort gives both: unique values alone would be hashed by numpy, and each key's place bisected, at several times the cost.
    """
    value, at = np.unique(np.concatenate(keys), return_inverse=True)
    return len(value), np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def _decoded(texts: list[bytes]) -> list[str]:
    return [t.decode() for t in texts]


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, held_out: bool = True, block_bytes: int = exchange.BLOCK_BYTES, part_bytes: int = exchange.PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_backoffs, score and mean_score for each row of docs (doc_id, text; others are left out).

    score adds up the natural logarithms of each word's stupid-backoff score after up to order - 1 words of its text,
    by the counts of all other rows (held_out=False: of all rows). A word that no other row has counts as one that
    occurs once. n_backoffs counts the steps to shorter n-grams. Whole texts, however long, count and are scored. A
    text without words, null ones too, has score 0 and a null mean. Repeated rows count, and come back, as often as
    they are there; so do rows without doc_id. No rows give no rows.
    """
    into = exchange.space(docs, part_bytes)

    def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, keys, there = grams(_decoded(texts), order)
        return np.unique(np.concatenate([into.cut(k[t]) for k, t in zip(keys, there, strict=True)]), return_counts=True)

    def score(_: int, ids: list, texts: list[bytes], counts: np.ndarray) -> pa.Table:
        bounds, keys, there = grams(_decoded(texts), order)
        distinct, places = placed([into.cut(k[t]) for k, t in zip(keys, there, strict=True)])
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(n)), n)
        seen = []
        for at, t in zip(places, there, strict=True):
            found = np.zeros(len(owner), np.int64)
            found[t] = counts[at]
            if held_out:
                _, where, own = np.unique(owner[t] * distinct + at, return_inverse=True, return_counts=True)
                found[t] -= own[where]
            seen.append(found)
        logs, steps, base = np.log(np.maximum(seen[0], 1)), np.zeros(len(owner), np.int64), np.ones(len(owner), np.int64)
        for k in range(1, order):
            before = np.concatenate([[0], seen[k - 1][:-1]]) if len(owner) else seen[k - 1]
            hit = there[k] & (seen[k] > 0)
            logs = np.where(hit, np.log(np.maximum(seen[k], 1) / np.maximum(before, 1)), np.where(there[k], np.log(backoff) + logs, logs))
            steps, base = np.where(hit, 0, steps + there[k]), np.where(hit, 0, base)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (steps, base)]
        stepped, based = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
        total = np.bincount(owner, logs, minlength=len(n))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": n, "n_backoffs": stepped, "n_base": based, "logs": total})

    answers = exchange.answered(docs, keys_of, into, block_bytes)
    parts = shared.stored(exchange.matched(docs, answers, score, PARTS, block_bytes))
    # Words that no longer n-gram explains are divided by the number of words in the corpus, known only now.
    n_words = parts.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    others = F.lit(n_words) - F.col("n_words") if held_out else F.lit(n_words)
    score_of = F.col("logs") - F.col("n_base") * F.log(F.greatest(others, F.lit(1)).cast("double"))
    return parts.select("doc_id", "n_words", "n_backoffs", score_of.alias("score"), F.try_divide(score_of, F.col("n_words").cast("double")).alias("mean_score"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(shared.read(spark, sf_dir, "documents"))
