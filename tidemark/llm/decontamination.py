"""Benchmark decontamination: BM25 with block-max WAND over an index of the test items, then verification.

Every passage of every document is a query. Scores are divided by what an item scores against itself, so one threshold
serves all. The index holds, per term, its weight in each item and its largest weight in each block of items. The terms
that most items share cannot reach the threshold together; the others' block maxima bound a passage's score for a
block, and only passages and blocks that may reach the threshold are scored. As all passages above a fixed threshold are
wanted, not the best k, the bound never rises while searching: so it is worked out for all passages of a batch at once,
where the usual form moves a pivot from one item to the next. What
scores enough is verified: question and answer are aligned with the passage, so that a changed, missing or added word
costs one word, wherever it is, and words out of order or scattered over the passage count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared, words

THRESHOLD = 0.5
#: Shares of the question's and of the answer's words that a passage must have, in order and close together.
QUESTION, ANSWER = 0.5, 0.5
#: A passage with this share of all the item's words is a leak even if the answer, maybe a word or two, was changed.
WHOLE = 0.8
#: An answer of so few words may be lost to one or two edits: this share of all the item's words is enough then.
SHORT, SHORT_WHOLE = 3, 0.7
#: Passages of short items have a stride of so many words; those of longer items, of the next power of two.
STRIDE = 32
#: Items of fewer words are no evidence of a leak inside of a text: they are found where they are the whole text.
LEAST_WORDS = 5
BLOCK = 8
#: Text of items in one broadcast; more items are searched one part after the other.
INDEX_BYTES = 32 << 20
K1, B = 1.2, 0.75
_MARKS = b".,;:!?\"'()[]{}*_#`"
_EMPTY = words.mix(np.zeros(1, np.uint64))[0]
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of lower-cased texts without punctuation; words of punctuation alone are left out."""
    hashes, bounds = words.words([t.lower() for t in texts], _MARKS)
    kept = hashes != _EMPTY
    return hashes[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


@dataclass
class Index:
    ids: np.ndarray  # of the items
    longest: int  # words of the longest item, or a bound of them
    terms: np.ndarray  # sorted hashes
    offsets: np.ndarray  # of each term's postings
    items: np.ndarray  # of postings
    weights: np.ndarray
    essential: np.ndarray  # by term: not among those that most items share
    block_offsets: np.ndarray  # of each term's block maxima, none for shared terms
    blocks: np.ndarray
    maxima: np.ndarray
    shared_most: np.ndarray  # by block: what the shared terms can add
    questions: list  # hashes of words in order, by item
    answers: list
    wholes: list
    short: dict  # items of too few words to be searched: their words' hashes, and the ids of those who have them


@dataclass
class Statistics:
    """What scores need to know of all items, whichever index these are in."""

    n_items: int
    n_words: int
    terms: np.ndarray  # sorted hashes
    df: np.ndarray


def statistics(texts: list[str]) -> Statistics:
    hashes, bounds = _hashed(texts)
    n = np.diff(bounds)
    good, owner = n >= LEAST_WORDS, np.repeat(np.arange(len(texts)), n)
    pairs = np.unique(np.stack([hashes[good[owner]], owner[good[owner]].astype(np.uint64)]), axis=1)
    terms, df = np.unique(pairs[0], return_counts=True)
    return Statistics(int(good.sum()), int(n[good].sum()), terms, df)


def _added(a: Statistics, b: Statistics) -> Statistics:
    terms, where = np.unique(np.concatenate([a.terms, b.terms]), return_inverse=True)
    df = np.bincount(where, np.concatenate([a.df, b.df]), minlength=len(terms)).astype(np.int64)
    return Statistics(a.n_items + b.n_items, a.n_words + b.n_words, terms, df)


def index_of(ids: list[int], texts: list[str], threshold: float = THRESHOLD, known: Statistics | None = None, longest: int | None = None) -> Index:
    """The index of items; an item's question is all but its last sentence, or two thirds of an only sentence.

    known are the statistics of all items and longest a bound of the words of items, if there are items elsewhere.
    """
    known = known or statistics(texts)
    hashes, bounds = _hashed(texts)
    n = np.diff(bounds)
    good = np.flatnonzero(n >= LEAST_WORDS)
    owner = np.repeat(np.arange(len(texts)), n)
    kept = np.isin(owner, good)
    pairs, tf = np.unique(np.stack([hashes[kept], np.searchsorted(good, owner[kept]).astype(np.uint64)]), axis=1, return_counts=True)
    term_hash, item = pairs[0], pairs[1].astype(np.int64)
    terms, term, df = np.unique(term_hash, return_inverse=True, return_counts=True)
    lengths = n[good]
    everywhere = known.df[np.searchsorted(known.terms, terms)]
    norm = K1 * (1 - B + B * lengths / max(known.n_words / max(known.n_items, 1), 1))
    weights = np.log(1 + (known.n_items - everywhere + 0.5) / (everywhere + 0.5))[term] * tf * (K1 + 1) / (tf + norm[item])
    own = np.bincount(item, weights, minlength=len(good))
    weights = weights / own[item]
    by_df, common = np.argsort(-df, kind="stable"), np.zeros(len(good))
    essential, offsets = np.ones(len(terms), bool), np.concatenate([[0], np.cumsum(df)])
    for t in by_df:  # the most frequent terms, as long as no item gets half the threshold from them
        rows = slice(offsets[t], offsets[t + 1])
        if (common[item[rows]] + weights[rows]).max() > threshold / 2:
            break
        common[item[rows]] += weights[rows]
        essential[t] = False
    n_blocks = max(1, -(-len(good) // BLOCK))
    lead = essential[term]
    keys, where = np.unique(term[lead] * n_blocks + item[lead] // BLOCK, return_inverse=True)
    maxima = np.zeros(len(keys))
    np.maximum.at(maxima, where, weights[lead])
    shared_most = np.zeros(n_blocks)
    np.maximum.at(shared_most, np.arange(len(good)) // BLOCK, common)
    questions, answers, wholes = [], [], []
    for k in good:
        own_words = hashes[bounds[k] : bounds[k + 1]]
        sentences = texts[k].strip().rstrip(".?!").replace("?", ".").replace("!", ".").replace("\n", " ").rpartition(". ")
        cut = len(_hashed([sentences[0]])[0]) if sentences[0] else 0
        if cut < 2 or len(own_words) - cut < 1:
            cut = max(1, 2 * len(own_words) // 3)
        own_words = words.mix(own_words)
        questions.append(own_words[:cut])
        answers.append(own_words[cut:])
        wholes.append(own_words)
    short: dict[tuple, list[int]] = {}
    for k in np.flatnonzero((n > 0) & (n < LEAST_WORDS)):
        short.setdefault(tuple(hashes[bounds[k] : bounds[k + 1]].tolist()), []).append(int(ids[k]))
    return Index(np.array(ids, np.int64)[good], longest or (int(lengths.max()) if len(good) else 0), terms, offsets, item, weights, essential, np.searchsorted(keys // n_blocks, np.arange(len(terms) + 1)), keys % n_blocks, maxima, shared_most, questions, answers, wholes, short)


def _aligned(part: np.ndarray, there: list[int]) -> tuple[float, int]:
    """The share of part's words left after the fewest edits that turn part into some stretch of there, and that stretch's end.

    Edits change, drop or add a word. Myers' algorithm: a column of the table of distances is two numbers of a bit a word.
    """
    size, marks = len(part), {}
    for k, word in enumerate(part.tolist()):
        marks[word] = marks.get(word, 0) | 1 << k
    full, last = (1 << size) - 1, 1 << (size - 1)
    up, down, edits, least, end = full, 0, size, size, 0
    for at, word in enumerate(there):
        same = marks.get(word, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | full & ~(across | up), up & across
        edits += bool(more & last) - bool(less & last)
        more, less, same = more << 1 & full, less << 1 & full, same | down
        up, down = less | full & ~(same | more), more & same
        if edits < least:
            least, end = edits, at + 1
    return 1 - least / size, end


def _verified(index: Index, item: int, there: np.ndarray) -> tuple[float, float] | None:
    """Overlaps of an item's question and answer with a passage's words, None if they are no evidence of a leak."""
    question, answer, all_words = index.questions[item], index.answers[item], index.wholes[item]
    most = [float(np.isin(part, there).mean()) for part in (question, answer, all_words)]  # no alignment has more
    if not _leaked(*most, len(answer)):
        return None
    text, size = there.tolist(), len(all_words)
    whole, end = _aligned(all_words, text)
    near = text[max(0, end - 2 * size) : end + size]
    (q, _), (a, _) = _aligned(question, near), _aligned(answer, near)
    return (q, a) if _leaked(q, a, whole, len(answer)) else None


def _leaked(question: float, answer: float, whole: float, answer_words: int) -> bool:
    return question >= QUESTION and answer >= ANSWER or whole >= (SHORT_WHOLE if answer_words <= SHORT else WHOLE)


def _expand(offsets: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a list of terms: which of the list, and which posting, each of their postings is."""
    n = offsets[terms + 1] - offsets[terms]
    which = np.repeat(np.arange(len(terms)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[terms], n)


def search(index: Index, texts: list[str], threshold: float = THRESHOLD) -> list[tuple]:
    """All verified matches: (place in texts, item, score, question overlap, answer overlap, first word of the passage)."""
    return _search(index, *_hashed(texts), threshold)


def searched(part: list[Index], texts: list[str]) -> list[tuple]:
    """The matches of all indexes of a part, as search() gives them."""
    hashes, bounds = _hashed(texts)
    return [match for index in part for match in _search(index, hashes, bounds, THRESHOLD)]


def _search(index: Index, hashes: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple]:
    found = []
    if index.short:
        for d in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < LEAST_WORDS)).tolist():
            found += [(d, item, 1.0, 1.0, 1.0, 0) for item in index.short.get(tuple(hashes[bounds[d] : bounds[d + 1]].tolist()), ())]
    return found + _search_passages(index, hashes, bounds, threshold) if len(index.ids) and len(hashes) else found


def _search_passages(index: Index, hashes: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple]:
    stride = max(STRIDE, index.longest)  # passages of two strides overlap by one, so each copy of an item lies in one whole
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == hashes)
    term = at[known]
    doc = np.searchsorted(bounds, known, side="right") - 1
    piece = (known - bounds[doc]) // stride
    n_pieces = np.maximum(1, -(-np.diff(bounds) // stride))
    first = np.concatenate([[0], np.cumsum(n_pieces)])
    passage = first[doc] + piece  # a passage is a piece and the one after it
    lead = index.essential[term]
    back = lead & (piece > 0)
    n_terms = len(index.terms)
    asked = np.unique(np.concatenate([passage[lead] * n_terms + term[lead], (passage[back] - 1) * n_terms + term[back]]))
    which, posting = _expand(index.block_offsets, asked % n_terms)
    n_blocks = len(index.shared_most)
    key = (asked // n_terms)[which] * n_blocks + index.blocks[posting]
    keys, inverse = np.unique(key, return_inverse=True)
    bound = np.bincount(inverse, index.maxima[posting], minlength=len(keys)) if len(keys) else np.zeros(0)
    may = keys[bound + index.shared_most[keys % n_blocks] >= threshold - 1e-9]
    out = {}
    for p in np.unique(may // n_blocks):
        blocks = may[np.searchsorted(may, p * n_blocks) : np.searchsorted(may, (p + 1) * n_blocks)] % n_blocks
        d = int(np.searchsorted(first, p, side="right") - 1)
        start = bounds[d] + (p - first[d]) * stride
        here = hashes[start : min(start + 2 * stride, bounds[d + 1])]
        own = np.unique(term[np.searchsorted(known, start) : np.searchsorted(known, start + len(here))])
        _, posting = _expand(index.offsets, own)
        posting = posting[np.isin(index.items[posting] // BLOCK, blocks)]
        scores = np.bincount(index.items[posting], index.weights[posting], minlength=len(index.ids))
        hits = np.flatnonzero(scores >= threshold - 1e-9)
        if not len(hits):
            continue
        there = words.mix(here)
        for i in hits:
            overlaps = _verified(index, i, there) if scores[i] > out.get((d, i), (0.0,))[0] else None
            if overlaps:
                out[d, i] = (float(scores[i]), *overlaps, int(start - bounds[d]))
    return [(d, int(index.ids[i]), *rest) for (d, i), rest in out.items()]


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[list[Index]]:
    """Parts of items (item_id, text), each of about index_bytes of text at most, as indexes of items of similar length.

    Neither weights nor passages depend on the parts: statistics are those of all items, and an item's own length gives
    its stride. Null texts have no place, nor have items without words. One part at a time is on the driver; what stays
    there are the terms of all items with their numbers.
    """
    items = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // index_bytes))

    def rows_of(k: int) -> list:
        return items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()

    first, known = rows_of(0), statistics([])
    for k in range(parts):
        known = _added(known, statistics([r["text"] for r in (rows_of(k) if k else first)]))
    for k in range(parts):
        rows, by_stride = rows_of(k) if k else first, {}
        n = np.diff(_hashed([r["text"] for r in rows])[1])
        for r, words_of in zip(rows, n.tolist(), strict=True):
            if words_of:
                by_stride.setdefault(max(STRIDE, 1 << (words_of - 1).bit_length()), []).append(r)
        if by_stride:
            yield [index_of([-1 if r["item_id"] is None else r["item_id"] for r in own], [r["text"] for r in own], known=known, longest=stride) for stride, own in sorted(by_stride.items())]


def leaks(docs: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word: the best passage of each document and item that match.

    Whole texts are searched, however long; null and empty ones match nothing. Repeated documents give repeated rows, as
    do repeated items; no items or no documents give no rows. Rows without doc_id are searched too. Other columns are
    left out. An item without id counts as -1. Items of under LEAST_WORDS words match texts that are nothing else.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = shared.spread(docs.select("doc_id", "text"))
    out = None
    for indexed in indexes(items, index_bytes):
        known = spark.sparkContext.broadcast(indexed)

        def run(batch: pa.RecordBatch, known=known) -> pa.RecordBatch | None:
            found = searched(known.value, shared.texts_of(batch))
            if not found:
                return None
            doc, *columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), *[pa.array(c) for c in columns]], [f.split()[0] for f in FOUND.split(", ")])

        part = shared.arrow_rows(rows, run, FOUND)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], FOUND)


def decontaminated(docs: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs, all columns, without the rows that leaks() finds.

    Rows are independent: null ids and null texts stay, repeated rows stay or go together, no items leave all.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    for indexed in indexes(items, index_bytes):
        known = spark.sparkContext.broadcast(indexed)

        def run(batch: pa.RecordBatch, known=known) -> pa.RecordBatch:
            clean = np.ones(batch.num_rows, bool)
            clean[[f[0] for f in searched(known.value, shared.texts_of(batch))]] = False
            return batch.filter(pa.array(clean))

        docs = shared.arrow_rows(docs, run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(shared.read(spark, sf_dir, "documents"), shared.read(spark, sf_dir, "benchmark"))
