"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Strict patterns give the base spans, which always stay. Looser candidates (numbers that may be telephones or ids,
spelled-out mail addresses, names) get votes from a shape labeler, a gazetteer and a context labeler, and features of
their own: how long they are, what stands before and after them, whether the document has other personal data and how
near. How often each combination of votes and features occurs is counted over all documents; there are some thousand
combinations at any size, so expectation-maximisation for the labelers' reliabilities, and the training of a classifier
of spans towards its posteriors, work on counts alone. The classifier decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "number", "spelled", "person"]
#: A candidate's probability must reach this.
CERTAIN = 0.9
#: Characters before a candidate in which the context labeler looks for its words, and around it for other personal data.
CONTEXT, NEAR = 48, 200
#: Values of a candidate's features: votes (against, none, for) of shape, gazetteer and context; size; what stands before
#: and after (an edge of a line, a blank, a mark, something else); other personal data (none, in the document, near); kind.
FIELDS = (3, 3, 3, 4, 4, 4, 3, 7)
SPANS = "array<struct<start:int,kind:int,end:int>>"
VOTED = "array<struct<start:int,kind:int,end:int,features:int>>"

# Parts of the four strict patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9A-Za-z.,/-])")
_SPELLED = re.compile(r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)+(?![A-Za-z0-9_-])")
_PERSON = re.compile(r"(?<![A-Za-z])[A-Z][a-z]++(?:\x20[A-Z]\.)?\x20[A-Z][a-z]++(?![A-Za-z])")
_CONTEXT = {
    4: re.compile(r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|contact|ssn|social security|passport)\b[^\n]{0,24}$"),
    5: re.compile(r"(?i)(?:e-?mail|mail|contact|write|reach|address)\b[^\n]{0,24}$"),
    6: re.compile(r"(?i)(?:name is|named|mr\.?|mrs\.?|ms\.?|dr\.?|signed|sincerely|regards|contact|patient|customer)[,:]?\s*$"),
}
#: Common first names of several languages; found() takes a longer list.
FIRST_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Nancy Daniel Lisa Matthew Betty Anthony Margaret Mark Sandra "
    "Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Dorothy George Melissa Edward Deborah Maria Anna Hans Peter Klaus Sabine Wolfgang Monika Stefan Petra Andreas Heike "
    "Jean Pierre Marie Sophie Philippe Isabelle Nicolas Camille Carlos Jose Juan Ana Luis Carmen Miguel Lucia Javier Elena Wei Li Min Yan Mohammed Ahmed Fatima Aisha Ali Omar Raj Priya Amit Sunita Igor Dmitri Natasha Svetlana".split()
)
#: Capitalised words that are no names; the list of first names is short, so that it can only speak for one.
_NO_NAMES = frozenset(
    "The This That These Those There Then They We You He She It In On At Of For From To By With And Or But If When Where What Who Why How As Is Are Was Were Be Has Have Had Do Does Did Not No Yes All Any Some Our Your My His Her Its Their "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "New North South East West Street Road Avenue City University College School Company Inc Ltd License Public General Software Foundation Service Center Department United States Please Dear Thank Thanks Contact Customer Patient Signed Sincerely Regards".split()
)
_DOMAIN_ENDS = frozenset("com org net edu gov mil int info biz io co me dev app ai eu de at ch fr be nl lu es pt it uk ie dk se no fi pl cz sk hu ro bg gr tr ru ua us ca mx br ar cl au nz jp cn kr in sg hk za".split())


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) - 9 * (d > "4") for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs of letters cost nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Matches of four dotted numbers: each dotted run is cut into fours from its left."""
    out = []
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        start = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((start, end))
            start = end + 1
    return out


def strict(text: str) -> list[tuple[int, int, int]]:
    """The base spans (start, kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(a, 1, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _features(*values: int) -> int:
    """One number of a value for each of FIELDS."""
    out = 0
    for value, n in zip(reversed(values), reversed(FIELDS), strict=True):
        out = out * n + value
    return out


def fields_of(features: np.ndarray) -> np.ndarray:
    """Rows of the values that _features() was given."""
    out = []
    for n in FIELDS:
        out.append(features % n)
        features = features // n
    return np.stack(out, axis=1)


def votes_of(features: np.ndarray) -> np.ndarray:
    """Rows of -1, 0, 1: shape, gazetteer, context."""
    return fields_of(features)[:, :3] - 1


def _beside(char: str) -> int:
    return 0 if char in ("", "\n") else 1 if char.isspace() else 2 if not char.isalnum() else 3


def candidates(text: str, base: list[tuple[int, int, int]], digits: bool, names_known: frozenset = FIRST_NAMES) -> list[tuple[int, int, int, int]]:
    """Looser spans that touch no base span: (start, kind, end, features)."""
    found = [(m, 4) for m in _NUMBER.finditer(text)] if digits else []
    lowered = text.lower()
    found += [(m, 5) for m in _SPELLED.finditer(text)] if " dot " in lowered or "[dot]" in lowered or "(dot)" in lowered else []
    found += [(m, 6) for m in _PERSON.finditer(text)]
    out, at, reach = [], 0, -NEAR - 1
    for m, kind in sorted(found, key=lambda x: x[0].start()):
        a, b = m.span()
        while at < len(base) and base[at][2] <= a:
            reach = max(reach, base[at][2])
            at += 1
        if at < len(base) and base[at][0] < b:
            continue
        near = a - reach <= NEAR or at < len(base) and base[at][0] - b <= NEAR
        value, before = m[0], text[max(0, a - CONTEXT) : a]
        context = 2 if _CONTEXT[kind].search(before) else 1
        if kind == 4:
            n = sum(c.isdigit() for c in value)
            shape, gazetteer, size = 2 if 7 <= n <= 15 else 0, 2 if re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}", value) else 1, min(3, n // 4)
        elif kind == 5:
            end = re.split(r"[^A-Za-z0-9-]+", value)[-1].lower()
            shape, gazetteer, size = 2 if end.isalpha() and 2 <= len(end) <= 6 else 0, 2 if end in _DOMAIN_ENDS else 0, min(3, len(value) // 12)
        else:
            names = value.split(" ")
            shape, gazetteer, size = 0 if names[0] in _NO_NAMES or names[-1] in _NO_NAMES or names[0] == names[-1] else 2, 2 if names[0] in names_known else 1, min(3, len(value) // 8)
        beside = _beside(text[a - 1 : a]), _beside(text[b : b + 1])
        out.append((a, kind, b, _features(shape, gazetteer, context, size, *beside, 2 if near else 1 if base else 0, kind)))
    return out


def labelled(docs: DataFrame, names: frozenset = FIRST_NAMES) -> DataFrame:
    """doc_id, base and voted of each row of docs (doc_id, text; other columns are left out), in the shared folder.

    Whole texts are read, however long; null ones count as empty. Rows are independent: repeated ones and null ids give
    as many rows, no rows give none.
    """
    shared.small_batches(docs.sparkSession)
    something = re.compile("[0-9@]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        voted = pa.struct([*span, pa.field("features", pa.int32())])
        for batch in batches:
            bases, others = [], []
            for text in shared.texts_of(batch):
                some = something.search(text) is not None
                base = strict(text) if some else []
                bases.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in base])
                others.append([dict(zip(("start", "kind", "end", "features"), s, strict=True)) for s in candidates(text, base, some, names)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(bases, pa.list_(span)), pa.array(others, pa.list_(voted))], ["doc_id", "base", "voted"])

    return shared.stored(shared.spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id long, base {SPANS}, voted {VOTED}"))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes: how often each labeler that votes is right, and each row's posterior. A prior keeps both stable.

    That a labeler does not vote is evidence too: how often it votes is learned for each class. The share of the class
    that counts is at most a half, so that votes of one labeler alone cannot prove each other.
    """
    right, share = np.full(votes.shape[1], 0.8), 0.5
    cast = votes != 0
    often = np.full((2, votes.shape[1]), 0.5)  # of votes cast, by class
    post = np.full(len(votes), 0.5)
    for _ in range(rounds):
        no, yes = np.log([[1 - share], [share]]) + np.stack([np.where(cast, np.log(o), np.log(1 - o)).sum(axis=1) for o in often])
        yes = yes + np.where(cast, np.where(votes > 0, np.log(right), np.log(1 - right)), 0).sum(axis=1)
        no = no + np.where(cast, np.where(votes > 0, np.log(1 - right), np.log(right)), 0).sum(axis=1)
        post = 1 / (1 + np.exp(no - yes))
        agree = np.where(votes > 0, post[:, None], 1 - post[:, None]) * cast * counts[:, None]
        right = np.clip((agree.sum(axis=0) + 16) / ((cast * counts[:, None]).sum(axis=0) + 20), 0.55, 0.98)
        # Both classes start from how often the labeler votes at all: where nothing tells them apart, silence says nothing.
        rate = ((cast * counts[:, None]).sum(axis=0) + 1) / (counts.sum() + 2)
        often = np.stack([((cast * (p * counts)[:, None]).sum(axis=0) + 20 * rate) / ((p * counts).sum() + 20) for p in (1 - post, post)])
        often = np.clip(often, 0.01, 0.99)
        share = np.clip(((post * counts).sum() + 5) / (counts.sum() + 10), 0.02, 0.5)
    return right, post


def _design(fields: np.ndarray) -> np.ndarray:
    """A column for each value of each field but the kind, and one for all."""
    return np.concatenate([np.ones((len(fields), 1)), *[np.eye(n)[fields[:, k]] for k, n in enumerate(FIELDS[:-1])]], axis=1)


def classifier(fields: np.ndarray, post: np.ndarray, counts: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression of one kind's spans on votes and span features, towards the posteriors, by Newton's steps.

    Returns each row's probability. A ridge keeps what few spans have near what all have.
    """
    x, ridge = _design(fields), np.full(1 + sum(FIELDS[:-1]), 0.1)
    ridge[0] = 1e-3
    weight = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (counts * (p - post)) + ridge * weight
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        weight -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))


def accepted(voted: DataFrame) -> list[int]:
    """Feature numbers of candidates that count as personal data, learned from their counts over all rows of labelled()."""
    found = voted.select(F.explode("voted.features").alias("features")).groupBy("features").count()
    rows = found.orderBy("features").collect()  # at most one row per combination of FIELDS that can occur
    if not rows:
        return []
    features, counts = (np.array([r[k] for r in rows]) for k in ("features", "count"))
    fields, sure = fields_of(features), np.zeros(len(features), bool)
    for kind in np.unique(fields[:, -1]):  # a labeler may be good at one kind and bad at another
        own = np.flatnonzero(fields[:, -1] == kind)
        votes, where = np.unique(fields[own, :3], axis=0, return_inverse=True)
        _, post = reliabilities(votes - 1, np.bincount(where.ravel(), counts[own]))
        sure[own] = classifier(fields[own], post[where.ravel()], counts[own]) >= CERTAIN
    return [int(f) for f in features[sure]]


def written(spans: str | Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame, names: frozenset = FIRST_NAMES) -> DataFrame:
    """doc_id, base and spans: arrays of structs (start, kind, end) by start, then kind, in code points, the end exclusive.

    names is the gazetteer of first names. See labelled() for odd rows.
    """
    rows = labelled(docs, names)
    taken = accepted(rows)
    more = F.filter("voted", lambda s: s["features"].isin(taken)) if taken else F.filter("voted", lambda s: F.lit(False))
    more = F.transform(more, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(shared.read(spark, sf_dir, "documents"))
    counts = [shared.count_of("base", "kind", i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return rows.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
