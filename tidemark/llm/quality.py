"""Quality rules: a decision list learned by sequential covering, as ordered Spark conditions over text statistics.

Statistics are built-in expressions over each whole text. Rules are grown and pruned on a bounded sample of labelled
documents; then each one is a conjunction of thresholds in a CASE expression. No rows go through Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import shared

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Labelled documents that rules are learned from, at most: those with the least hashes of their ids.
SAMPLE = 20_000
#: A rule must be right on at least this share of what it rejects, with one wrong case added, both where it was grown and where it was pruned.
PRECISION = 0.97
#: A rule must reject at least this share of the bad documents.
SUPPORT = 0.01
THRESHOLDS, CONDITIONS, RULES = 48, 3, 12
RATES = ["n_words", "word_length", "symbol_rate", "exclaim_rate", "upper_rate", "dup_line_rate", "repeat_rate", "distinct_rate"]
Rule = list[tuple[str, str, float]]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and base_failed and rates.

    Null texts count as empty: all counts are 0, and base_failed holds, as for each text of under 10 words. Whole texts
    count, however long. Rows are independent: repeated ones have equal results, and no rows give none. All other
    columns stay; a column of one of these names is replaced.
    """
    chars = lambda found: (F.length("_text") - F.length(F.translate("_text", found, ""))).cast("long")
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({
        "_words": F.array_remove(F.split("_text", "[ \\t-\\r]+"), ""),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")),
        "word_chars": F.length(F.translate("_text", BLANKS, "")).cast("long"),
        "n_symbols": chars(SYMBOLS),
        "_exclaims": chars("!"),
        "_capitals": chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    }).drop("_text")
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_n_lines": F.size("_lines"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_words", "_lines")
    at = lambda i, k: F.get("_hashes", i + k)
    starts = F.when(F.col("n_words") >= 5, F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_distinct", F.size(F.array_distinct("_hashes"))).withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))).drop("_hashes")
    # Only texts with a repeated window sort their windows, so that equal ones stand side by side.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("_windows")
    beside = lambda x, i: x["h"].eqNullSafe(F.get("_sorted", i - 1)["h"]) | x["h"].eqNullSafe(F.get("_sorted", i + 1)["h"])
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", beside), lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + 5).alias("end"), (a["n"] + 5 - F.greatest(F.lit(0), a["end"] - i)).alias("n")),
    )
    # A filter on a statistic must not sink into the array work above, where it would be worked out once per element:
    # an expression that the optimizer takes for indeterminate stops it. The condition always holds.
    df = df.withColumn("n_repeat_words", F.when(F.spark_partition_id() >= 0, covered["n"])).drop("_at")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return df.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "word_length": share("word_chars", "n_words"),
        "symbol_rate": share("n_symbols", "word_chars"),
        "exclaim_rate": share("_exclaims", "word_chars"),
        "upper_rate": share("_capitals", "word_chars"),
        "dup_line_rate": share("n_dup_lines", "_n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"),
        "distinct_rate": share("_distinct", "n_words"),
    }).drop("_exclaims", "_capitals", "_n_lines", "_distinct")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules that reject documents, from labels (doc_id, quality): quality 0 is to be rejected, 1 to be kept.

    At most sample labelled documents are used, those with the least hashes of their ids. Labels with a null in them
    are left out; no labels, or labels of one kind, give no rules.
    """
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows of two numbers
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # doc_ids may repeat
    rows = statistics(known).where("not base_failed").select((F.col("quality") == 0).cast("int").alias("bad"), (F.abs(F.xxhash64("doc_id", F.lit("fold"))) % 3).alias("fold"), *RATES).collect()
    if not rows:
        return []
    table = np.array([tuple(r) for r in rows], dtype=float)
    return cover(table[:, 2:], table[:, 0] > 0, table[:, 1] > 0, RATES)


def cover(rates: np.ndarray, bad: np.ndarray, growing: np.ndarray, names: list[str]) -> list[Rule]:
    """Sequential covering: rules are grown on some rows and pruned on the others; what a rule covers is then removed."""
    cuts = [np.unique(np.quantile(rates[:, k], np.linspace(0.005, 0.995, THRESHOLDS))) for k in range(rates.shape[1])] if len(rates) else []
    left, rules = np.ones(len(rates), dtype=bool), []
    while len(rules) < RULES:
        rule = _grow(rates, bad, left & growing, cuts)
        rule = _prune(rates, bad, left & ~growing, rule)
        rule = _widened(rates, bad, left & growing, rule)
        hit = _covered(rates, rule) & left
        if not rule or (hit & growing & bad).sum() < SUPPORT * bad.sum() or not all(_precise(bad, hit & part) for part in (growing, ~growing)):
            break
        rules.append([(names[k], op, float(cut)) for k, op, cut in rule])
        left &= ~hit
    return rules


def _widened(rates: np.ndarray, bad: np.ndarray, rows: np.ndarray, rule: list) -> list:
    """Thresholds moved halfway to what nearly all rejected rows have, so that a single odd character rejects nothing."""
    hit = _covered(rates, rule) & rows & bad
    if not hit.any():
        return rule
    return [(k, op, (cut + np.quantile(rates[hit, k], 0.05 if op == ">" else 0.95)) / 2) for k, op, cut in rule]


def _covered(rates: np.ndarray, rule: list) -> np.ndarray:
    hit = np.ones(len(rates), dtype=bool)
    for k, op, cut in rule:
        hit &= rates[:, k] > cut if op == ">" else rates[:, k] <= cut
    return hit


def _precise(bad: np.ndarray, hit: np.ndarray) -> bool:
    return bad[hit].sum() >= PRECISION * (hit.sum() + 1) if hit.sum() > 1 / (1 - PRECISION) else bool(hit.sum() >= 5 and bad[hit].all())


def _grow(rates: np.ndarray, bad: np.ndarray, rows: np.ndarray, cuts: list) -> list:
    rule: list = []
    while len(rule) < CONDITIONS:
        p, n = (rows & bad).sum(), (rows & ~bad).sum()
        if not p or not n:
            break
        best = (0.0, None, rows)
        for k, own in enumerate(cuts):
            for cut in own:
                above = rates[:, k] > cut
                for op, hit in ((">", rows & above), ("<=", rows & ~above)):
                    p1 = (hit & bad).sum()
                    if p1 and (gain := p1 * (np.log2(p1 / hit.sum()) - np.log2(p / (p + n)))) > best[0] * (1 + 1e-9):
                        best = (gain, (k, op, cut), hit)
        if best[1] is None:
            break
        rule.append(best[1])
        rows = best[2]
    return rule


def _prune(rates: np.ndarray, bad: np.ndarray, rows: np.ndarray, rule: list) -> list:
    """Drops last conditions while the rule does not get worse on rows that it was not grown on."""

    def worth(some: list) -> float:
        hit = _covered(rates, some) & rows
        p = (hit & bad).sum()
        return (2 * p - hit.sum()) / hit.sum() if hit.sum() else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row of statistics(): 0 the base rule, 1 on the learned ones, null if none."""
    case = F.when(F.col("base_failed"), 0)
    for n, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for name, op, cut in rule:
            holds = holds & (F.col(name) > cut if op == ">" else F.col(name) <= cut)
        case = case.when(holds, n)
    return case


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """statistics(docs) with rule (see verdict) and kept."""
    return statistics(docs).withColumn("rule", verdict(rules)).withColumn("kept", F.col("rule").isNull())


def filtered(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the rules learned from labels keep, with their own columns."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # a column of a statistic's name stays as it is
    return judged(whole, learn(docs, labels, sample)).where("kept").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    rows = judged(docs.select("doc_id", "text"), learn(docs, shared.read(spark, sf_dir, "labels")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
