"""The queries of the training-data operators and the SQL of those that DuckDB can run.

The operators' own queries hold what SQL cannot say: signatures, learned rules, links, tokens. What SQL can say of them
over whole tables has queries of its own.
"""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_NAMES = {
    "op1_near_dedup": "near_dedup",
    "op2_token_files": "token_files",
    "op3_lm_scores": "lm_scores",
    "op4_private_data": "private_data",
    "op5_packing": "packing",
    "op6_decontamination": "decontamination",
    "op7_secrets": "secrets",
    "op8_quality_rules": "quality",
    "op9_repeats": "repeats",
    "op10_length_totals": "length_totals",
}


def _lazy(module: str, name: str):
    return lambda spark, sf_dir: getattr(import_module(f"tidemark.llm.{module}"), name)(spark, sf_dir)


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the sets that near-duplicates are searched by."""
    from tidemark.llm import near_dedup, shared

    return near_dedup.sketched(shared.read(spark, sf_dir, "documents"), 4).select("doc_id", "n_shingles")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many strong secrets of each kind the scan finds."""
    from tidemark.llm import secrets

    return secrets.op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics behind the quality rules."""
    from tidemark.llm import quality, shared

    rows = quality.statistics(shared.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_BLANKS = "[ \\t-\\r]"
_WORDS = f"d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, [x FOR x IN string_split_regex(t, '{_BLANKS}+') IF x <> ''] AS ws FROM d)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)"""

_SQL = {
    "shingle_counts": f"WITH {_WORDS.replace("coalesce(text, '')", _LOWER)}, s AS (SELECT DISTINCT doc_id, ws[i:i + 3] AS k FROM w, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS u(i)) "
    "SELECT doc_id, count(k) AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id",
    "secret_counts": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, len([x FOR x IN regexp_extract_all(t, '{_ASSIGN}', 1) IF length(x) >= 8]) AS n_assign, "
    "len([x FOR x IN regexp_extract_all(t, 'AKIA[A-Z0-9]+') IF length(x) >= 16]) AS n_access, len([x FOR x IN regexp_extract_all(t, '[0-9a-f]+') IF length(x) >= 32]) AS n_hex FROM d",
    "quality_statistics": f"WITH {_WORDS}, windows AS (SELECT doc_id, i, ws[i:i + 4] AS k FROM w, unnest(range(1, len(ws) - 3)) AS u(i)), again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), "
    "covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 5) AS r(j) GROUP BY doc_id), "
    f"counts AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_BLANKS}', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^ \\t-\\r]')] AS lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)) "
    "SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts",
}


def queries() -> dict:
    own = {name: _lazy(module, name) for name, module in _NAMES.items()}
    return own | {"shingle_counts": shingle_counts, "secret_counts": secret_counts, "quality_statistics": quality_statistics}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
