"""Timeframe labels such as 30s, 5m or 1m30s."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"(\d+)([ms])"


def seconds(label: str) -> int:
    """Length of a timeframe: the sum of all its minute and second parts, in either case. None, or 0 in all, is an error."""
    total = sum(int(n) * (60 if unit == "m" else 1) for n, unit in re.findall(_PART, label.lower()))
    if not total:
        raise ValueError(f"not a timeframe: {label!r}")
    return total


def seconds_column(label: Column | str) -> Column:
    """seconds() of a column; null where it would be an error."""
    text = F.lower(F.col(label) if isinstance(label, str) else label)
    numbers, units = (F.regexp_extract_all(text, F.lit(_PART), F.lit(k)) for k in (1, 2))
    parts = F.zip_with(numbers, units, lambda n, u: n.cast("bigint") * F.when(u == "m", 60).otherwise(1))
    return F.nullif(F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
