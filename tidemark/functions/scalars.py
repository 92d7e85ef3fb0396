"""Small column expressions: symbols, defaults, JSON, sides and prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_column(c), r"^\s+|\s+$", "")


def normal_symbol(c: Column | str) -> Column:
    """Upper case, without an exchange before the last colon; null where nothing is left."""
    return F.nullif(strip(F.element_at(F.split(F.upper(strip(c)), ":"), -1)), F.lit(""))


def resolved_symbol(inner: Column | str, outer: Column | str) -> Column:
    """The message's own symbol, else its envelope's."""
    return normal_symbol(F.coalesce(_column(inner), _column(outer)))


def instrument_key(exchange: Column | str, symbol: Column | str) -> Column:
    return F.concat_ws(":", F.upper(strip(exchange)), F.upper(strip(symbol)))


def table_key(symbol: Column | str) -> Column:
    """A symbol as a partition name: lower case letters, digits and underscores, after quote_."""
    return F.concat(F.lit("quote_"), F.lower(F.regexp_replace(_column(symbol), r"[^\p{L}\p{N}_]", "")))


def json_number(raw: Column | str, path: str) -> Column:
    """A number in a JSON text, null where there is none."""
    return F.get_json_object(_column(raw), path).try_cast("double")


def first_filled(*arrays: Column | str) -> Column:
    """The first array with elements; an empty one if there is none."""
    columns = [_column(a) for a in arrays]
    filled = reduce(lambda case, a: case.when(F.size(a) > 0, a), columns[1:], F.when(F.size(columns[0]) > 0, columns[0]))
    return F.coalesce(filled, F.slice(F.coalesce(*columns), 1, 0))


def head(array: Column | str) -> Column:
    return F.get(_column(array), 0)


def any_date(c: Column | str) -> Column:
    """A date in one of the forms 05-Jan-2026, 2026-01-05 or 05/01/2026; null for others."""
    text = strip(c)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(p))) for p in ("d-MMM-yyyy", "yyyy-MM-dd", "d/M/yyyy")])


def mode_label(mode: Column | str) -> Column:
    return F.initcap(strip(mode))


def breakout_side(price: Column | str, high: Column | str, low: Column | str) -> Column:
    """BUY above the high, SELL below the low, null between; equal prices break nothing."""
    return F.when(_column(price) > _column(high), "BUY").when(_column(price) < _column(low), "SELL")


def stop_price(side: Column | str, price: Column | str, fraction: float = 0.002) -> Column:
    return F.when(_column(side) == "BUY", _column(price) * (1 - fraction)).otherwise(_column(price) * (1 + fraction))


def stop_hit(side: Column | str, price: Column | str, stop: Column | str) -> Column:
    """A stop is hit by its own price too."""
    return F.when(_column(side) == "BUY", _column(price) <= _column(stop)).otherwise(_column(price) >= _column(stop))


def opposite(side: Column | str) -> Column:
    return F.when(_column(side) == "BUY", "SELL").otherwise("BUY")


def closing_side(quantity: Column | str) -> Column:
    """What closes a position of this signed quantity."""
    return F.when(_column(quantity) > 0, "SELL").when(_column(quantity) < 0, "BUY")
