"""Small helpers shared by all column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    """Trim all ASCII white space (SQL `trim` removes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`.

    The last step of an `aggregate` over nothing: the value is bound as it is. A `transform` of a one-element array would
    copy what the body gives and derive the types of the whole body again for every row, at each level of nesting.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def none_if_empty(c: Column) -> Column:
    """`regexp_extract` answers '' when nothing matched."""
    return let(c, lambda t: F.when(t != "", t))


def last(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return none_if_empty(F.regexp_extract(text, pattern, group))


def digits_to_double(c: Column) -> Column:
    """Cast a text known to hold nothing but digits, signs, dots and commas; NULL if it is no number."""
    return F.translate(c, ",", "").try_cast("double")


def to_double(c: Column) -> Column:
    """Cast only what looks like a number: Spark alone would also take `5d`."""
    return let(c, lambda t: F.when(t.rlike(NUMERIC), t.try_cast("double")))


def plain_text(value: Column) -> Column:
    """Shortest decimal text of a double, never in scientific notation between 1e-18 and 1e18."""

    def text(v: Column) -> Column:
        small = (F.abs(v) >= 1e-3) & (F.abs(v) < 1e7) | (v == 0)
        decimal = F.regexp_replace(v.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?[1-9])0+$|\.0+$", "$1")
        return F.when(small, v.cast("string")).otherwise(F.coalesce(decimal, v.cast("string")))

    return let(value, text)


def rewrite_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match of `pattern` by a computed text (a `regexp_replace` with a callback)."""

    def rewritten(t: Column) -> Column:
        replaced = F.transform(find_all(t, pattern), rewrite)
        pieces = F.zip_with(F.split(t, pattern, -1), replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    return let(text, rewritten)
