"""Column helpers that reproduce the R / dplyr semantics the workflow relies on.

Each helper is a plain Spark ``Column`` expression, so it stays inside
whole-stage code generation and partial (map-side) aggregation.

R1  n_distinct counts NA as one value          -> :func:`n_distinct`
R2  sum/max/min are NA if any input is NA      -> :func:`na_sum`, :func:`na_max`, :func:`na_min`
R3  ``!(x %in% v)`` keeps NA rows              -> :func:`not_in`
R5  paste turns NA into the text "NA"          -> :func:`paste`
R9  failed ymd / as.numeric give NA            -> :func:`ymd`, :func:`as_numeric`
R10 a Date compared with a number uses days    -> :func:`date_as_number`
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def n_distinct(x) -> Column:
    """dplyr ``n_distinct``: distinct values, with NA counted as one more value."""
    c = _c(x)
    return (F.count_distinct(c)
            + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))).cast("long")


def na_sum(x) -> Column:
    """R ``sum``: NA as soon as one input is NA (empty group: NA as well)."""
    c = _c(x)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def na_max(x) -> Column:
    c = _c(x)
    return F.when(F.count(c) == F.count(F.lit(1)), F.max(c))


def na_min(x) -> Column:
    c = _c(x)
    return F.when(F.count(c) == F.count(F.lit(1)), F.min(c))


def not_in(x, values) -> Column:
    """``!(x %in% values)``: ``%in%`` is never NA, so NA rows are kept."""
    return ~F.coalesce(_c(x).isin(list(values)), F.lit(False))


def paste(*parts, sep: str = "") -> Column:
    """R ``paste(..., sep=sep)``; NA becomes the text ``NA``."""
    cols = [F.coalesce(_c(p).cast("string"), F.lit("NA")) for p in parts]
    return F.concat_ws(sep, *cols)


def ymd(key) -> Column:
    """lubridate ``ymd`` on an int ``yyyyMMdd`` key; unparsable keys give NULL."""
    return F.try_to_date(_c(key).cast("string"), "yyyyMMdd")


def as_numeric(x) -> Column:
    """R ``as.numeric`` on text: anything that is not a number becomes NULL."""
    return _c(x).try_cast("double")


def date_as_number(d) -> Column:
    """A Date used as a number in R: days since 1970-01-01."""
    return F.unix_date(_c(d))


def date_key(d) -> Column:
    """Date -> int ``yyyyMMdd`` key (the inverse of :func:`ymd`)."""
    c = _c(d)
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")
