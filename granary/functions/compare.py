"""Comparison by the dialect's rules, for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a text must look like to count as a number; letters but e make it a text.
NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cmp_key(c: str | Column) -> Column:
    """A text's key: numeric texts by their number, so that '010' equals '10', others without case and trailing spaces."""
    x = _column(c).cast("string")
    number = x.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
    return F.when(x.rlike(NUMERIC), whole).otherwise(F.lower(F.rtrim(x)))


def fold(c: str | Column) -> Column:
    """The column under the collation that ignores case and trailing spaces."""
    return F.collate(_column(c).cast("string"), "UTF8_LCASE_RTRIM")


def lenient(c: str | Column) -> Column:
    """The number that a text begins with, else 0; NULL stays."""
    x = F.trim(_column(c).cast("string"))
    return F.when(x.isNull(), None).otherwise(F.coalesce(F.regexp_extract(x, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0).try_cast("double"), F.lit(0.0)))


def truthy(c: str | Column) -> Column:
    return lenient(c) != 0


def sort_key(c: str | Column) -> Column:
    """Numbers before texts, by value; texts without case."""
    x = _column(c).cast("string")
    number = F.when(x.rlike(NUMERIC), x.try_cast("double"))
    return F.struct(number.isNull().alias("text"), number.alias("number"), F.lower(x).alias("value"))
