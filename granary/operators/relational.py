"""Searches over whole rows and tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.compare import sort_key


def row_text(df: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns]))


def search_rows(df: DataFrame, text: str, *, order: str | None = None, descending: bool = False) -> DataFrame:
    """Rows with the text in any cell, case aside, sorted by a column: numbers by value, before texts."""
    out = df.filter(row_text(df).contains(text.lower()))
    if order is None:
        return out
    return out.orderBy(sort_key(order).desc() if descending else sort_key(order).asc())


def search_tables(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """How many rows of each table hold the text; tables without any are left out."""
    counts = [df.filter(row_text(df).contains(text.lower())).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts).filter("n > 0")


def find_replace(df: DataFrame, key: str, column: str, text: str, new: str) -> DataFrame:
    """(key, column) of the rows whose column holds the text, case aside, with every place replaced."""
    pattern = "(?i)" + re.escape(text)
    value = F.col(column).cast("string")
    return df.filter(value.rlike(pattern)).select(key, F.regexp_replace(value, pattern, new.replace("\\", "\\\\").replace("$", "\\$")).alias(column))


def by_example(df: DataFrame, example: dict[str, str]) -> DataFrame:
    """Rows that match a form: a comparison sign and a value, a text with * for anything, `empty`, `not empty`, or a value."""
    tests = []
    for column, wanted in example.items():
        c, w = F.col(column), wanted.strip()
        if w.lower() in ("empty", "not empty"):
            filled = c.isNotNull() & (c.cast("string") != "")
            tests.append(filled if w.lower() == "not empty" else ~F.coalesce(filled, F.lit(False)))
        elif m := re.match(r"(<=|>=|<>|!=|<|>|=)\s*(.*)", w):
            value = F.lit(float(m[2])) if re.fullmatch(r"[+-]?\d+(\.\d+)?", m[2]) else F.lit(m[2])
            tests.append({"<=": c <= value, ">=": c >= value, "<>": c != value, "!=": c != value, "<": c < value, ">": c > value, "=": c == value}[m[1]])
        elif "*" in w:
            tests.append(c.cast("string").ilike(w.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")))
        else:
            tests.append(F.lower(c.cast("string")) == w.lower())
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
