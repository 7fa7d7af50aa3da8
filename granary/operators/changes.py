"""What breaks a table's rules, as rows of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.model import folded_key


def repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    """(key, n): values of the columns, case and trailing spaces aside, that several rows have; NULL is exempt."""
    filled = df.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns]))
    return filled.groupBy(F.concat_ws(", ", *[folded_key(c) for c in columns]).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, key: str, column: str, parent: DataFrame, to: str) -> DataFrame:
    """(key, missing): child rows that point to no parent row."""
    left = child.filter(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("string").alias("missing"), folded_key(column).alias("_k"))
    return left.join(parent.select(folded_key(to).alias("_k")), "_k", "left_anti").select("key", "missing")


def broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): rows for which a rule is false; NULL passes. One pass for all rules."""
    found = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).alias("key"), F.explode(found).alias("rule"))


def report(rules: dict[str, Column], df: DataFrame, key: str, uniques: list[list[str]]) -> DataFrame:
    """(kind, rule, n): how many rows break each rule, and how many values of unique columns repeat."""
    checks = broken(df, key, rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit("check").alias("kind"), "rule", "n")
    parts = [repeated(df, cols).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique").alias("kind"), F.lit(", ".join(cols)).alias("rule"), "n") for cols in uniques]
    return reduce(DataFrame.unionAll, parts, checks).filter("n > 0")
