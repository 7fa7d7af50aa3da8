"""CSV, TSV, JSON and HTML."""

from __future__ import annotations

import html as escaping
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What an imported cell must look like to be a number, and the starts of a formula in a spreadsheet.
WHOLE = r"^-?(0|[1-9][0-9]{0,14})$"
FRACTION = r"^-?(0|[1-9][0-9]*)\.[0-9]+$"
FORMULA = r"^[=@\t\r]"
SIGNED = r"^[+-]"
NUMBER = r"^[+-]\s*([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def read_csv(spark: SparkSession, path: str, *, delimiter: str | None = None) -> DataFrame:
    """A CSV or TSV file with a header, all columns as text; quotes by RFC 4180, blank lines dropped.

    The delimiter is the tab if the header has more tabs than commas. Empty cells are NULL.
    """
    if delimiter is None:
        head = (spark.read.text(path).first() or [""])[0]
        delimiter = "\t" if head.count("\t") > head.count(",") else ","
    return spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def typed(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a plain number become BIGINT or DOUBLE, found in one pass; no dates are guessed."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return df
    cell = lambda c: F.trim(F.col(f"`{c}`"))
    tests = [F.every(cell(c).rlike(WHOLE) | (cell(c) == "")).alias(f"w{k}") for k, c in enumerate(texts)]
    tests += [F.every(cell(c).rlike(WHOLE) | (cell(c).rlike(FRACTION) & (F.length(cell(c)) <= 18)) | (cell(c) == "")).alias(f"f{k}") for k, c in enumerate(texts)]
    found = df.agg(*tests).first()
    kind = {c: "bigint" if found[f"w{k}"] else "double" if found[f"f{k}"] else None for k, c in enumerate(texts)}
    return df.select(*[cell(c).try_cast(kind[c]).alias(c) if kind.get(c) else F.col(f"`{c}`") for c in df.columns])


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects; columns are the union of their keys."""
    return spark.read.json(path, multiLine=True)


def from_table(spark: SparkSession, cols: list[str], rows: list[list]) -> DataFrame:
    """{cols, rows} as a DataFrame; short rows are filled with NULL, cells of mixed kinds are text."""
    wide = [tuple(r) + (None,) * (len(cols) - len(r)) for r in rows]
    kinds = []
    for k in range(len(cols)):
        held = {type(r[k]) for r in wide if r[k] is not None}
        kinds.append("bigint" if held == {int} else "double" if held and held <= {int, float} else "boolean" if held == {bool} else "string")
    cast = {"string": str, "double": float}
    data = [tuple(v if v is None or kinds[k] not in cast else cast[kinds[k]](v) for k, v in enumerate(r)) for r in wide]
    return spark.createDataFrame(data, ", ".join(f"`{c}` {kind}" for c, kind in zip(cols, kinds)))


def guarded(c: str | Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe; numbers stay as they are."""
    x = F.col(c) if isinstance(c, str) else c
    risky = x.rlike(FORMULA) | (x.rlike(SIGNED) & ~x.rlike(NUMBER) & (F.trim(F.substring(x, 2, 2**31 - 1)) != ""))
    return F.when(risky, F.concat(F.lit("'"), x)).otherwise(x)


def csv_rows(df: DataFrame) -> DataFrame:
    """The columns as a CSV file holds them: texts guarded, the rest as text."""
    return df.select(*[(guarded(F.col(f"`{c}`")) if kind.startswith("string") else F.col(f"`{c}`").cast("string")).alias(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    csv_rows(df).write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def html_table(df: DataFrame, note: str = "") -> Iterator[str]:
    """An HTML table, line by line; every value escaped, rows fetched a partition at a time."""
    if note:
        yield f"<!-- {note.replace('--', '—')} -->"
    yield "<table>"
    yield "<thead><tr>" + "".join(f"<th>{escaping.escape(c)}</th>" for c in df.columns) + "</tr></thead>"
    yield "<tbody>"
    for r in df.toLocalIterator():
        yield "<tr>" + "".join(f"<td>{escaping.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>"
    yield "</tbody>"
    yield "</table>"


def text_table(columns: list[str], rows: Iterable) -> str:
    """Rows as aligned text, for a terminal."""
    held = [columns, *([("NULL" if v is None else str(v)) for v in r] for r in rows)]
    width = [max(len(r[k]) for r in held) for k in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in held)
