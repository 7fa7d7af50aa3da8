"""Emitted expressions: Spark SQL text with a kind, and conversions between kinds."""

from __future__ import annotations

import re
from typing import NamedTuple

from granary.dialect.lexer import DialectError

COLLATION = "UTF8_LCASE_RTRIM"
NUMBER = r"^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


class X(NamedTuple):
    """kind: bool, int, num, str, date, dt, time, null or any."""

    sql: str
    kind: str = "any"
    value: object = None  # of a literal


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(x: X) -> str:
    if x.kind in ("str", "null"):
        return x.sql
    if x.kind == "bool":
        return f"CAST(CAST({x.sql} AS INT) AS STRING)"
    if x.kind == "time":
        return time_text(x.sql)
    return f"CAST({x.sql} AS STRING)"


def number(x: X) -> str:
    """Lenient: of a text its leading number, else 0."""
    if x.kind == "bool":
        return f"CAST({x.sql} AS INT)"
    if x.kind == "str":
        if isinstance(x.value, str):
            m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", x.value)
            return m[1].lstrip("+") if m else "0"
        return f"IF({x.sql} IS NULL, NULL, coalesce(try_cast(regexp_extract(trim({x.sql}), '{NUMBER}', 0) AS DOUBLE), 0D))"
    if x.kind == "time":
        return f"({x.sql} / 1000000)"
    if x.kind == "date":
        return f"CAST(date_format({x.sql}, 'yyyyMMdd') AS BIGINT)"
    if x.kind == "dt":
        return f"CAST(date_format({x.sql}, 'yyyyMMddHHmmss') AS BIGINT)"
    return x.sql


def whole(x: X) -> str:
    """A number rounded half away from zero to a whole one."""
    return x.sql if x.kind == "int" else f"CAST({x.sql} AS INT)" if x.kind == "bool" else f"CAST(round({number(x)}) AS BIGINT)"


def small(x: X) -> str:
    return x.sql if x.kind == "int" and x.value is not None else f"CAST({whole(x)} AS INT)"


def condition(x: X) -> str:
    if x.kind in ("bool", "null"):
        return x.sql
    return f"({number(x)} <> 0)"


DATE_ONLY = re.compile(r"\s*\d{4}-\d{1,2}-\d{1,2}\s*$")


def moment(x: X) -> X:
    """A date or date-time; of a text by its form, if it is a literal, else as a date-time."""
    if x.kind in ("date", "dt"):
        return x
    if x.kind == "str" and isinstance(x.value, str) and DATE_ONLY.match(x.value):
        return X(f"try_cast({x.sql} AS DATE)", "date")
    return X(f"try_cast({x.sql} AS TIMESTAMP_NTZ)", "dt")


def date(x: X) -> str:
    return x.sql if x.kind == "date" else f"try_cast({x.sql} AS DATE)"


def datetime(x: X) -> str:
    return x.sql if x.kind == "dt" else f"try_cast({x.sql} AS TIMESTAMP_NTZ)"


def time_text(micros: str) -> str:
    m = f"({micros})"
    whole = f"format_string('%02d:%02d:%02d', abs({m}) DIV 3600000000, (abs({m}) DIV 60000000) % 60, (abs({m}) DIV 1000000) % 60)"
    return f"concat(IF({m} < 0, '-', ''), {whole}, IF({m} % 1000000 = 0, '', format_string('.%06d', abs({m}) % 1000000)))"


#: A time in a text: sign, hours, minutes, seconds and their fraction, after a date or alone.
CLOCK = "^ *(-?)(?:[0-9-]+[ T])?([0-9]+):([0-5]?[0-9])(?::([0-5]?[0-9])(?:[.]([0-9]{1,6})[0-9]*)?)? *$"


def time_of(moment: str) -> str:
    return f"pmod(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {moment}), 86400000000L)"


def micros(x: X) -> str:
    """A time of day or a duration, as microseconds; NULL for a text that is neither a time nor a date."""
    if x.kind == "time":
        return x.sql
    if x.kind == "dt":
        return time_of(x.sql)
    if x.kind == "date":
        return f"IF({x.sql} IS NULL, NULL, 0L)"
    if x.kind in ("int", "num"):
        n = f"CAST({x.sql} AS BIGINT)"
        return f"((({n} DIV 10000) * 3600 + (({n} DIV 100) % 100) * 60 + {n} % 100) * 1000000L)"
    group = lambda k: f"regexp_extract({x.sql}, '{CLOCK}', {k})"
    part = lambda k: f"coalesce(try_cast({group(k)} AS BIGINT), 0)"
    sums = f"IF({group(1)} = '-', -1, 1) * (({part(2)} * 3600 + {part(3)} * 60 + {part(4)}) * 1000000L + CAST(rpad({group(5)}, 6, '0') AS BIGINT))"
    return f"(CASE WHEN {x.sql} RLIKE '{CLOCK}' THEN {sums} ELSE {time_of(f'try_cast({x.sql} AS TIMESTAMP_NTZ)')} END)"


def seconds(x: X) -> str:
    """The same cut to whole seconds, still in microseconds."""
    m = micros(x)
    return f"({m} - {m} % 1000000)"


def folded(x: X) -> str:
    """As a key: texts that differ only in case or trailing spaces are equal."""
    return f"collate({x.sql}, '{COLLATION}')" if x.kind == "str" else x.sql


def comparable(a: X, b: X) -> tuple[str, str]:
    kinds = {a.kind, b.kind}
    if kinds <= {"str", "null", "any"} and "str" in kinds:
        return (folded(a), b.sql) if a.kind == "str" else (a.sql, folded(b))
    if "str" in kinds and kinds & {"int", "num", "bool"}:
        return number(a), number(b)
    if "time" in kinds and kinds & {"str", "time"}:
        return micros(a), micros(b)
    if "dt" in kinds and kinds & {"str", "date"}:
        return datetime(a), datetime(b)
    if kinds == {"str", "date"}:
        one = a if a.kind == "str" else b
        if isinstance(one.value, str) and not DATE_ONLY.match(one.value):
            return datetime(a), datetime(b)
        return date(a), date(b)
    if "bool" in kinds and kinds & {"int", "num"}:
        return number(a), number(b)
    return a.sql, b.sql


def merged(kinds: list[str]) -> str:
    """The kind of a value that is one of several."""
    held = {k for k in kinds if k != "null"}
    if not held:
        return "null"
    if len(held) == 1:
        return held.pop()
    if held <= {"int", "bool"}:
        return "int"
    if held <= {"int", "num", "bool"}:
        return "num"
    if held <= {"date", "dt"}:
        return "dt"
    return "str"


def united(items: list[X], kind: str | None = None) -> list[str]:
    """Values of a CASE, COALESCE and the like, converted to one kind."""
    kind = kind or merged([x.kind for x in items])
    return [text(x) if kind == "str" else number(x) if kind in ("int", "num") and x.kind == "bool" else x.sql for x in items]


def refuse(why: str):
    raise DialectError(why)
