"""Declared column types: their Spark types, and how values are converted to them."""

from __future__ import annotations

from dataclasses import dataclass, field

from granary.dialect.lexer import DialectError
from granary.functions.base import X, date, datetime, micros, number, quote, text

# Ranges of whole numbers by type, and the words for true and false.
RANGES = {"TINYINT": 7, "SMALLINT": 15, "MEDIUMINT": 23, "INT": 31, "BIGINT": 63}
ALIASES = {
    "INT1": "TINYINT", "INT2": "SMALLINT", "INT3": "MEDIUMINT", "MIDDLEINT": "MEDIUMINT", "INT4": "INT", "INTEGER": "INT", "INT8": "BIGINT", "SERIAL": "BIGINT",
    "BOOL": "BOOLEAN", "BIT": "BOOLEAN", "DEC": "DECIMAL", "NUMERIC": "DECIMAL", "FIXED": "DECIMAL", "FLOAT4": "FLOAT", "REAL": "DOUBLE", "FLOAT8": "DOUBLE",
    "NCHAR": "CHAR", "BINARY": "CHAR", "NVARCHAR": "VARCHAR", "VARBINARY": "VARCHAR", "TINYBLOB": "TINYTEXT", "BLOB": "TEXT", "MEDIUMBLOB": "MEDIUMTEXT", "LONGBLOB": "LONGTEXT",
    "TIMESTAMP": "DATETIME",
}
TEXT_BYTES = {"TINYTEXT": 255, "TEXT": 65535, "MEDIUMTEXT": 16777215}
TRUE_WORDS = "1 true t yes y on x ✓"
FALSE_WORDS = "0 false f no n off"


@dataclass
class Type:
    name: str = "ANY"
    args: list[int] = field(default_factory=list)
    unsigned: bool = False
    values: list[str] = field(default_factory=list)

    @property
    def kind(self) -> str:
        if self.name in RANGES or self.name in ("YEAR",):
            return "int" if not (self.unsigned and self.name == "BIGINT") else "num"
        return {"DECIMAL": "num", "FLOAT": "num", "DOUBLE": "num", "BOOLEAN": "bool", "DATE": "date", "DATETIME": "dt", "TIME": "time"}.get(self.name, "str")

    @property
    def spark(self) -> str:
        if self.name in RANGES:
            if self.unsigned and self.name == "BIGINT":
                return "DECIMAL(20,0)"
            wide = {"TINYINT": "SMALLINT", "SMALLINT": "INT", "MEDIUMINT": "INT", "INT": "BIGINT"}
            return wide.get(self.name, "BIGINT") if self.unsigned else {"MEDIUMINT": "INT"}.get(self.name, self.name)
        if self.name == "DECIMAL":
            return f"DECIMAL({min(self.args[0] if self.args else 10, 38)},{self.args[1] if len(self.args) > 1 else 0})"
        return {"FLOAT": "FLOAT", "DOUBLE": "DOUBLE", "BOOLEAN": "BOOLEAN", "DATE": "DATE", "DATETIME": "TIMESTAMP_NTZ", "TIME": "BIGINT", "YEAR": "SMALLINT"}.get(self.name, "STRING")

    def sql(self) -> str:
        if self.values:
            return f"{self.name}({','.join(quote(v) for v in self.values)})"
        args = f"({','.join(map(str, self.args))})" if self.args else ""
        return f"{self.name}{args}{' UNSIGNED' if self.unsigned else ''}"

    def coerce(self, x: X) -> str:
        """The value as this type; NULL where it can't be one."""
        if x.kind == "null":
            return f"CAST(NULL AS {self.spark})"
        if self.name in RANGES:
            bits = RANGES[self.name] + self.unsigned
            low, high = (0, 2**bits - 1) if self.unsigned else (-(2**bits), 2**bits - 1)
            held = f"round(try_cast({strict(x)} AS DECIMAL(38, 10)))"
            return f"CAST(IF({held} BETWEEN {low} AND {high}, {held}, NULL) AS {self.spark})"
        if self.name == "BOOLEAN":
            word = f"lower(trim({text(x)}))"
            return f"CASE WHEN {word} IN ({', '.join(map(quote, TRUE_WORDS.split()))}) THEN true WHEN {word} IN ({', '.join(map(quote, FALSE_WORDS.split()))}) THEN false END"
        if self.name == "DECIMAL":
            return f"try_cast(round(try_cast({strict(x)} AS DECIMAL(38, 18)), {self.args[1] if len(self.args) > 1 else 0}) AS {self.spark})"
        if self.name in ("FLOAT", "DOUBLE"):
            held = f"try_cast({strict(x)} AS {self.spark})"
            return f"IF(isnan({held}) OR abs({held}) = double('Infinity'), NULL, {held})"
        if self.name in ("CHAR", "VARCHAR") and self.args:
            return f"IF(char_length({text(x)}) <= {self.args[0]}, {text(x)}, NULL)"
        if self.name in TEXT_BYTES:
            return f"IF(octet_length({text(x)}) <= {TEXT_BYTES[self.name]}, {text(x)}, NULL)"
        if self.name == "DATE":
            return date(x) if x.kind != "str" else tolerant_date(x.sql)
        if self.name == "DATETIME":
            held = datetime(x) if x.kind != "str" else f"coalesce(try_cast({x.sql} AS TIMESTAMP_NTZ), CAST({tolerant_date(x.sql)} AS TIMESTAMP_NTZ))"
            digits = self.args[0] if self.args else 0
            return f"timestampadd(MICROSECOND, -CAST(date_format({held}, 'SSSSSS') AS INT) % {10 ** (6 - digits)}, {held})"
        if self.name == "TIME":
            return micros(x)
        if self.name == "YEAR":
            held = f"try_cast({number(x)} AS INT)"
            return f"CAST(CASE WHEN {held} BETWEEN 0 AND 69 THEN 2000 + {held} WHEN {held} BETWEEN 70 AND 99 THEN 1900 + {held} WHEN {held} BETWEEN 1901 AND 2155 THEN {held} END AS SMALLINT)"
        if self.name == "JSON":
            return f"to_json(try_parse_json({text(x)}))"
        if self.name == "ENUM":
            return "CASE " + " ".join(f"WHEN lower(trim({text(x)})) = {quote(v.lower())} THEN {quote(v)}" for v in self.values) + " END"
        if self.name == "SET":
            parts = f"transform(split(lower({text(x)}), ','), z -> trim(z))"
            known = f"array({', '.join(quote(v) for v in self.values)})"
            return f"CASE WHEN {text(x)} = '' THEN '' WHEN size(array_except({parts}, transform({known}, z -> lower(z)))) = 0 THEN array_join(filter({known}, z -> array_contains({parts}, lower(z))), ',') END"
        return text(x)

    def problem(self, column: str) -> str:
        """What is wrong with a value that coerce() made NULL."""
        if self.name in RANGES:
            return f"{column}: no whole number of its range"
        what = {"DECIMAL": "a number", "FLOAT": "a number", "DOUBLE": "a number", "BOOLEAN": "yes or no", "DATE": "a date", "DATETIME": "a date and time", "TIME": "a time", "YEAR": "a year", "JSON": "JSON", "ENUM": "a listed value", "SET": "a list of the choices"}
        return f"{column}: it isn't {what[self.name]}" if self.name in what else f"{column}: it is too long"


def strict(x: X) -> str:
    """A number's text without currency sign and thousands separators; alphabetic characters but e make it none."""
    if x.kind != "str":
        return number(x)
    held = f"replace(replace(trim({x.sql}), ',', ''), '$', '')"
    return f"IF({held} RLIKE '^[+-]?([0-9]+\\\\.?[0-9]*|\\\\.[0-9]+)([eE][+-]?[0-9]+)?$', {held}, NULL)"


def tolerant_date(sql: str) -> str:
    """ISO, month/day/year, day.month.year, eight digits, and English month names."""
    forms = ["M/d/yyyy", "d.M.yyyy", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy"]
    tries = "".join(f", CAST(try_to_timestamp({sql}, {quote(f)}) AS DATE)" for f in forms)
    return f"coalesce(IF({sql} RLIKE '^[0-9]{{8}}$', NULL, try_cast({sql} AS DATE)){tries})"


def make(name: str, args: list, unsigned: bool, values: list[str]) -> Type:
    name = ALIASES.get(name.upper(), name.upper())
    if name == "TINYINT" and args == [1]:
        return Type("BOOLEAN")
    if name in RANGES:
        return Type(name, [], unsigned)
    if name in ("ENUM", "SET"):
        return Type(name, [], False, values)
    known = ["ANY", "BOOLEAN", "DECIMAL", "FLOAT", "DOUBLE", "CHAR", "VARCHAR", "TEXT", "DATE", "DATETIME", "TIME", "YEAR", "JSON", "LONGTEXT", *TEXT_BYTES]
    if name not in known:
        raise DialectError(f"There is no type {name}")
    if name == "DECIMAL" and args and args[0] > 65:
        raise DialectError("DECIMAL has 65 digits at most")
    return Type(name, args if name in ("DECIMAL", "CHAR", "VARCHAR", "DATETIME", "TIME") else [])


def of_spark(kind: str) -> str:
    """The kind of a Spark type's simple name."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if kind.startswith("decimal") or kind in ("double", "float"):
        return "num"
    return {"boolean": "bool", "date": "date", "timestamp": "dt", "timestamp_ntz": "dt", "void": "null"}.get(kind, "str" if kind.startswith("string") else "any")
