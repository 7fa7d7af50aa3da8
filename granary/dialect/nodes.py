"""The tree of a statement."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Lit:
    kind: str  # string, number, null, bool, date, time, timestamp
    value: Any = None


@dataclass
class Col:
    name: str
    table: str | None = None


@dataclass
class Var:
    name: str
    system: bool = False


@dataclass
class Un:
    op: str
    arg: Any


@dataclass
class Bin:
    op: str
    left: Any
    right: Any


@dataclass
class Row:
    items: list


@dataclass
class Is:
    arg: Any
    what: str
    negated: bool


@dataclass
class Like:
    arg: Any
    pattern: Any
    negated: bool
    escape: Any = None
    regexp: bool = False


@dataclass
class In:
    arg: Any
    items: list | None
    query: Any
    negated: bool


@dataclass
class Between:
    arg: Any
    low: Any
    high: Any
    negated: bool


@dataclass
class Quantified:
    op: str
    arg: Any
    how: str  # any, all
    query: Any


@dataclass
class Exists:
    query: Any


@dataclass
class Sub:
    query: Any


@dataclass
class Case:
    arg: Any
    whens: list[tuple]
    other: Any


@dataclass
class Interval:
    amount: Any
    unit: str


@dataclass
class Cast:
    arg: Any
    type: str
    args: list[int] = field(default_factory=list)


@dataclass
class Call:
    name: str
    args: list
    distinct: bool = False
    star: bool = False
    order: list = field(default_factory=list)
    separator: str | None = None
    over: Any = None


@dataclass
class Over:
    partition: list
    order: list
    frame: tuple | None  # (unit, low, high) with None for unbounded, 0 for the current row, signed numbers else


@dataclass
class Order:
    expr: Any
    desc: bool


@dataclass
class Item:
    expr: Any  # None: star
    alias: str | None
    label: str
    star: str | None = None  # "" for *, a table for t.*


@dataclass
class Table:
    name: str
    alias: str | None


@dataclass
class Derived:
    query: Any
    alias: str | None
    columns: list[str] = field(default_factory=list)


@dataclass
class Join:
    left: Any
    right: Any
    kind: str  # inner, left, right, cross
    on: Any = None
    using: list[str] = field(default_factory=list)
    natural: bool = False


@dataclass
class Select:
    items: list[Item]
    source: Any
    where: Any = None
    group: list = field(default_factory=list)
    rollup: bool = False
    having: Any = None
    distinct: bool = False


@dataclass
class Values:
    rows: list[list]


@dataclass
class SetOp:
    op: str  # union, intersect, except
    all: bool
    left: Any
    right: Any


@dataclass
class Query:
    body: Any
    ctes: list[tuple] = field(default_factory=list)  # name, columns, query
    recursive: bool = False
    order: list[Order] = field(default_factory=list)
    limit: Any = None
    offset: Any = None


@dataclass
class Statement:
    kind: str
    text: str
    data: dict
