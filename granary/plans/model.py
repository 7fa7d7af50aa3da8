"""Tables, their columns and rules, and the rows as a base with change segments over it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.base import ident, quote
from granary.operators.log import latest
from granary.plans.staging import staged
from granary.plans.types import Type

#: Pending segments that are merged into one, so that plans stay short.
SEGMENTS = 12


@dataclass
class Column:
    name: str
    type: Type
    not_null: bool = False
    default: str | None = None
    auto: bool = False
    on_update: bool = False
    comment: str = ""

    def sql(self) -> str:
        out = f"{ident(self.name)} {self.type.sql()}" + (" NOT NULL" if self.not_null else "")
        out += f" DEFAULT {self.default}" if self.default is not None else ""
        out += " ON UPDATE CURRENT_TIMESTAMP" if self.on_update else ""
        out += " AUTO_INCREMENT" if self.auto else ""
        return out + (f" COMMENT {quote(self.comment)}" if self.comment else "")


@dataclass
class Foreign:
    name: str
    columns: list[str]
    to: str
    to_columns: list[str]
    delete: str = "RESTRICT"
    update: str = "RESTRICT"

    def sql(self) -> str:
        names = lambda cs: ", ".join(map(ident, cs))
        out = f"CONSTRAINT {ident(self.name)} FOREIGN KEY ({names(self.columns)}) REFERENCES {ident(self.to)} ({names(self.to_columns)})"
        return out + "".join(f" ON {w} {a}" for w, a in (("DELETE", self.delete), ("UPDATE", self.update)) if a != "RESTRICT")


@dataclass
class Table:
    name: str
    columns: list[Column]
    key: str
    base: DataFrame
    uniques: list[tuple[str, list[str]]] = field(default_factory=list)
    indexes: list[tuple[str, list[str]]] = field(default_factory=list)
    foreigns: list[Foreign] = field(default_factory=list)
    checks: list[tuple[str, str]] = field(default_factory=list)
    segments: list[DataFrame] = field(default_factory=list)  # the table's columns, _deleted and _seq
    saved: list[DataFrame] = field(default_factory=list)  # segments that were committed
    seq: int = 0
    next_id: int = 1
    comment: str = ""
    open: bool = False
    writers: list[str] = field(default_factory=list)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def settle(self, base: DataFrame) -> None:
        """The table is what base holds, with no changes over it."""
        self.base, self.segments, self.saved = base, [], []

    def commit(self) -> bool:
        """Pending segments become saved ones, which are appended to, not written anew; many become the base."""
        if not self.segments:
            return False
        self.saved, self.segments = [*self.saved, *self.segments], []
        if len(self.saved) > SEGMENTS:
            self.settle(staged(self.rows(), self.name))
        return True

    def changes(self, saved: bool = False) -> DataFrame | None:
        """The last pending change of each key; with saved the committed ones count too."""
        held = [*self.saved, *self.segments] if saved else self.segments
        if not held:
            return None
        return latest(reduce(DataFrame.unionByName, held), folded_key(self.key), "_seq")

    def committed(self) -> DataFrame:
        return replace(self, segments=[]).rows()

    def rows(self) -> DataFrame:
        """The base with the saved and the pending changes over it."""
        changes = self.changes(saved=True)
        if changes is None:
            return self.base.select(*map(ident, self.names))
        k = folded_key(self.key)
        kept = self.base.withColumn("_k", k).join(changes.select(k.alias("_k")), "_k", "left_anti")
        return kept.select(*map(ident, self.names)).unionByName(changes.filter("NOT _deleted").select(*map(ident, self.names)))

    def copy(self) -> Table:
        return replace(self, columns=[replace(c) for c in self.columns], uniques=list(self.uniques), indexes=list(self.indexes), foreigns=list(self.foreigns), checks=list(self.checks), segments=list(self.segments), saved=list(self.saved), writers=list(self.writers))

    def sql(self) -> str:
        lines = [c.sql() for c in self.columns] + [f"PRIMARY KEY ({ident(self.key)})"]
        listed = lambda cs: ", ".join(map(ident, cs))
        lines += [f"UNIQUE KEY {ident(n)} ({listed(cs)})" for n, cs in self.uniques] + [f"KEY {ident(n)} ({listed(cs)})" for n, cs in self.indexes]
        lines += [f.sql() for f in self.foreigns] + [f"CONSTRAINT {ident(n)} CHECK ({t})" for n, t in self.checks]
        return f"CREATE TABLE {ident(self.name)} (\n  " + ",\n  ".join(lines) + "\n)" + (f" COMMENT={quote(self.comment)}" if self.comment else "")


def folded_key(name: str) -> SparkColumn:
    """A key's value as text without case and trailing spaces."""
    return F.lower(F.rtrim(F.col(ident(name)).cast("string")))
