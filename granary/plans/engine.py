"""The engine: runs scripts of the dialect over tables that are DataFrames with rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.dialect import nodes as n
from granary.dialect.emit import Emitter, Scope, unique
from granary.dialect.lexer import DialectError
from granary.functions.base import X, ident, quote
from granary.plans.changes import Changes
from granary.plans.model import Column, Foreign, Table
from granary.plans.schema import SchemaStatements
from granary.plans.show import ShowStatements
from granary.plans.statements import parse_script
from granary.plans.staging import Parts, numbered, staged
from granary.plans.types import Type, of_spark

ROUNDS, ROUND_ROWS = 1000, 200_000
#: Statements that can be taken back.
UNDO_MOST = 100
READING = {"query", "show", "explain", "set", "use", "idle", "begin"}


class Engine(SchemaStatements, ShowStatements):
    """One database: tables, views, variables and pending changes, in a Spark session of its own.

    The session has its own settings: no ANSI errors (x / 0 is NULL), UTC, recursion to 1000 levels.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        for key, value in {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.cteRecursionLevelLimit": str(ROUNDS), "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}.items():
            self.spark.conf.set(key, value)
        self.tables: dict[str, Table] = {}
        self.views: dict[str, tuple[str, str, list[str]]] = {}
        self.attached: dict[str, tuple[str, DataFrame, str | None]] = {}
        self.variables: dict[str, X] = {}
        self.system: dict[str, X] = {"FOREIGN_KEY_CHECKS": X("1", "int", "1"), "AUTOCOMMIT": X("1", "int", "1")}
        self.last_id, self.row_count, self.name, self.temp = 0, 0, "main", 0
        self.past: list[tuple[dict, dict]] = []
        self.future: list[tuple[dict, dict]] = []

    # the catalog, as the emitter asks for it
    def attach(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """Make a DataFrame readable as a table. Only its plan is kept; key is the column that orders its rows."""
        view = self.temp_view(df, name)
        self.attached[name.lower()] = (view, self.spark.table(view), key)

    def attach_folder(self, folder: str, names: Sequence[str]) -> None:
        for name in names:
            self.attach(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))

    def temp_view(self, df: DataFrame, stem: str) -> str:
        self.temp += 1
        view = f"_{re.sub(r'[^0-9a-zA-Z]', '_', stem)}_{self.temp}"
        if df.sparkSession._jsparkSession == self.spark._jsparkSession:
            df.createOrReplaceTempView(view)
            return view
        view += f"_{id(self):x}"  # a frame of another session is seen through a global view
        df.createOrReplaceGlobalTempView(view)
        return f"global_temp.{view}"

    def relation(self, name: str):
        if (t := self.tables.get(name.lower())) is not None:
            view = self.temp_view(t.rows(), t.name)
            return view, [(c.name, c.type.kind) for c in t.columns], t.key
        if (held := self.attached.get(name.lower())) is not None:
            view, df, key = held
            return view, [(c, of_spark(kind)) for c, kind in df.dtypes], key
        return None

    def view(self, name: str):
        held = self.views.get(name.lower())
        return held[1:] if held else None

    def variable(self, name: str, system: bool) -> X:
        if system:
            return self.system.get(name.upper(), X("NULL", "null"))
        return self.variables.get(name.lower(), X("NULL", "null"))

    def info(self, name: str) -> X | None:
        known = {
            "DATABASE": X(quote(self.name), "str"), "SCHEMA": X(quote(self.name), "str"), "VERSION": X("'8.0.0-granary'", "str"), "CONNECTION_ID": X("1", "int"),
            "USER": X("'owner@local'", "str"), "CURRENT_USER": X("'owner@local'", "str"), "SESSION_USER": X("'owner@local'", "str"), "SYSTEM_USER": X("'owner@local'", "str"),
            "LAST_INSERT_ID": X(str(self.last_id), "int"), "ROW_COUNT": X(str(self.row_count), "int"), "FOUND_ROWS": X("0", "int"),
        }
        return known.get(name)

    def recursive_distinct(self, name: str, columns: list[str], anchor: str, step: Callable[[str], str]) -> str:
        """WITH RECURSIVE … UNION: rounds over the rows that are new, until there are none.

        A round's rows are a part of one staged table, so that plans don't grow with the rounds.
        """
        held = Parts(self.spark, "recursion")
        fresh = held.add(self.spark.sql(anchor).distinct())
        fields, total = fresh.schema.fields, fresh.count()
        for _ in range(ROUNDS):
            found = self.spark.sql(step(self.temp_view(fresh, name))).distinct()
            typed, seen = found.select(*[found[i].cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]), held.all()
            fresh = held.add(typed.join(seen, [typed[c].eqNullSafe(seen[c]) for c in columns], "left_anti"))
            more = fresh.count()
            if not more:
                return self.temp_view(held.all(), name)
            total += more
            if total > ROUND_ROWS:
                raise DialectError(f"A recursive query has over {ROUND_ROWS} rows")
        raise DialectError(f"A recursive query takes over {ROUNDS} rounds")

    # running
    def run(self, script: str, import_mode: bool = False) -> list[DataFrame | str]:
        """The results of a script's statements: a DataFrame of each query, else a message. The first error ends it."""
        statements = parse_script(script)
        if import_mode:
            statements = hoisted(statements)
        out = []
        for s in statements:
            try:
                out.append(self.execute(s))
            except DialectError as e:
                raise DialectError(f"{e}" if len(statements) == 1 else f"Statement {len(out) + 1}: {e}") from e
        return out

    def sql(self, script: str) -> DataFrame:
        """The result of a script's last statement; a message is a row of one column."""
        out = self.run(script)[-1]
        return out if isinstance(out, DataFrame) else self.spark.createDataFrame([(out,)], "message string")

    def translate(self, sql: str) -> str:
        """The Spark SQL of one query."""
        return Emitter(self).query(parse_script(sql)[0].data["query"], top=True).sql

    def frame(self, q: n.Query, top: bool = True) -> DataFrame:
        held = Emitter(self).query(q, top=top)
        labels = unique([c for c, _ in held.columns])
        return self.spark.sql(held.sql).toDF(*labels)

    def scalar(self, e) -> tuple:
        x = Emitter(self).expr(e, Scope([], None))
        return x, self.spark.sql(f"SELECT {x.sql} AS v").first()[0]

    def state(self) -> tuple[dict, dict]:
        return {k: t.copy() for k, t in self.tables.items()}, dict(self.views)

    def undo(self) -> bool:
        """Take the last change back; tables are immutable frames, so a state is a list of plans."""
        if not self.past:
            return False
        self.future.append(self.state())
        self.tables, self.views = self.past.pop()
        return True

    def redo(self) -> bool:
        if not self.future:
            return False
        self.past.append(self.state())
        self.tables, self.views = self.future.pop()
        return True

    def execute(self, s: n.Statement) -> DataFrame | str:
        if s.kind in READING:
            return self.perform(s)
        before = self.state()
        out = self.perform(s)
        self.past, self.future = [*self.past, before][-UNDO_MOST:], []
        return out

    def perform(self, s: n.Statement) -> DataFrame | str:
        return getattr(self, f"do_{s.kind}")(**s.data) if s.kind != "create_view" else self.do_create_view(s.data)

    def do_query(self, query: n.Query) -> DataFrame:
        return self.frame(query)

    def do_idle(self, word: str) -> str:
        return f"{word}: nothing to do"

    def do_use(self, name: str) -> str:
        self.name = name
        return f"Using {name}"

    def do_set(self, pairs: list) -> str:
        for name, system, e in pairs:
            x, value = self.scalar(e)
            held = X("NULL", "null") if value is None else X(quote(value), "str", value) if isinstance(value, str) else X(f"{int(value)}" if isinstance(value, bool) else f"{value}", x.kind if x.kind != "bool" else "int", str(value))
            if x.kind in ("date", "dt", "time") and value is not None:
                held = X(x.sql, x.kind)
            (self.system if system else self.variables)[name.upper() if system else name.lower()] = held
        return "Set"

    def table(self, name: str, writing: bool = False) -> Table:
        if (t := self.tables.get(name.lower())) is not None:
            return t
        if name.lower() in self.views:
            raise DialectError(f"{name} is a view" + ("; change the table it reads" if writing else ""))
        if name.lower() in self.attached:
            raise DialectError(f"{name} is attached for reading")
        raise DialectError(f"No table is named {name!r}")

    def checks_keys(self) -> bool:
        return self.system["FOREIGN_KEY_CHECKS"].value not in ("0", "OFF", "off")

    # rows
    def do_insert(self, **data) -> str:
        return Changes(self).insert(**data)

    def do_update(self, **data) -> str:
        return Changes(self).update(**data)

    def do_delete(self, **data) -> str:
        return Changes(self).delete(**data)

    def do_begin(self) -> str:
        return "Changes stay pending until COMMIT"

    def do_commit(self) -> str:
        """Pending segments are kept; a table is written anew only when it has many of them."""
        changed = sum(t.commit() for t in self.tables.values())
        return f"Saved {changed} table{'s' * (changed != 1)}"

    def do_rollback(self) -> str:
        """Pending rows go; the structure stays."""
        for t in self.tables.values():
            t.segments = []
        return "Pending rows dropped"

    def pending(self, table: str) -> DataFrame:
        """Pending changes of a table with their state: New, Changed or Deleted."""
        t = self.table(table)
        changes = t.changes()
        if changes is None:
            return self.spark.createDataFrame([], t.base.select(*map(ident, t.names)).schema).withColumn("state", F.lit(""))
        old = t.committed().select(F.lower(F.rtrim(F.col(ident(t.key)).cast("string"))).alias("_k"), F.lit(True).alias("_was"))
        held = changes.withColumn("_k", F.lower(F.rtrim(F.col(ident(t.key)).cast("string")))).join(old, "_k", "left")
        state = F.when(F.col("_deleted"), "Deleted").when(F.col("_was"), "Changed").otherwise("New")
        return held.filter("NOT _deleted OR _was").withColumn("state", state).select(*map(ident, t.names), "state")

    def write(self, name: str, df: DataFrame, key: str | None = None) -> str:
        """Bring a DataFrame in, as an import does: rows replace those of their key, unknown columns are left out.

        A new table takes the frame's columns; the key is the one named, else the first column if its values are
        unique and none is null, else an automatic id.
        """
        df = staged(self.spark.table(self.temp_view(df, name)), name)
        t = self.tables.get(name.lower())
        if t is None:
            first = key or df.columns[0]
            rows, distinct, filled = df.agg(F.count(F.lit(1)), F.countDistinct(F.lower(F.rtrim(F.col(ident(first)).cast("string")))), F.count(F.col(ident(first)))).first()
            columns = [Column(c, spark_type(kind)) for c, kind in df.dtypes]
            if rows == distinct == filled and rows:
                self.tables[name.lower()] = Table(name, columns, first, df)
            else:
                self.tables[name.lower()] = Table(name, [Column("id", Type("BIGINT"), True, auto=True), *columns], "id", staged(numbered(df, "id"), name), next_id=rows + 1)
            return f"{name}: {rows} rows"
        known = [c for c in df.columns if t.column(c)]
        ignored = [c for c in df.columns if not t.column(c)]
        view = self.temp_view(df, "import")
        self.attached["__import"] = (view, self.spark.table(view), None)
        update = [(n.Col(c), n.Call("VALUES", [n.Col(c)])) for c in known if c.lower() != t.key.lower()]
        select = n.Query(n.Select([n.Item(n.Col(c), None, c) for c in known], n.Table("__import", None)))
        out = Changes(self).insert(table=name, ignore=False, replace=False, columns=known, rows=None, query=select, update=update)
        return out + (f"; left out: {', '.join(ignored)}" if ignored else "")

    def save(self) -> str:
        return self.do_commit()


def spark_type(kind: str) -> Type:
    if kind.startswith("decimal"):
        p, s = re.findall(r"\d+", kind)
        return Type("DECIMAL", [int(p), int(s)])
    return Type({"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME"}.get(kind, "LONGTEXT"), [6] if kind.startswith("timestamp") else [])


def hoisted(statements: list[n.Statement]) -> list[n.Statement]:
    """A dump's late ADD PRIMARY KEY goes into its CREATE TABLE, so that no automatic id is made."""
    created = {s.data["table"].lower(): s for s in statements if s.kind == "create_table" and not s.data["query"] and not s.data["like"]}
    out = []
    for s in statements:
        if s.kind == "alter" and (home := created.get(s.data["table"].lower())):
            keys = [a for a in s.data["actions"] if a[0] == "add_primary"]
            home.data["rules"].extend(("primary", a[1]) for a in keys)
            rest = [a for a in s.data["actions"] if a[0] != "add_primary"]
            if not rest:
                continue
            s = n.Statement(s.kind, s.text, s.data | {"actions": rest})
        out.append(s)
    return out


__all__ = ["Engine", "Foreign", "hoisted"]
