"""INSERT, REPLACE, UPDATE and DELETE: change rows, checked as a whole before any is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.dialect import nodes as n
from granary.dialect.emit import Emitter, Scope, Source, replaced
from granary.dialect.lexer import DialectError
from granary.dialect.parser import parse_expr
from granary.functions.base import X, condition, ident, merged, quote, united
from granary.plans.model import SEGMENTS, Foreign, Table, folded_key
from granary.plans.staging import numbered, staged
from granary.plans.types import of_spark


class Changes:
    """The changes of one statement, over any number of tables."""

    def __init__(self, engine):
        self.engine, self.spark = engine, engine.spark
        self.after: dict[str, Table] = {}  # tables as the statement would leave them
        self.notes: list[str] = []

    def table(self, name: str) -> Table:
        key = name.lower()
        if key not in self.after:
            self.after[key] = self.engine.table(name, writing=True).copy()
        return self.after[key]

    def keep(self) -> None:
        self.engine.tables.update(self.after)

    def put(self, t: Table, rows: DataFrame, deleted: bool = False) -> int:
        """Add a segment: rows of the table's columns, or for deletions of its key at least."""
        have = {c.lower() for c in rows.columns}
        cols = [F.col(ident(c.name)) if c.name.lower() in have else F.lit(None).cast(c.type.spark).alias(c.name) for c in t.columns]
        t.seq += 1
        held = staged(rows.select(*cols, F.lit(deleted).alias("_deleted"), F.lit(t.seq).cast("bigint").alias("_seq")), t.name)
        count = held.count()
        if count:
            t.segments.append(held)
            if len(t.segments) > SEGMENTS:
                t.segments = [staged(t.changes().withColumn("_seq", F.lit(t.seq).cast("bigint")), t.name)]
        return count

    # values
    def expr(self, text: str) -> str:
        return Emitter(self.engine).expr(parse_expr(text), Scope([], None)).sql

    def typed(self, t: Table, rows: DataFrame, given: list[str], kinds: dict[str, str]) -> DataFrame:
        """Rows with every column of t in its type; values that can't be are an error."""
        view = self.engine.temp_view(rows, "given")
        items, wrong = [], []
        for c in t.columns:
            if c.name.lower() in given:
                raw = X(f"`_v_{c.name}`", kinds[c.name.lower()])
                held = c.type.coerce(raw)
                if raw.kind != "null":
                    wrong.append(f"IF({raw.sql} IS NOT NULL AND ({held}) IS NULL, {quote(c.type.problem(c.name))}, NULL)")
                if f"_d_{c.name}" in rows.columns:
                    held = f"IF(`_d_{c.name}`, {self.default(c)}, {held})"
            else:
                held = self.default(c)
            items.append(f"CAST({held} AS {c.type.spark}) AS {ident(c.name)}")
        problem = f"coalesce({', '.join(wrong)}, NULL)" if wrong else "CAST(NULL AS STRING)"
        extra = [ident(c) for c in rows.columns if c.startswith("_") and c[:3] not in ("_v_", "_d_")]
        out = staged(self.spark.sql(f"SELECT {', '.join(items + extra + [f'{problem} AS _problem'])} FROM {view}"), "typed")
        if bad := out.filter("_problem IS NOT NULL").select("_problem").first():
            raise DialectError(bad[0])
        return out.drop("_problem")

    def default(self, c) -> str:
        if c.default is None or c.default.upper() == "NULL":
            return f"CAST(NULL AS {c.type.spark})"
        x = Emitter(self.engine).expr(parse_expr(c.default), Scope([], None))
        return c.type.coerce(x)

    # rules
    def check_rows(self, t: Table, rows: DataFrame) -> DataFrame:
        """Rows with _problem: what rule a row breaks by itself."""
        emitter = Emitter(self.engine)
        scope = Scope([Source("_r", [(c.name, c.type.kind) for c in t.columns])], None)
        tests = [(f"`_r`.{ident(c.name)} IS NULL", f"{c.name} needs a value") for c in t.columns if c.not_null or c.name.lower() == t.key.lower()]
        tests += [(f"NOT coalesce({condition(emitter.expr(parse_expr(text), scope))}, true)", f"{name} fails the check {text}") for name, text in t.checks]
        problem = "CASE " + " ".join(f"WHEN {test} THEN {quote(why)}" for test, why in tests) + " END"
        view = self.engine.temp_view(rows, "rows")
        return self.spark.sql(f"SELECT *, {problem} AS _problem FROM {view} AS `_r`")

    def refuse_broken(self, t: Table, rows: DataFrame) -> None:
        if bad := self.check_rows(t, rows).filter("_problem IS NOT NULL").select("_problem").first():
            raise DialectError(bad[0])

    def refuse_repeated(self, t: Table) -> None:
        """Keys and unique columns of the table as it would be."""
        rows = t.rows()
        for what, cols in [("is taken", [t.key]), *((f"{n} has a value twice", c) for n, c in t.uniques)]:
            keys = [folded_key(c) for c in cols]
            filled = rows.filter(reduce(lambda a, b: a & b, [F.col(ident(c)).isNotNull() for c in cols]))
            if bad := filled.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).count().filter("count > 1").first():
                raise DialectError(f"{', '.join(map(str, bad[:-1]))} {what}")

    def refuse_orphans(self, t: Table, rows: DataFrame | None = None) -> None:
        if not self.engine.checks_keys():
            return
        for f in t.foreigns:
            if bad := self.orphans(t, f, rows).first():
                raise DialectError(f"{', '.join(map(str, bad))} has no match in {f.to}")

    def orphans(self, t: Table, f: Foreign, rows: DataFrame | None = None) -> DataFrame:
        """Values of a foreign key that the table it points to hasn't got."""
        parent = self.after.get(f.to.lower()) or self.engine.table(f.to)
        child = (rows if rows is not None else t.rows()).filter(reduce(lambda a, b: a & b, [F.col(ident(c)).isNotNull() for c in f.columns]))
        left = child.select(*[F.col(ident(c)).cast("string").alias(f"v{i}") for i, c in enumerate(f.columns)], *[folded_key(c).alias(f"k{i}") for i, c in enumerate(f.columns)])
        right = parent.rows().select(*[folded_key(c).alias(f"k{i}") for i, c in enumerate(f.to_columns)])
        return left.join(right, [f"k{i}" for i in range(len(f.columns))], "left_anti").select(*[f"v{i}" for i in range(len(f.columns))])

    # INSERT and REPLACE
    def insert(self, table: str, ignore: bool, replace: bool, columns, rows, query, update) -> str:
        t = self.table(table)
        names = [c.lower() for c in (columns if columns is not None and (columns or rows != [[]]) else t.names)]
        for c in names:
            if t.column(c) is None:
                raise DialectError(f"Unknown column {c!r} in {table}")
        given, kinds = self.incoming(t, names, rows, query)
        typed = self.typed(t, given, [c for c in names if f"_v_{t.column(c).name}" in given.columns], kinds)
        first_id = None
        if auto := next((c for c in t.columns if c.auto), None):
            typed, first_id = self.numbered(t, auto.name, typed)
        if ignore:
            typed = self.check_rows(t, typed).filter("_problem IS NULL").drop("_problem")
        elif not update:
            self.refuse_broken(t, typed)
        typed = staged(typed, "insert")
        total = self.insert_rounds(t, typed, ignore, replace, update)
        self.refuse_orphans(t, None if update else typed)
        self.keep()
        if first_id is not None:
            self.engine.last_id = first_id
        self.engine.row_count = total
        return f"{total} row{'s' * (total != 1)} inserted or replaced" if replace or update else f"{total} row{'s' * (total != 1)} inserted"

    def incoming(self, t: Table, names: list[str], rows, query) -> tuple[DataFrame, dict[str, str]]:
        """The given values as _v_column, _d_column where DEFAULT stands for some, and their order _ord."""
        if query is not None:
            held = Emitter(self.engine).query(query)
            if len(held.columns) != len(names):
                raise DialectError(f"{len(names)} columns are named, but the query has {len(held.columns)}")
            df = self.spark.sql(held.sql).toDF(*[f"_v_{t.column(c).name}" for c in names])
            return df.withColumn("_ord", F.monotonically_increasing_id()), {c: of_spark(k) for c, (_, k) in zip(names, df.dtypes)}
        emitter, scope = Emitter(self.engine), Scope([], None)
        lines, kinds = [], {c: [] for c in names}
        for k, row in enumerate(rows):
            if len(row) != len(names) and row:
                raise DialectError(f"{len(names)} columns are named, but row {k + 1} has {len(row)} values")
            line = []
            for c, e in zip(names, row):
                default = isinstance(e, n.Call) and e.name == "DEFAULT" and not e.args
                x = X("NULL", "null") if default else emitter.expr(e, scope)
                kinds[c].append(x)
                line.append((x, default))
            lines.append(line)
        found = {c: merged([x.kind for x in xs]) for c, xs in kinds.items()}
        defaulted = [c for i, c in enumerate(names) if any(line and line[i][1] for line in lines)]
        heads = [f"_v_{t.column(c).name}" for c in names if lines[0]] + [f"_d_{t.column(c).name}" for c in defaulted] + ["_ord"]
        texts = []
        for k, line in enumerate(lines):
            values = [united([x], found[c])[0] for c, (x, _) in zip(names, line)] + [str(line[names.index(c)][1]).lower() for c in defaulted] + [f"{k}L"]
            texts.append(f"({', '.join(values)})")
        return self.spark.sql(f"SELECT * FROM VALUES {', '.join(texts)} AS v({', '.join(map(ident, heads))})"), found

    def numbered(self, t: Table, name: str, rows: DataFrame) -> tuple[DataFrame, int | None]:
        """Numbers for rows without one, after the largest that is or was there."""
        col = F.col(ident(name))
        empty = col.isNull() | (col == 0)
        top = max(t.next_id - 1, t.rows().agg(F.max(col)).first()[0] or 0, rows.agg(F.max(col)).first()[0] or 0)
        kind = t.column(name).type.spark
        split = rows.withColumn("_new", empty)
        fresh = numbered(split.filter("_new").drop(name), name, top + 1, "_ord")
        both = split.filter("NOT _new").unionByName(fresh)
        out = staged(both.select(*[F.col(ident(c)).cast(kind) if c.lower() == name.lower() else F.col(ident(c)) for c in split.columns]), "numbered")
        low, high = out.agg(F.min(F.when(F.col("_new"), col)), F.max(col)).first()
        t.next_id = max(t.next_id, (high or 0) + 1)
        return out.drop("_new"), low

    def conflicts(self, t: Table, rows: DataFrame) -> DataFrame:
        """(_ord, key of the row that stands in the way) for keys and unique columns."""
        now = t.rows()
        out = None
        for cols in [[t.key], *(c for _, c in t.uniques)]:
            names = [f"k{i}" for i in range(len(cols))]
            a = rows.filter(reduce(lambda p, q: p & q, [F.col(ident(c)).isNotNull() for c in cols])).select("_ord", *[folded_key(c).alias(k) for c, k in zip(cols, names)])
            b = now.select(F.col(ident(t.key)).alias("_old"), *[folded_key(c).alias(k) for c, k in zip(cols, names)])
            found = a.join(b, names).select("_ord", "_old")
            out = found if out is None else out.unionByName(found)
        return out

    def insert_rounds(self, t: Table, rows: DataFrame, ignore: bool, replace: bool, update: list) -> int:
        """REPLACE and IGNORE in a fixed number of jobs, however often a key comes; ON DUPLICATE KEY UPDATE too, unless
        it reads old values or there are unique columns: then the rows of one key follow each other in rounds."""
        if not (ignore or replace or update):
            count = self.put(t, rows) if not self.conflicts(t, rows).limit(1).count() else self.name_conflict(t, rows)
            if count > 1:
                self.refuse_repeated_in(t, rows)
            return count
        if replace:
            return self.replaced_rows(t, rows)
        if ignore:
            return self.ignored_rows(t, rows)
        if not t.uniques and not any(reads(e, {c.name.lower() for c in t.columns}) for _, e in update):
            return self.upserted_rows(t, rows, update)
        turn = Window.partitionBy(folded_key(t.key)).orderBy("_ord")
        placed = staged(rows.withColumn("_turn", F.row_number().over(turn)), "rounds")
        total = 0
        for k in range(1, (placed.agg(F.max("_turn")).first()[0] or 0) + 1):
            part = placed.filter(F.col("_turn") == k).drop("_turn")
            met = staged(self.conflicts(t, part).groupBy("_ord").agg(F.min("_old").alias("_old"), F.collect_set("_old").alias("_olds")), "conflicts")
            free = part.join(met, "_ord", "left_anti")
            self.refuse_broken(t, free)
            total += self.put(t, free) + self.upsert(t, part, met, update)
        return total

    def replaced_rows(self, t: Table, rows: DataFrame) -> int:
        """A row stays if it is the last of its key and of each unique value that it has; what is there and shares one
        with any row goes. Each row counts."""
        gone = staged(self.conflicts(t, rows).select(F.col("_old").alias(t.key)).distinct(), "gone")
        last = rows
        for cols in [[t.key], *(c for _, c in t.uniques)]:
            names = [f"_k{i}" for i in range(len(cols))]
            keyed = last.withColumns({k: folded_key(c) for k, c in zip(names, cols)})
            ends = rows.select("_ord", *[folded_key(c).alias(k) for k, c in zip(names, cols)]).groupBy(*names).agg(F.max("_ord").alias("_last"))
            held = keyed.join(ends, [keyed[k].eqNullSafe(ends[k]) for k in names], "left").drop(*[ends[k] for k in names])
            empty = reduce(lambda p, q: p | q, [F.col(k).isNull() for k in names])
            last = held.filter(empty | (F.col("_last") == F.col("_ord"))).drop("_last", *names)
        total = rows.count()
        self.put(t, gone, deleted=True)
        self.put(t, staged(last, "replace"))
        return total

    def ignored_rows(self, t: Table, rows: DataFrame) -> int:
        """Rows that meet nothing that is there; of rows that share a key or a unique value the first. Rounds are as
        many as such rows lean on each other in turn, one where only the key is unique."""
        left = staged(rows.join(self.conflicts(t, rows).select("_ord").distinct(), "_ord", "left_anti"), "ignore")
        keys = [[t.key], *(c for _, c in t.uniques)]
        total = 0
        while not left.isEmpty():
            firsts = None
            for j, cols in enumerate(keys):
                filled = left.filter(reduce(lambda p, q: p & q, [F.col(ident(c)).isNotNull() for c in cols]))
                one = filled.groupBy(*[folded_key(c).alias(f"k{i}") for i, c in enumerate(cols)]).agg(F.min("_ord").alias("_first"))
                held = filled.select("_ord", *[folded_key(c).alias(f"k{i}") for i, c in enumerate(cols)]).join(one, [f"k{i}" for i in range(len(cols))]).select("_ord", (F.col("_ord") > F.col("_first")).alias("_later"))
                firsts = held if firsts is None else firsts.unionByName(held)
            later = firsts.groupBy("_ord").agg(F.max("_later").alias("_later")).filter("_later").select("_ord")
            total += self.put(t, left.join(later, "_ord", "left_anti"))
            if len(keys) == 1:
                break
            left = left.join(later, "_ord", "left_semi")
            left = staged(left.join(self.conflicts(t, left).select("_ord").distinct(), "_ord", "left_anti"), "ignore")
        return total

    def upserted_rows(self, t: Table, rows: DataFrame, update: list) -> int:
        """ON DUPLICATE KEY UPDATE by values of the incoming rows alone: the first of a new key is a row, and the last of
        each key that was met says what its columns become."""
        key = folded_key(t.key).alias("_k")
        ends = rows.groupBy(key).agg(F.min("_ord").alias("_first"), F.max("_ord").alias("_last"), F.count(F.lit(1)).alias("_n"))
        met = staged(self.conflicts(t, rows.select("_ord", ident(t.key))).select("_ord", "_old"), "conflicts")
        fresh = rows.join(ends.select(F.col("_first").alias("_ord")), "_ord", "left_semi").join(met, "_ord", "left_anti")
        self.refuse_broken(t, fresh)
        total = rows.count()
        self.put(t, fresh)
        again = ends.filter("_n > 1 OR false").select(F.col("_last").alias("_ord")).unionByName(met.join(ends.select(F.col("_last").alias("_ord")), "_ord", "left_semi").select("_ord")).distinct()
        part = staged(rows.join(again, "_ord", "left_semi"), "again")
        if not part.isEmpty():
            self.upsert(t, part, staged(self.conflicts(t, part).select("_ord", "_old"), "conflicts"), update)
        return total

    def name_conflict(self, t: Table, rows: DataFrame) -> int:
        now = t.rows().select(folded_key(t.key).alias("k"))
        if bad := rows.select(F.col(ident(t.key)).cast("string").alias("v"), folded_key(t.key).alias("k")).join(now, "k", "left_semi").first():
            raise DialectError(f"{t.key} {bad[0]} is taken")
        raise DialectError(f"{', '.join(c for _, cols in t.uniques for c in cols)} has a value twice")

    def refuse_repeated_in(self, t: Table, rows: DataFrame) -> None:
        only = t.copy()
        only.settle(rows)
        self.refuse_repeated(only)

    def upsert(self, t: Table, part: DataFrame, met: DataFrame, update: list) -> int:
        """ON DUPLICATE KEY UPDATE: VALUES(c) is the incoming value, a plain column the old one."""
        old = self.engine.temp_view(t.rows(), "old")
        new = self.engine.temp_view(part.join(met.select("_ord", "_old"), "_ord"), "new")
        emitter = Emitter(self.engine)
        columns = [(c.name, c.type.kind) for c in t.columns]
        scope = Scope([Source(t.name, columns), Source("_new", columns, hidden={c.lower() for c, _ in columns})], None)
        assigned: dict[str, n.Item] = {}
        for c, e in update:
            self.need(t, c.name)
            assigned[c.name.lower()] = n.Item(replaced(incoming_values(e), assigned, None), None, c.name)
        raw = [f"{emitter.expr(assigned[c.name.lower()].expr, scope).sql} AS `_v_{c.name}`" for c in t.columns if c.name.lower() in assigned]
        kinds = {c: emitter.expr(i.expr, scope).kind for c, i in assigned.items()}
        kept = [f"{ident(t.name)}.{ident(c.name)} AS `_v_{c.name}`" for c in t.columns if c.name.lower() not in assigned]
        kinds |= {c.name.lower(): c.type.kind for c in t.columns if c.name.lower() not in assigned}
        df = self.spark.sql(f"SELECT {', '.join(raw + kept)}, `_new`._ord FROM {old} AS {ident(t.name)} JOIN {new} AS `_new` ON {ident(t.name)}.{ident(t.key)} = `_new`._old")
        rows = self.typed(t, df, [c.name.lower() for c in t.columns], kinds)
        self.refuse_broken(t, rows)
        return self.put(t, rows)

    def need(self, t: Table, name: str) -> None:
        if t.column(name) is None:
            raise DialectError(f"Unknown column {name!r} in {t.name}")

    # UPDATE
    def update(self, source, set, where, order, limit) -> str:  # noqa: A002
        aliases = dict(targets(source))
        if len(aliases) > 1 and (order or limit):
            raise DialectError("ORDER BY and LIMIT go with a single table")
        by: dict[str, list] = {}
        for c, e in set:
            owners = [a for a, name in aliases.items() if (not c.table or c.table.lower() == a.lower()) and name.lower() not in self.engine.views and (self.engine.tables.get(name.lower()) is None or self.engine.tables[name.lower()].column(c.name))]
            if not owners and len(aliases) == 1:
                self.need(self.table(next(iter(aliases.values()))), c.name)
            owner = owners[0] if owners else next((a for a, name in aliases.items() if name.lower() in self.engine.views), None)
            if owner is None:
                raise DialectError(f"Unknown column {c.name!r}")
            self.table(aliases[owner])
            by.setdefault(owner, []).append((c, e))
        total = 0
        for alias, pairs in by.items():
            total += self.update_table(self.table(aliases[alias]), alias, source, pairs, where, order, limit, len(aliases) == 1)
        self.keep()
        self.engine.row_count = total
        return f"{total} row{'s' * (total != 1)} changed" + "".join(f"; {x}" for x in self.notes)

    def update_table(self, t: Table, alias: str, source, pairs, where, order, limit, single: bool) -> int:
        assigned: dict[str, n.Item] = {}
        for c, e in pairs:
            self.need(t, c.name)
            if isinstance(e, n.Call) and e.name == "DEFAULT":
                e = parse_expr(t.column(c.name).default or "NULL")
            assigned[c.name.lower()] = n.Item(replaced(e, assigned, None) if single else e, None, c.name)
        for c in t.columns:
            if c.on_update and c.name.lower() not in assigned:
                assigned[c.name.lower()] = n.Item(n.Call("CURRENT_TIMESTAMP", []), None, c.name)
        items = [n.Item(n.Col(t.key, alias), "_old", "_old")]
        items += [n.Item(assigned[c.name.lower()].expr if c.name.lower() in assigned else n.Col(c.name, alias), f"_v_{c.name}", c.name) for c in t.columns]
        places = [] if single else [n.Item(n.Col(key, a), f"_p{i}", f"_p{i}") for i, (a, key) in enumerate(self.keys_of(source)) if a.lower() != alias.lower()]
        q = n.Query(n.Select([*items, *places], source, where), order=order, limit=limit)
        held = Emitter(self.engine).query(q)
        df = self.spark.sql(held.sql)
        if not single:
            df = first_matches(df, [i.label for i in places])
        kinds = {c.name.lower(): held.columns[i + 1][1] for i, c in enumerate(t.columns)}
        rows = self.typed(t, df.filter("_old IS NOT NULL"), [c.name.lower() for c in t.columns], kinds)
        self.refuse_broken(t, rows)
        moved = staged(rows.filter(folded_key(t.key) != F.lower(F.rtrim(F.col("_old").cast("string")))).select(F.col("_old").alias(t.key), F.col(ident(t.key)).alias("_to")), "moved")
        referenced = {c for f in self.pointing(t) for c in f[1].to_columns}
        before = t.rows()
        keyed = moved.limit(1).count() > 0
        if keyed:
            self.put(t, moved.select(ident(t.key)), deleted=True)
        count = self.put(t, rows.drop("_old"))
        if keyed or any(c in assigned for _, cols in t.uniques for c in map(str.lower, cols)):
            self.refuse_repeated(t)
        if any(c.lower() in assigned for f in t.foreigns for c in f.columns):
            self.refuse_orphans(t, rows)
        if self.engine.checks_keys() and any(c.lower() in assigned for c in referenced):
            self.follow_updates(t, before, rows)
        return count

    def keys_of(self, source) -> list[tuple[str, str]]:
        """(alias, key) of the tables in FROM whose key is known."""
        out = []
        for alias, name in named(source):
            held, attached = self.engine.tables.get(name.lower()), self.engine.attached.get(name.lower())
            key = held.key if held is not None else attached[2] if attached is not None else None
            out += [(alias, key)] if key else []
        return out

    def pointing(self, t: Table) -> list[tuple[Table, Foreign]]:
        out = []
        for name in list(self.engine.tables):
            other = self.after.get(name) or self.engine.tables[name]
            out += [(other, f) for f in other.foreigns if f.to.lower() == t.name.lower()]
        return out

    def follow_updates(self, t: Table, before: DataFrame, rows: DataFrame) -> None:
        """ON UPDATE of the tables that point to changed values."""
        for child, f in self.pointing(t):
            old = before.select(F.col(ident(t.key)).alias("_key"), *[folded_key(c).alias(f"o{i}") for i, c in enumerate(f.to_columns)])
            new = rows.select(F.col("_old").alias("_key"), *[F.col(ident(c)).alias(f"n{i}") for i, c in enumerate(f.to_columns)])
            changed = old.join(new, "_key").filter(reduce(lambda a, b: a | b, [F.col(f"o{i}") != F.lower(F.rtrim(F.col(f"n{i}").cast("string"))) for i in range(len(f.columns))]))
            self.point(child.name, f, changed, [f"n{i}" for i in range(len(f.columns))], f.update)

    def point(self, child_name: str, f: Foreign, changed: DataFrame, new: list[str] | None, action: str) -> DataFrame | None:
        """Child rows that point to changed parents (o0, o1, …): refused, set, or returned for deletion."""
        child = self.table(child_name)
        keyed = child.rows()
        for i, c in enumerate(f.columns):
            keyed = keyed.withColumn(f"o{i}", folded_key(c))
        hit = staged(keyed.join(changed.dropDuplicates([f"o{i}" for i in range(len(f.columns))]), [f"o{i}" for i in range(len(f.columns))]), "hit")
        count = hit.count()
        if not count:
            return None
        if action == "RESTRICT":
            raise DialectError(f"{child.name} has rows that refer to it")
        if action == "CASCADE" and new is None:
            return hit.select(*map(ident, child.names))
        for i, c in enumerate(f.columns):
            hit = hit.withColumn(c, (F.col(new[i]) if action == "CASCADE" else F.lit(None)).cast(child.column(c).type.spark))
        rows = hit.select(*map(ident, child.names))
        self.refuse_broken(child, rows)
        self.put(child, rows)
        self.notes.append(f"{count} in {child.name} changed too")
        return None

    # DELETE
    def delete(self, targets, source, where, order, limit) -> str:  # noqa: A002
        aliases = dict(named(source))
        wanted = targets or list(aliases)
        if not targets and len(aliases) > 1:
            raise DialectError("Name the tables to delete from")
        total = 0
        for target in wanted:
            alias = next((a for a, name in aliases.items() if target.lower() in (a.lower(), name.lower())), None)
            if alias is None:
                raise DialectError(f"{target!r} isn't in FROM")
            t = self.table(aliases[alias])
            q = n.Query(n.Select([n.Item(n.Col(t.key, alias), "_key", "_key")], source, where), order=order, limit=limit)
            keys = self.spark.sql(Emitter(self.engine).query(q).sql)
            hit = keys.filter("_key IS NOT NULL").select(F.lower(F.rtrim(F.col("_key").cast("string"))).alias("_k")).distinct()
            gone = staged(t.rows().withColumn("_k", folded_key(t.key)).join(hit, "_k", "left_semi").drop("_k"), "gone")
            total += self.remove(t, gone)
        self.keep()
        self.engine.row_count = total
        return f"{total} row{'s' * (total != 1)} deleted" + "".join(f"; {x}" for x in self.notes)

    def remove(self, t: Table, gone: DataFrame) -> int:
        count = self.put(t, gone, deleted=True)
        if count and self.engine.checks_keys():
            for child, f in self.pointing(t):
                changed = gone.select(*[folded_key(c).alias(f"o{i}") for i, c in enumerate(f.to_columns)])
                more = self.point(child.name, f, changed, None, f.delete)
                if more is not None:
                    removed = self.remove(self.table(child.name), more)
                    self.notes.append(f"{removed} in {child.name} deleted too")
        return count


def first_matches(df: DataFrame, order: list[str]) -> DataFrame:
    """One row of each _old: the first by the keys of the tables it was joined with, then by its values."""
    rest = [c for c in df.columns if c != "_old" and c not in order]
    at = {c: i for i, c in enumerate(df.columns)}
    numbered_names = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    least = F.min(F.struct(*[f"c{at[c]}" for c in [*order, *rest]]))
    first = numbered_names.groupBy(F.col(f"c{at['_old']}").alias("_old")).agg(least.alias("r"))
    return first.select("_old", *[F.col(f"r.c{at[c]}").alias(c) for c in rest])


def reads(e, columns: set[str]) -> bool:
    """Whether an expression names one of the columns but in VALUES(), or might."""
    if isinstance(e, n.Call) and e.name == "VALUES":
        return False
    if isinstance(e, n.Col):
        return e.name.lower() in columns
    if isinstance(e, (list, tuple)):
        return any(reads(x, columns) for x in e)
    if isinstance(e, (n.Query, n.Select)):
        return True
    return any(reads(getattr(e, f), columns) for f in e.__dataclass_fields__) if hasattr(e, "__dataclass_fields__") else False


def incoming_values(e):
    """The expression with VALUES(c) as the incoming row's column."""
    if isinstance(e, n.Call) and e.name == "VALUES":
        return n.Col(e.args[0].name, "_new")
    if isinstance(e, list):
        return [incoming_values(x) for x in e]
    if isinstance(e, tuple):
        return tuple(incoming_values(x) for x in e)
    if not hasattr(e, "__dataclass_fields__") or isinstance(e, (n.Query, n.Select)):
        return e
    return type(e)(**{f: incoming_values(getattr(e, f)) for f in e.__dataclass_fields__})


def named(source) -> list[tuple[str, str]]:
    """(alias, table) of the tables in FROM."""
    if isinstance(source, n.Table):
        return [(source.alias or source.name, source.name)]
    if isinstance(source, n.Join):
        return named(source.left) + named(source.right)
    return []


targets = named
