"""Replay of an append-only log: last write wins, tombstones, clearing, re-keying, checkpoints and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Slices of a log's order whose sums meet in one task.
SLICES = 10_000
#: Slices of the order that a key's writes are compared in.
PARTS = 256


def latest(log: DataFrame, key: str | Column, seq: str | Column) -> DataFrame:
    """The row of the greatest seq of each key, all columns kept. Aggregated before the shuffle, so hot keys are one row a task."""
    k = F.col(key) if isinstance(key, str) else key
    s = F.col(seq) if isinstance(seq, str) else seq
    return log.groupBy(k.alias("__key")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in log.columns]), s).alias("__row")).select("__row.*")


def merge(log: DataFrame, key: str, seq: str, deleted: str) -> DataFrame:
    """Current rows of a log: the last write of each key that isn't a tombstone, with `versions` and `first_seq`.

    versions counts the writes since the key's last tombstone; first_seq, the key's first write of all, gives the order
    in which a reader lists rows, a key that comes back after a tombstone at its old place. Null keys are one key.

    The writes are joined with their keys by a struct, in which nulls are equal and which nothing is dealt by yet: both
    sides shuffle right under the join, so that adaptive execution can split a hot key, and the counts are pre-aggregated.
    """
    writes = log.withColumn("_dead", F.coalesce(F.col(deleted), F.lit(False)))
    summary = writes.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in log.columns if c != key]), F.col(seq)).alias("_row"),
        F.max(F.when(F.col("_dead"), F.col(seq))).alias("_last_dead"),
        F.min(F.when(~F.col("_dead"), F.col(seq))).alias("first_seq"),
    )
    live = summary.filter(~F.coalesce(F.col(f"_row.{deleted}"), F.lit(False)))
    counted = (
        writes.filter(~F.col("_dead")).select(key, F.col(seq).alias("_seq"), F.struct(key).alias("_key"))
        .join(live.select(F.struct(key).alias("_key"), "_last_dead"), "_key")
        .filter("_last_dead IS NULL OR _seq > _last_dead")
        .groupBy(key).agg(F.count(F.lit(1)).alias("versions"))
    )
    out = live.alias("l").join(counted.alias("c"), F.col(f"l.{key}").eqNullSafe(F.col(f"c.{key}")))
    fields = [F.col(f"l._row.{c}").alias(c) for c in log.columns if c not in (key, deleted)]
    return out.select(F.col(f"l.{key}").alias(key), *fields, "versions", "first_seq")


def after_clear(log: DataFrame, seq: str, clears: DataFrame | None = None, clear: Column | None = None) -> DataFrame:
    """Log rows after the last clearing event; clear marks such rows in the log itself, or clears (seq) lists them."""
    marks = clears if clears is not None else log.filter(clear).select(seq)
    last = marks.agg(F.max(seq)).first()[0]  # a literal reaches the scan, and spares the files before it
    out = log if last is None else log.filter(F.col(seq) > F.lit(last))
    return out if clear is None else out.filter(~F.coalesce(clear, F.lit(False)))


def rekey(log: DataFrame, epochs: Sequence[tuple[int, str]], seq: str, name: str = "key") -> DataFrame:
    """The log's key by epochs: rows before the first change of the key column are keyed by the last one, too.

    epochs: (seq from which a column is the key, column). Replay re-keys what is already there whenever the key
    changes, so that in the end all rows that are still live carry the last epoch's key.
    """
    return log.withColumn(name, F.col(max(epochs)[1]).cast("string"))


def replay(log: DataFrame, epochs: Sequence[tuple[int, str]], seq: str, deleted: str) -> DataFrame:
    """Rows left after replay in epochs: within an epoch by its key, and between two by re-keying what is live.

    Epochs are few and known; each is one more aggregation.
    """
    held = None
    bounds = [start for start, _ in epochs[1:]] + [None]
    for (start, column), stop in zip(epochs, bounds):
        part = log.filter(F.col(seq) >= start) if stop is None else log.filter((F.col(seq) >= start) & (F.col(seq) < stop))
        both = part if held is None else held.unionByName(part)
        held = latest(both, column, seq).filter(~F.coalesce(F.col(deleted), F.lit(False)))
    return held


def from_checkpoint(log: DataFrame, checkpoints: DataFrame, pack: str, seq: str, official: Column) -> DataFrame:
    """The part of the log that a reader needs: from the newest official checkpoint whose packs are all there.

    checkpoints: (seq, packs, ...), packs being the ids of the packs that the checkpoint wrote. Without a whole one
    the log stays as it is.
    """
    wanted = checkpoints.filter(official).select(F.col(seq).alias("_at"), F.explode("packs").alias(pack))
    present = log.select(pack, F.col(seq).alias("_own")).groupBy(pack).agg(F.min("_own").alias("_own"))
    whole = wanted.join(present, pack, "left").groupBy("_at").agg(F.count(F.when(F.col("_own").isNull(), 1)).alias("_missing"), F.min("_own").alias("_first")).filter("_missing = 0")
    start = whole.agg(F.max_by("_first", "_at")).first()[0]
    return log if start is None else log.filter(F.col(seq) >= F.lit(start))


def newest_pages(pages: DataFrame, number: str, checkpoint: Column, *, most: int | None = None) -> DataFrame:
    """The pages (rows with a `number`, the largest the newest) that a reader who goes backwards reads: down to the
    newest one with a checkpoint, that one included, and no more than `most`. Without a checkpoint, all."""
    last = pages.filter(checkpoint).agg(F.max(number)).first()[0]
    out = pages if last is None else pages.filter(F.col(number) >= F.lit(last))
    return out if most is None else out.orderBy(F.desc(number)).limit(most)


def commits(log: DataFrame, key: str, seq: str, *, of: object | None = None, most: int | None = None) -> DataFrame:
    """The log's writes newest first, of one key or of all, with `change`: Added, Changed or, where the write before it
    of its key is the same but for seq, Repeated. seq holds whole numbers; null keys are one key and equal nulls the same.

    A key's writes are compared within slices of the order, so that a hot key is no single task's; the first of a
    slice is compared with the last of the key's slice before it, of which there are PARTS at most.
    """
    fields = [c for c in log.columns if c not in (key, seq)]
    held = log if of is None else log.filter(F.col(key) == F.lit(of))
    low, high = held.agg(F.min(seq), F.max(seq)).first()
    width = 1 if low is None else (high - low) // PARTS + 1
    # a struct equals another whose null is at the same place
    rows = held.withColumn("_key", F.struct(F.col(key))).withColumn("_slice", F.floor((F.col(seq) - F.lit(low)) / width)).withColumn("_row", F.struct(*fields))
    lasts = rows.groupBy("_key", "_slice").agg(F.max_by("_row", seq).alias("_row"))
    earlier = lasts.select("_key", "_slice", F.lag("_row").over(Window.partitionBy("_key").orderBy("_slice")).alias("_earlier"))
    within = rows.withColumn("_before", F.lag("_row").over(Window.partitionBy("_key", "_slice").orderBy(seq)))
    before = F.coalesce("_before", "_earlier")
    change = F.when(before.isNull(), "Added").when(before == F.col("_row"), "Repeated").otherwise("Changed")
    marked = within.join(earlier, ["_key", "_slice"]).select(*log.columns, change.alias("change"))
    return marked if most is None else marked.orderBy(F.desc(seq)).limit(most)


def with_own_writes(log: DataFrame, own: DataFrame, key: str, seq: str) -> DataFrame:
    """The log with a writer's own writes that it doesn't show yet: those of a seq that isn't there. What the log has
    by now is taken from it, so a write is never there twice."""
    missing = own.join(log.select(key, seq), [key, seq], "left_anti")
    return log.unionByName(missing.select(*log.columns))


def by_writer(log: DataFrame, signer: str, owner: str, writers: Sequence[str] = (), which: str = "official") -> DataFrame:
    """Rows of official writers (the owner and those it named), of the others, or all, with `official`."""
    out = log.withColumn("official", F.col(signer).isin([owner, *writers]))
    return out if which == "all" else out.filter("official" if which == "official" else "NOT official")


def within_budget(log: DataFrame, size: str, seq: str, official: Column, *, pack_bytes: int = 64 << 10, total_bytes: int = 4 << 20) -> DataFrame:
    """Official rows, and of the others those up to pack_bytes whose sizes, newest first, sum up to total_bytes at most.

    The running sum is computed in two steps, within slices of the order and over the slices' sums; there are SLICES
    at most, whatever the log's length.
    """
    others = log.filter(~official & (F.col(size) <= pack_bytes))
    newest = others.agg(F.max(seq)).first()[0] or 0
    sliced = others.withColumn("_slice", F.floor(F.col(seq) / max(64, -(-newest // SLICES))))
    sums = sliced.groupBy("_slice").agg(F.sum(size).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") <= total_bytes)
    within = Window.partitionBy("_slice").orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0)
    kept = sliced.join(before, "_slice").withColumn("_run", F.sum(size).over(within) + F.col("_before")).filter(F.col("_run") <= total_bytes)
    return log.filter(official).unionByName(kept.select(*log.columns))


def aligned(log: DataFrame, columns: Sequence[tuple[str, str, str, object]], values: str = "values") -> DataFrame:
    """Rows through a structure: columns are (shown name, storage key, Spark type, fill), values a map by storage key.

    A column that a row hasn't got is filled; a value that isn't of the type is NULL.
    """
    shown = []
    for name, key, kind, fill in columns:
        held = F.col(values).getItem(key)
        own = F.when(F.map_contains_key(values, key), held.try_cast(kind)).otherwise(F.lit(fill).cast(kind))
        shown.append(own.alias(name))
    return log.select(*[c for c in log.columns if c != values], *shown)


def reassemble(parts: DataFrame, row: Sequence[str], index: str, text: str, total: str | None = None) -> DataFrame:
    """Rows that were written in parts: texts joined by index. A part that was sent again counts once, with its least
    text. With total, only rows that have all of the parts 0 to total - 1, and no others, are there."""
    sums = [F.max(total).alias("_total")] if total else []
    once = parts.groupBy(*row, F.col(index).alias("_i")).agg(F.min(text).alias("_t"), *sums)
    held = F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_t").alias("t"))))
    bounds = [F.max("_total").alias("_total"), F.min("_i").alias("_low"), F.max("_i").alias("_high")] if total else []
    out = once.groupBy(*row).agg(held.alias("_parts"), F.count("_i").alias("_n"), *bounds)
    if total:
        out = out.filter("_n = _total AND _low = 0 AND _high = _total - 1")
    return out.select(*row, F.array_join(F.transform("_parts", lambda p: p["t"]), "").alias(text), F.col("_n").alias("n_parts"))


def overlay(base: DataFrame, pending: DataFrame, key: str, deleted: str) -> DataFrame:
    """A sheet: base rows with pending ones over them, and `state`: Saved, New, Changed or Deleted.

    A pending row equal to the base is Saved again.
    """
    fields = [c for c in base.columns if c != key]
    a = base.select(F.col(key), F.struct(*fields).alias("_base"))
    b = pending.select(F.col(key), F.struct(*fields).alias("_new"), F.coalesce(F.col(deleted), F.lit(False)).alias("_gone"))
    both = a.join(b, key, "full")
    state = (
        F.when(F.col("_gone").isNull(), "Saved")
        .when(F.col("_base").isNull(), F.when(F.col("_gone"), None).otherwise("New"))
        .when(F.col("_gone"), "Deleted")
        .when(F.col("_base") == F.col("_new"), "Saved")
        .otherwise("Changed")
    )
    shown = F.when(F.col("_gone").isNull() | F.col("_gone"), F.col("_base")).otherwise(F.col("_new"))
    return both.withColumn("state", state).filter("state is not null").select(key, *[shown[c].alias(c) for c in fields], "state")
