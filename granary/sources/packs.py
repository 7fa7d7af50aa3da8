"""Packs: texts that hold a table's records, as rows of the log (id, p, signer, time)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.shipping import ship

# Fixed values of the format: a tag, then a letter for the mode: j records as JSON, s a structure record as JSON.
TAG = "PK1"
COLUMNS_MOST = 4096
RECORDS_MOST = 1_000_000
BYTES_MOST = 16 << 20

BODY = "struct<c:array<string>,i:int,r:array<array<string>>,d:array<int>>"


def body_of(payload: str | Column, mode: str, tag: str = TAG) -> Column:
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.when(p.startswith(tag + mode), F.substring(p, len(tag) + 2, 2**31 - 1))


def decode(log: DataFrame, payload: str = "p", tag: str = TAG) -> DataFrame:
    """A row a record of the log's packs: the log's other columns, pack columns, key, values by column, deleted, record.

    Packs in JSON are read by Spark's own parser. What isn't a pack, or breaks a bound or its own column count, gives
    no records. Rows shorter than the columns are filled with NULL.
    """
    held = log.withColumn("_b", F.from_json(body_of(payload, "j", tag), BODY))
    sound = F.size("_b.c").between(1, COLUMNS_MOST) & F.coalesce(F.col("_b.i"), F.lit(0)).between(0, F.size("_b.c") - 1) & (F.size("_b.r") <= RECORDS_MOST) & (F.length(payload) <= 2 * BYTES_MOST)
    rows = held.filter(sound).select("*", F.posexplode("_b.r").alias("record", "_v"))
    key = F.get("_v", F.coalesce(F.col("_b.i"), F.lit(0)))
    values = F.map_from_arrays("_b.c", F.transform(F.sequence(F.lit(0), F.size("_b.c") - 1), lambda k: F.get(F.col("_v"), k)))
    deleted = F.coalesce(F.array_contains("_b.d", F.col("record")), F.lit(False))
    return rows.select(*[c for c in log.columns if c != payload], F.get("_b.c", F.coalesce(F.col("_b.i"), F.lit(0))).alias("key_column"), key.alias("key"), values.alias("values"), deleted.alias("deleted"), "record")


def structures(log: DataFrame, payload: str = "p", tag: str = TAG) -> DataFrame:
    """The log's structure records, as JSON text in `structure`."""
    return log.withColumn("structure", body_of(payload, "s", tag)).filter("structure is not null").drop(payload)


def decode_with(log: DataFrame, decoders: dict[str, Callable[[str], Iterator[dict]]], schema: str, payload: str = "p") -> DataFrame:
    """Records of foreign packs: each decoder reads those whose payload begins with its tag, a batch at a time."""
    ship(log.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                for tag, read in decoders.items():
                    if p and p.startswith(tag):
                        out.extend(read(p))
                        break
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return log.select(payload).mapInArrow(run, schema)


def encode(columns: list[str], rows: list[list], key: int = 0, deleted: tuple[int, ...] = (), tag: str = TAG) -> str:
    """One pack. Deleted records keep their key alone."""
    if not 1 <= len(columns) <= COLUMNS_MOST or not 0 <= key < len(columns):
        raise ValueError("there must be 1 to 4096 columns, one of them the key")
    gone = set(deleted)
    held = [[v if k == key else None for k, v in enumerate(r)] if i in gone else list(r) for i, r in enumerate(rows)]
    body = {"c": columns, "i": key, "r": held} | ({"d": sorted(gone)} if gone else {})
    return f"{tag}j{json.dumps(body, ensure_ascii=False, separators=(',', ':'), default=str)}"


def pack_id(payload: str) -> str:
    return hashlib.blake2b(payload.encode(), digest_size=10).hexdigest()


def plan(columns: list[str], rows: list[list], most: int, key: int = 0) -> list[str]:
    """As few packs as their order allows, each of at most `most` bytes."""
    return [p for p, _ in cuts(columns, rows, most, key)]


def cuts(columns: list[str], rows: Iterable[list], most: int, key: int = 0) -> Iterator[tuple[str, int]]:
    """plan()'s packs with their numbers of records, as the rows come: sizes add up, so one pass finds where to cut."""
    empty = len(encode(columns, [], key).encode())
    held, size = [], empty
    for r in rows:
        own = len(encode(columns, [r], key).encode()) - empty
        if empty + own > most:
            raise ValueError(f"the record with key {r[key]!r} doesn't fit in {most} bytes")
        if held and (size + own + 1 > most or len(held) == RECORDS_MOST):
            yield encode(columns, held, key), len(held)
            held, size = [], empty
        size += own + (1 if held else 0)
        held.append(r)
    if held:
        yield encode(columns, held, key), len(held)


def write_packs(df: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """A DataFrame as log rows (id, p, n_records): each partition in packs of at most `most` bytes, in its order."""
    ship(df.sparkSession)
    columns = df.columns
    at = columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (list(r) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for p, n in cuts(columns, rows, most, at):
            yield pa.RecordBatch.from_pydict({"id": [pack_id(p)], "p": [p], "n_records": pa.array([n], pa.int64())})

    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.mapInArrow(run, "id string, p string, n_records long")


#: Fees of one write, by the parts it takes: none a direct write, under ten a list, else a session.
FEES = {"transaction": 5_000, "direct": 1_000_000, "list": 3_000_000, "session": 5_000_000, "deposit": 730_000}


def write_cost(parts: int) -> int:
    if parts == 0:
        return FEES["direct"] + FEES["transaction"]
    return (FEES["list"] if parts < 10 else FEES["session"] + FEES["deposit"]) + (parts + 1) * FEES["transaction"]
