"""What the operators of this subpackage share: tables, the shared work folder, staging, Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.shipping import ship

#: Rows of an Arrow batch that goes to Python; texts may be long, so batches are small.
BATCH_ROWS = 512
BATCH_BYTES = 2 << 20
#: Seconds without a use after which a worker lets go of what it keeps from task to task.
IDLE_S = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that a worker's memory doesn't follow the text length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared folder in spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if base.startswith("file:/") and not base.startswith("file://"):  # as Hadoop writes it
        base = base.removeprefix("file:")
    if "://" not in base:
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """df's rows as the struct `row`, beside the columns named: whatever names df has, none can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def free_name(columns: list[str], stem: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in columns}
    while stem in taken:
        stem += "_"
    return stem


def apart(key: str | Column) -> Column:
    """The same string key, as an expression that Catalyst can't trace to its source.

    A join on it shuffles both sides under the join itself, which is what lets adaptive execution split a hot key.
    """
    return F.concat(F.col(key) if isinstance(key, str) else key, F.substring(F.lit("x"), 2, 1))


def apart_long(key: str) -> Column:
    """The same for a key of whole numbers."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the queries."""
    return F.crc32(F.col(column).cast("string")) % n


def give_back() -> None:
    """Hand to the system what Arrow's and the C library's allocators hold without need: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # the GNU C library's
        trim(0)


class Kept:
    """What a worker keeps from task to task: made at the first use, let go when IDLE_S seconds pass without one, so
    that the idle workers of a stage that is over don't hold it beside the stages after it."""

    def __init__(self, make: Callable):
        self.make, self.lock, self.users = make, threading.Lock(), 0
        self.held: dict[tuple, object] = {}
        self.timer: threading.Timer | None = None

    @contextmanager
    def use(self, *key) -> Iterator:
        with self.lock:
            if self.timer is not None:
                self.timer.cancel()
            if key not in self.held:
                self.held = {key: self.make(*key)}
            self.users += 1
        try:
            yield self.held[key]
        finally:
            with self.lock:
                self.users -= 1
                self.timer = threading.Timer(IDLE_S, self.drop)
                self.timer.daemon = True
                self.timer.start()

    def drop(self) -> None:
        with self.lock:
            if self.users:
                return
            self.held = {}
        give_back()
