"""Tables written to the shared folder, which cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    labels = df.columns
    df.toDF(*[f"c{k}" for k in range(len(labels))]).write.parquet(path)  # names of any kind, equal but for case included
    return df.sparkSession.read.parquet(path).toDF(*labels)


class Parts:
    """A staged table that grows: each part is written once, and the whole is one scan however many there are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> DataFrame:
        """Write the rows and read back these alone; columns are those of the first part."""
        if not self.n:
            self.labels = df.columns
        plain = df.toDF(*[f"c{k}" for k in range(len(self.labels))])
        path = f"{self.path}/p{self.n:05d}"
        plain.write.parquet(path)
        if not self.n:
            self.schema = self.spark.read.parquet(path).schema
        self.n += 1
        return self.read(path)

    def all(self) -> DataFrame:
        return self.read(f"{self.path}/*")

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path).toDF(*self.labels)


#: Low bits of monotonically_increasing_id(): a row's place in its partition.
PLACE = (1 << 33) - 1


def numbered(df: DataFrame, name: str, start: int = 1, order: str | None = None) -> DataFrame:
    """df with a column of whole numbers from `start` without gaps, in the order given, else in the rows' own.

    Places within partitions are written with the rows; only the partitions' sizes, a row each, are summed in one task.
    """
    rows = df if order is None else df.repartitionByRange(order).sortWithinPartitions(order)
    held = staged(rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(PLACE))
    sizes = held.groupBy(part.alias("__part")).agg((F.max(place) + 1).alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")
    out = held.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row for each partition
    return out.withColumn(name, (F.col("__before") + place + F.lit(start)).cast("bigint")).drop("__at", "__part", "__before")
