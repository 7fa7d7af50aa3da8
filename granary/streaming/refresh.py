"""Keep a table of current records fresh while log files arrive, and windowed counts over an event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.log import latest


def follow(spark: SparkSession, source: str, target: str, schema: str, key: str, seq: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Merge each batch of new log rows into the table at `target`: the last write of each key stays.

    Each batch writes a new version beside the old one and then names it in `current`; a batch that is run again after
    a failure writes the same rows. Without `every` what is there is read once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        old = current(session, target)
        rows = batch if old is None else old.unionByName(batch)
        version = f"{target}/v{number:08d}-{uuid.uuid4().hex[:8]}"
        latest(rows, key, seq).write.parquet(version)
        session.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").parquet(f"{target}/current")

    stream = spark.readStream.schema(schema).json(source)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest version of a followed table."""
    try:
        row = spark.read.parquet(f"{target}/current").orderBy(F.desc("number")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return spark.read.parquet(row.version)


def windowed_counts(events: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling windows; events later than `late` behind the newest are dropped. Works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
