"""Buckets of any size, compared in blocks of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame, block_rows: int, keep: list[str], order: str, blocks: Column | None = None) -> DataFrame:
    """Deal rows (bucket, n and `order`, n being the bucket's size) out so that all pairs of a bucket meet.

    A bucket over block_rows rows, or of `blocks`, is split in blocks by a hash of `order`; each pair of blocks is a cell, which goes to
    a task of its own, and each row to the cells of its block. Adds cell, block, and crossed, which says that only
    rows of different blocks are to be compared. A task's rows come sorted by bucket, cell and `order`.
    """
    rows = rows.withColumn("blocks", (F.ceil(F.col("n") / block_rows) if blocks is None else blocks).cast("int")).withColumn("block", F.pmod(F.xxhash64(order), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("block")) * F.col("blocks") + F.greatest(j, F.col("block")))
    rows = rows.withColumn("cell", F.explode(cells)).withColumn("crossed", F.floor(F.col("cell") / F.col("blocks")) != F.col("cell") % F.col("blocks"))
    return rows.select("bucket", "cell", "block", "crossed", *keep).repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", order)
