"""Dense numbers over a global order without putting all rows into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraload.runtime import stage

# ``monotonically_increasing_id`` holds the partition above this bit and the row below it.
_PARTITION_BIT = 33


def number_rows(df: DataFrame, order_by: list[str | Column], name: str, start: int = 0,
                partitions: int | None = None) -> DataFrame:
    """Add ``start + 1, start + 2, …`` in the given order; a hash of the row settles ties.

    Rows are range-partitioned and numbered inside their partition. That result is written
    once, because a second evaluation might cut the ranges elsewhere. The partition sizes
    (one number each) then give every partition its first number.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # With the hash, a value that many rows share can still be cut into several ranges; rows that are
    # equal in all columns are told apart by where they lie.
    order = [*order_by, F.xxhash64(*df.columns), F.col("_place")]
    local = (
        df.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .drop("_place")
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    kept = stage(local, "numbered")
    part = F.shiftright("_slot", _PARTITION_BIT)
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [start, *accumulate((s for _, s in sizes), initial=start)][1:]
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _before long")
    row = F.col("_slot").bitwiseAND(F.lit((1 << _PARTITION_BIT) - 1))
    # One row per partition: small whatever the data.
    return (
        kept.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + row + 1)
        .drop("_part", "_before", "_slot")
    )
