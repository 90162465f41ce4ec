"""Row numbers over a whole frame without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orgweft.session import durable

_POSITION_MASK = (1 << 33) - 1


def global_row_number(
    df: DataFrame, order: list[Column], name: str, *, partitions: int | None = None
) -> DataFrame:
    """Number all rows from 1 in ``order``, which must be total.

    Rows are range-partitioned and sorted; the stored sort gives each row its place in
    its partition, and the partition sizes (one row per partition) give the offsets.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        df.repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place") + 1)
        .drop("_part", "_place", "_offset")
    )


def running_total(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows up to this one in ``order``, which must be total.

    Like row numbers: sums within range partitions, and one row per partition for the offsets.
    """
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        df.repartitionByRange(count, *order).withColumn("_part", F.spark_partition_id())
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum(amount).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.withColumn(name, F.sum(amount).over(inside))
        .join(offsets, "_part")
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_part", "_offset")
    )


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], keep: int, name: str = "position"
) -> DataFrame:
    """The first ``keep`` rows of each group.

    Spark pushes the bound below the shuffle, so each task sends at most ``keep`` rows
    of a group, however large the group is.
    """
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= keep)
