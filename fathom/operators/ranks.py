"""Ranks within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import materialize


def cumulative_counts(df: DataFrame, group: list[str], order: list[str], weight: str, partitions: int | None = None) -> DataFrame:
    """Add ``before`` (summed weight of the rows ahead in the group) and ``total`` (summed weight of the group).

    The rows are range-partitioned by (group, order), so a hot group spreads over many partitions. Each
    partition sums its own rows, the sums of the partitions (one row a group and partition) are accumulated,
    and every row adds its partition's offset. Rows must be distinct in (group, order); ``order`` sorts ascending.
    The partitioned rows are written once, so the partition numbers stay the same if a task runs again.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranks")
    local = rows.withColumn("_local", F.sum(weight).over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    sums = rows.groupBy(*group, "_part").agg(F.sum(weight).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy(*group)).alias("total"),
    )
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(offsets, on).withColumn("before", F.coalesce("_local", F.lit(0)) + F.col("_offset")).drop(
        "_part", "_p", "_local", "_offset", *[f"_g{i}" for i in range(len(group))]
    )
