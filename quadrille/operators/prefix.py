"""Distributed prefix sums: no window ever holds a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.storage import materialize, n_partitions


def prefix_sums(
    df: DataFrame,
    order_by: list[str],
    value: Column,
    group: str | None = None,
    out: str = "before",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the same group.

    Rows are range-partitioned by (group, order), so a hot group spreads over
    many tasks. The written table fixes positions once; a second pass sums
    inside each range, and the ranges' totals (one row per range and group) give
    the offsets. Rows equal in every ordering column are ordered by their place
    in the input. Nulls sort first. An empty table gives an empty table.
    """
    spark = df.sparkSession
    parts = partitions or n_partitions(spark)
    group_cols = [group] if group else []
    rows = df.withColumn("__value", value.cast("long")).withColumn("__place", F.monotonically_increasing_id())
    keys = [*group_cols, *order_by, "__place"]
    ranged = (
        rows.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .drop("__place")
        .withColumn("__at", F.monotonically_increasing_id())
    )
    kept = materialize(ranged, "prefix").withColumn("__range", F.shiftright("__at", 33))
    gkey = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    gnull = F.col(group).isNull() if group else F.lit(False)
    kept = kept.withColumn("__g", gkey).withColumn("__gn", gnull)
    totals = kept.groupBy("__range", "__g", "__gn").agg(F.sum("__value").alias("__total"))
    over = Window.partitionBy("__g", "__gn").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__range", "__g", "__gn", F.coalesce(F.sum("__total").over(over), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy("__range", "__g", "__gn").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    summed = kept.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    joined = summed.join(offsets, ["__range", "__g", "__gn"])
    return joined.withColumn(out, F.col("__inside") + F.col("__offset")).drop(
        "__range", "__g", "__gn", "__at", "__value", "__inside", "__offset"
    )
