"""Numbers in order inside groups of any size: no group is ever one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources import scratch


def numbered(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """rows with their place (from 0) inside each group by the order columns, and the group's size as ``<out>_of``.

    Rows are range-partitioned by group and order and written, so that a large group lies in several consecutive parts; places are
    counted inside each part, and the parts' sizes, a few rows, give what stands before it. The order has to tell rows apart for places to be stable.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    parts = scratch.materialise(dealt.withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before, whole = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    offsets = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(f"{out}_of"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    held = parts.withColumn("_in", inside)
    same = held[group].eqNullSafe(offsets[group]) & (held["_part"] == offsets["_part"])
    joined = held.join(offsets, same).select(*[held[c] for c in rows.columns], (F.col("_before") + F.col("_in")).alias(out), f"{out}_of")
    return joined
