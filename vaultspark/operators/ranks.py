"""Places in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.session import written


def placed(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with `name`, the place of each row, from 1, among those of its group: what row_number() gives over the same order.

    Rows are sorted in ranges, written, and numbered within their range; the sizes of the ranges before, as many
    numbers as ranges and groups, are added. So a group of any size is sorted by many tasks, where a window sorts it
    in one. The order has to tell all rows apart for places to be always the same. Runs while the plan is built.
    """
    keys = [F.col(g) for g in group]
    by = [k.asc() for k in keys] + order
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_line", F.monotonically_increasing_id()))
    lot = F.shiftright("_line", 33)  # the range; its lines count up from 0
    names = [f"_group{i}" for i in range(len(group))]
    sizes = rows.groupBy(*[k.alias(n) for k, n in zip(keys, names)], lot.alias("_lot")).agg(F.min("_line").alias("_first"), F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*names).orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(*names, "_lot", (before - F.col("_first") + 1).alias("_shift"))
    same = lot == F.col("_lot")
    for k, n in zip(keys, names):
        same = same & k.eqNullSafe(F.col(n))
    return rows.join(shift, same).withColumn(name, (F.col("_line") + F.col("_shift")).cast("long")).drop("_line", "_lot", "_shift", *names)
