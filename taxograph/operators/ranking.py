"""Places of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxograph.workspace import Workspace


def ranked(ws: Workspace, rows: DataFrame, keys: list[str], order: list[Column], label: str, name: str = "n", total: str | None = None) -> DataFrame:
    """The rows with their place ``name`` (BIGINT, from 1) among those of their keys, and with ``total``, the number of those.

    Rows are range-partitioned by keys and order, so a group that holds most rows lies in many partitions; each counts its
    own rows, and what the partitions before it hold of the group is added. No task ever sorts a whole group. Rows that tie
    in all of the order get places in any order.
    """
    spread = ws.write(rows.repartitionByRange(*keys, *order).withColumn("range_part", F.spark_partition_id()), label)
    counts = spread.groupBy("range_part", *keys).agg(F.count(F.lit(1)).alias("range_rows"))
    group = Window.partitionBy(*keys)  # a row for each partition that a group lies in
    before = F.coalesce(F.sum("range_rows").over(group.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("range_part", *keys, before.alias("range_before"), F.sum("range_rows").over(group).alias("range_total"))
    own = F.row_number().over(Window.partitionBy("range_part", *keys).orderBy(*order))
    out = spread.withColumn("range_own", own).join(offsets, ["range_part", *keys])
    return out.select(*rows.columns, (F.col("range_own") + F.col("range_before")).cast("bigint").alias(name), *([F.col("range_total").alias(total)] if total else []))
