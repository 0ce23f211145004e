"""Exact global ranks and exact per-class shares that need no single task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def dense_index(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``name``, their 0-based rank in ``order``, which must tell all rows apart.

    The rows are range-partitioned in that order; each partition ranks its own, after the counts of those before it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return placed.join(before, "_part").withColumn(name, rank.cast("long")).drop("_part", "_before")


def least_of_group(rows: DataFrame, group: str, key: Column, quota: Column) -> DataFrame:
    """``rows`` with ``chosen``: whether a row is among the ``quota`` of its ``group`` with the least ``key``.

    ``key`` is a hexadecimal hash, ``quota`` an expression of ``n``, the group's size.  Groups may be of any size: only
    rows that share the first four digits of the limiting key are ranked, the others are told by a histogram.
    """
    keyed = rows.withColumn("_key", key).withColumn("_head", F.substring("_key", 1, 4))
    hist = keyed.groupBy(group, "_head").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group).orderBy("_head")  # at most 65,536 rows a group
    hist = hist.select(group, "_head", F.sum("_c").over(w).alias("_upto"), (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(group)).alias("n"))
    hist = hist.withColumn("_quota", quota)
    full = keyed.join(hist, [group, "_head"])
    whole = full.where("_upto <= _quota OR _before >= _quota").withColumn("chosen", F.col("_upto") <= F.col("_quota"))
    edge = full.where("_upto > _quota AND _before < _quota")
    edge = edge.withColumn("chosen", F.row_number().over(Window.partitionBy(group, "_head").orderBy("_key")) <= F.col("_quota") - F.col("_before"))
    return whole.unionByName(edge).drop("_key", "_head", "_upto", "_before", "_quota", "n")
