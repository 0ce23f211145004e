"""Reproducible splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import least_of_group


def stratified_split(rows: DataFrame, label: str = "label", key: str = "doc_id", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with ``is_test``: of each class, the ``ceil(test_size * n)`` rows of the least hash of key and seed.

    Depends on keys, labels and seed only, not on order or partitions.  A null label is a class of its own.
    """
    group = F.coalesce(F.col(label).cast("string"), F.lit(" null"))
    hashed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    out = least_of_group(rows.withColumn("_group", group), "_group", hashed, F.ceil(F.lit(test_size) * F.col("n")))
    return out.withColumnRenamed("chosen", "is_test").drop("_group")
