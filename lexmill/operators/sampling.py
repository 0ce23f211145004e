"""Samples of bounded size, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, key: str, size: int, among: str | None = None, over: int = 4) -> DataFrame:
    """At most ``size`` of ``rows``, those of the least hash of ``key``; of those that fulfil ``among``, if given.

    Rows are first thinned to about ``over * size`` by the hash, so that what reaches the driver doesn't grow with the
    table or its partitions.  The choice depends on the keys only, not on their order or place.
    """
    total = rows.count()
    rank = F.xxhash64(key)
    share = min(1.0, over * size / max(total, 1))
    if share < 1:
        rows = rows.where(rank < F.lit(int(-(2**63) + share * 2**64)))
    if among:
        rows = rows.where(among)
    return rows.orderBy(rank, key).limit(size)
