"""Joins in which one key may hold a large part of all rows.

A key is *hot* if more than ``1 / HOT_SHARE`` of all rows hold it and more than ``FEW_ROWS`` of them do, so fewer than
``HOT_SHARE`` keys can be, and their list has a proven bound.  Tables of up to ``FEW_ROWS`` rows have none and cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE, FEW_ROWS = 1000, 1_000_000
#: Rows of a hot key that go to one task.
SPLIT_ROWS = 250_000


#: A table is sent to all executors if it has no more rows, and no more bytes of text, than this.
SMALL_ROWS, SMALL_BYTES = 500_000, 1 << 25


def is_small(rows: DataFrame, text: str) -> bool:
    """Whether a stored table, whose only long column is ``text``, may be broadcast."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return n <= SMALL_ROWS and size <= SMALL_BYTES


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> dict:
    """{key: rows that hold it} of the hot keys of ``rows``; null is none."""
    total = rows.count() if total is None else total
    if total <= FEW_ROWS:
        return {}
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return {r[0]: r[1] for r in counts.where(F.col("_n") > max(FEW_ROWS, total // HOT_SHARE)).collect()}


def attach(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``facts``, which has at most one row a ``key``; rows of a hot key stay where they are.

    ``how`` is ``inner`` or ``left``.  ``rows`` is read twice where there are hot keys: it should be a stored table.
    """
    hot = list(hot_keys(rows, key, total))
    if not hot:
        return rows.join(facts, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(facts.where(F.col(key).isin(hot)))  # fewer than HOT_SHARE rows
    return rows.where(~is_hot).join(facts, key, how).unionByName(rows.where(is_hot).join(few, key, how))


def split_of(hot: dict, key: str) -> Column:
    """In how many parts the rows of each key go: one, or what a hot key of :func:`hot_keys` needs."""
    many = [x for k, n in hot.items() if n > SPLIT_ROWS for x in (F.lit(k), F.lit(-(-n // SPLIT_ROWS)))]
    return F.coalesce(F.create_map(*many)[F.col(key)].cast("int"), F.lit(1)) if many else F.lit(1)


def join_split(large: DataFrame, small: DataFrame, key: str, hot: dict, spread: str) -> DataFrame:
    """Inner join of two tables on ``key``, either with many rows a key; those of ``large`` of a hot key go to many tasks.

    ``spread`` is the column of ``large`` that parts them; rows of ``small`` of a hot key are sent to all its parts.
    """
    if not hot:
        return large.join(small, key)
    parts = split_of(hot, key)
    left = large.withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int"))
    right = small.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "_part"]).drop("_part")
