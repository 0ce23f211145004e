"""Comparison of two classifiers on the same documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence


def timings(rows: DataFrame) -> DataFrame:
    """(model, n, total_ms, mean_ms, most_ms) of ``rows(model, time_ms)``; ``n`` counts those with a time."""
    t = F.col("time_ms")
    return rows.groupBy("model").agg(F.count(t).alias("n"), F.sum(t).alias("total_ms"), F.avg(t).alias("mean_ms"), F.max(t).alias("most_ms"))


def compare(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("naive_bayes", "knn")) -> DataFrame:
    """One row a document of either ``(doc_id, label, probs, time_ms)`` table.

    ``agree`` is null where one has no label; ``faster`` names the smaller time, the second one if equal, null if a time is
    unknown; ``difference_ms`` is its lead.  Confidences are in per cent, 0 where unknown.
    """
    side = lambda df, k: df.select("doc_id", F.col("label").alias(f"label_{k}"), confidence(F.col("probs"), F.col("label")).alias(f"confidence_{k}"), F.col("time_ms").alias(f"time_{k}"))
    both = side(first, "a").join(side(second, "b"), "doc_id", "full")
    a, b = F.col("time_a"), F.col("time_b")
    return both.select(
        "doc_id",
        "label_a",
        "label_b",
        F.coalesce("confidence_a", F.lit(0.0)).alias("confidence_a"),
        F.coalesce("confidence_b", F.lit(0.0)).alias("confidence_b"),
        (F.col("label_a") == F.col("label_b")).alias("agree"),
        F.when(a < b, names[0]).when(a >= b, names[1]).alias("faster"),
        F.round(F.abs(a - b), 6).alias("difference_ms"),
    )
