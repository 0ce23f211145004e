"""Classification metrics of ``(true, pred)`` rows, for each group of optional columns ``by``.

Labels are compared as texts; a row whose true or predicted label is null isn't counted.  A ratio without cases is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of (true, pred): all metrics follow from these few rows."""
    kept = rows.where(F.col("true").isNotNull() & F.col("pred").isNotNull())
    return kept.groupBy(*by, F.col("true").cast("string").alias("true"), F.col("pred").cast("string").alias("pred")).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_matrix(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., true, pred, n) for all pairs of labels seen, sorted union of true and predicted ones, 0 where none."""
    by = by or []
    pairs = _pairs(rows, by)
    labels = pairs.select(*by, F.explode(F.array("true", "pred")).alias("label")).groupBy(*by).agg(F.collect_set("label").alias("l"))  # a row a group
    grid = labels.select(*by, F.col("l"), F.explode("l").alias("true")).select(*by, "true", F.explode("l").alias("pred"))
    return grid.join(pairs, [*by, "true", "pred"], "left").select(*by, "true", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., label, precision, recall, f1, support) for every label seen."""
    by = by or []
    pairs = _pairs(rows, by)
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    sides = pairs.select(*by, F.explode(F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), hit.cast("long").alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return sums.select(*by, "label", _ratio(F.col("h"), F.col("p")).alias("precision"), _ratio(F.col("h"), F.col("t")).alias("recall"), _ratio(2 * F.col("h"), F.col("p") + F.col("t")).alias("f1"), F.col("t").alias("support"))


def _accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    return _pairs(rows, by).groupBy(*by).agg((F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def macro(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., precision, recall, f1): unweighted means over the labels."""
    by = by or []
    return per_class(rows, by).groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def summary(rows: DataFrame, pos_label: str | None = "spam", by: list[str] | None = None) -> DataFrame:
    """(by..., accuracy, precision, recall, f1, n): of ``pos_label`` if it is one of exactly two labels, else macro means."""
    if not by:
        return summary(rows.withColumn("_all", F.lit(0)), pos_label, ["_all"]).drop("_all")
    each = per_class(rows, by)
    stats = each.groupBy(*by).agg(F.count("*").alias("labels"), *(f(c).alias(f"{k}_{c}") for c in ("precision", "recall", "f1") for k, f in (("macro", F.avg), ("pos", lambda c: F.max(F.when(F.col("label") == F.lit(pos_label), F.col(c)))))))
    binary = (F.col("labels") == 2) & F.col("pos_f1").isNotNull()
    chosen = [F.when(binary, F.col(f"pos_{c}")).otherwise(F.col(f"macro_{c}")).alias(c) for c in ("precision", "recall", "f1")]
    picked = stats.select(*by, *chosen)
    return _accuracy(rows, by).join(picked, by).select(*by, "accuracy", "precision", "recall", "f1", "n")


def report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., row, precision, recall, f1, support): every label, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    by = by or []
    each = per_class(rows, by)
    total = F.sum("support")
    mean = each.groupBy(*by).agg(F.lit("macro avg").alias("row"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), total.alias("support"))
    weighted = each.groupBy(*by).agg(F.lit("weighted avg").alias("row"), *(_ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in ("precision", "recall", "f1")), total.alias("support"))
    overall = _accuracy(rows, by).select(*by, F.lit("accuracy").alias("row"), *(F.col("accuracy").alias(c) for c in ("precision", "recall", "f1")), F.col("n").alias("support"))
    return each.withColumnRenamed("label", "row").unionByName(mean).unionByName(weighted).unionByName(overall)
