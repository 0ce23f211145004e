"""Multinomial naive Bayes on sparse counts (doc_id, idx, cnt)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import SMALL_ROWS, is_small
from .vocabulary import doc_counts


def log(x: Column) -> Column:
    """Natural logarithm with minus infinity, not null, at 0."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))


@dataclass
class NaiveBayes:
    """A fitted model: ``priors(label, n_docs, log_prior)``, ``cells(idx, logs ARRAY<DOUBLE>)`` by class order, ``totals(label, terms)``."""

    alpha: float
    classes: list[str]
    vocab_size: int
    priors: DataFrame
    counts: DataFrame
    totals: dict[str, int]

    def denominator(self, label: str) -> float:
        return self.totals.get(label, 0) + self.alpha * max(1, self.vocab_size)

    def log_probabilities(self) -> DataFrame:
        """(label, idx, cnt, log_prob) of the cells that were counted; see :meth:`default_logs` for the rest."""
        below = F.create_map(*[F.lit(x) for c in self.classes for x in (c, float(self.denominator(c)))])
        return self.counts.select("label", "idx", "cnt", log((F.col("cnt") + self.alpha) / below[F.col("label")]).alias("log_prob"))

    def default_logs(self) -> list[float]:
        """The log probability of a cell that was never counted, by class."""
        import math

        return [math.log(self.alpha / self.denominator(c)) if self.alpha > 0 else float("-inf") for c in self.classes]

    def scores(self, docs: DataFrame, counts: DataFrame) -> DataFrame:
        """(doc_id, label, log_score) of every document of ``docs(doc_id)`` and class; without a known term it is the prior.

        The table of cells has a row per term with all classes, so that documents' terms are joined once.
        """
        known = counts.where((F.col("idx") >= 0) & (F.col("idx") < self.vocab_size))
        logs = self.log_probabilities().groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("label", "log_prob"))).alias("m"))  # one entry a class
        if self.vocab_size <= SMALL_ROWS:  # a row of as many numbers as there are classes for each term
            logs = F.broadcast(logs)
        joined = known.join(logs, "idx", "left")
        return self._summed(docs, joined, F.col("cnt"))

    def _summed(self, docs: DataFrame, joined: DataFrame, times: Column) -> DataFrame:
        defaults = self.default_logs()
        value = lambda i, c: F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(defaults[i]))
        sums = joined.groupBy("doc_id").agg(*(F.sum(times * value(i, c)).alias(f"s{i}") for i, c in enumerate(self.classes)))
        full = docs.select("doc_id").join(sums, "doc_id", "left")
        prior = {r.label: r.log_prior for r in self.priors.collect()}
        scored = [F.struct(F.lit(c).alias("label"), (F.lit(prior[c]) + F.coalesce(F.col(f"s{i}"), F.lit(0.0))).alias("log_score")) for i, c in enumerate(self.classes)]
        return full.select("doc_id", F.inline(F.array(*scored)))

    def scores_of_terms(self, docs: DataFrame, vocab: DataFrame) -> DataFrame:
        """:meth:`scores` of ``docs(doc_id, terms)`` under a stored ``vocab(term, idx)``.

        Terms and their logs are sent to the documents where they are small enough: then a document's terms meet in one
        aggregation, begun where the document lies, and are never counted apart.
        """
        if not is_small(vocab, "term"):
            return self.scores(docs, doc_counts(docs, vocab))
        logs = self.log_probabilities().groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("label", "log_prob"))).alias("m"))  # one entry a class
        table = vocab.where((F.col("idx") >= 0) & (F.col("idx") < self.vocab_size)).select("term", "idx").join(logs, "idx", "left").select("term", "m")
        found = docs.select("doc_id", F.explode("terms").alias("term")).join(F.broadcast(table), "term")
        return self._summed(docs, found, F.lit(1))

    def predict(self, docs: DataFrame, counts: DataFrame) -> DataFrame:
        """(doc_id, label, probs MAP<STRING,DOUBLE>); the first class in order wins a tie.  One plan gives both."""
        return predictions(self.scores(docs, counts))

    def save(self, path: str) -> None:
        spark = self.priors.sparkSession
        self.priors.write.mode("overwrite").parquet(f"{path}/priors")
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        totals = [(c, int(self.totals.get(c, 0))) for c in self.classes]
        spark.createDataFrame([(float(self.alpha), int(self.vocab_size), totals)], META).write.mode("overwrite").parquet(f"{path}/meta")


META = "alpha double, vocab_size int, totals array<struct<label:string,terms:bigint>>"


def load(spark: SparkSession, path: str) -> NaiveBayes:
    """A saved model; TypeError if the folder holds something else."""
    try:
        meta = spark.read.parquet(f"{path}/meta").select("alpha", "vocab_size", "totals").first()
        priors, counts = spark.read.parquet(f"{path}/priors"), spark.read.parquet(f"{path}/counts")
    except Exception as e:
        raise TypeError(f"{path} holds no naive Bayes model: {e}") from e
    return NaiveBayes(meta.alpha, [t.label for t in meta.totals], meta.vocab_size, priors, counts, {t.label: t.terms for t in meta.totals})


def probabilities(scores: DataFrame) -> DataFrame:
    """(doc_id, label, log_score, prob): softmax of the scores; uniform where no class is possible."""
    w = Window.partitionBy("doc_id")
    most = F.max("log_score").over(w)
    e = F.when(most == float("-inf"), F.lit(0.0)).otherwise(F.exp(F.col("log_score") - most))
    shares = scores.withColumn("_e", e)
    total = F.sum("_e").over(w)
    return shares.select("doc_id", "label", "log_score", F.when(total > 0, F.col("_e") / total).otherwise(1 / F.count("*").over(w)).alias("prob"))


def predictions(scores: DataFrame) -> DataFrame:
    """(doc_id, label, probs) from scores, by one aggregation a document."""
    rows = probabilities(scores)
    best = F.expr("min_by(label, struct(-log_score, label))")
    return rows.groupBy("doc_id").agg(best.alias("label"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "prob")))).alias("probs"))


def fit(labels: DataFrame, counts: DataFrame, alpha: float = 1.0) -> NaiveBayes:
    """A model of ``labels(doc_id, label)`` and their ``counts``; documents with a null label are left out.

    The number of features is the largest index that occurs plus one.  Priors aren't smoothed.
    """
    labels = labels.where("label IS NOT NULL")
    per_class = labels.groupBy("label").agg(F.count("*").alias("n_docs"))
    found = per_class.orderBy("label").collect()  # one row a class
    total = sum(r.n_docs for r in found) or 1
    priors = per_class.select("label", "n_docs", log(F.col("n_docs") / total).alias("log_prior"))
    cells = counts.join(labels.select("doc_id", "label"), "doc_id").where("idx >= 0").groupBy("label", "idx").agg(F.sum("cnt").alias("cnt"))
    sums = cells.groupBy("label").agg(F.sum("cnt").alias("terms"), F.max("idx").alias("top")).collect()
    size = max((r.top for r in sums), default=-1) + 1
    return NaiveBayes(float(alpha), [r.label for r in found], size, priors, cells, {r.label: int(r.terms) for r in sums})
