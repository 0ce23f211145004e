"""TF-IDF weights on sparse counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .joins import is_small
from .ranking import dense_index

#: Common English function words; another list can be given wherever this one is the default.
STOP_WORDS = tuple("""a about above after again against all am an and any are as at be because been before being below between both but by
could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself
just me more most my myself no nor not now of off on once only or other our ours out over own same she should so some such than that the their
theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with
would you your yours""".split())


def terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, low: int = 1, high: int = 2) -> Column:
    """n-grams of a text's words, stop words taken out first."""
    kept = F.filter(T.words(text), lambda w: ~w.isin(list(stop_words))) if stop_words else T.words(text)
    return T.ngram_range(kept, low, high)


@dataclass
class TfIdf:
    """A fitted model: ``features(term, idx, df, idf)``, in alphabetical order, of ``n_docs`` documents."""

    features: DataFrame
    n_docs: int

    def weights(self, docs: DataFrame) -> DataFrame:
        """(doc_id, idx, weight): counts times idf, each document scaled to length 1; no row for documents without a known term."""
        terms = docs.select("doc_id", F.explode("terms").alias("term"))
        features = self.features.select("term", "idx", "idf")
        if is_small(features, "term"):
            raw = terms.join(F.broadcast(features), "term").groupBy("doc_id", "idx").agg((F.count("*") * F.first("idf")).alias("w"))
        else:
            counts = terms.groupBy("doc_id", "term").agg(F.count("*").alias("cnt"))
            raw = counts.join(features, "term").select("doc_id", "idx", (F.col("cnt") * F.col("idf")).alias("w"))
        # one aggregation gives a document's cells, at most one a feature, and their length
        rows = raw.groupBy("doc_id").agg(F.collect_list(F.struct("idx", "w")).alias("cells"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
        return rows.select("doc_id", "length", F.inline("cells")).select("doc_id", "idx", (F.col("w") / F.col("length")).alias("weight"))

    def save(self, path: str) -> None:
        self.features.withColumn("n_docs", F.lit(self.n_docs)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> TfIdf:
    rows = spark.read.parquet(path)
    first = rows.select("n_docs").first()
    return TfIdf(rows.drop("n_docs"), first.n_docs if first else 0)


def fit(docs: DataFrame, min_df: int = 5, max_features: int | None = 5000) -> TfIdf:
    """A model of ``docs(doc_id, terms)``: terms in at least ``min_df`` documents, the ``max_features`` most frequent ones.

    Equal frequencies are decided by the term.  ``idf = ln((1 + n) / (1 + df)) + 1`` with n documents, also empty ones.
    """
    n = docs.count()
    per_doc = docs.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("c"))
    kept = per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("tf")).where(F.col("df") >= min_df)
    if max_features is not None:
        kept = kept.orderBy(F.desc("tf"), "term").limit(max_features)
    ranked = dense_index(kept, "idx", F.col("term"))
    features = ranked.select("term", F.col("idx").cast("int").alias("idx"), "df", (F.ln((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    return TfIdf(cut(features, "features"), n)
