"""Logistic regression on TF-IDF weights, with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .tfidf import TfIdf


def vectors(model: TfIdf, docs: DataFrame) -> DataFrame:
    """``docs(doc_id, terms, ...)`` with ``features``, an ML vector of unit-length TF-IDF weights; made in the JVM.

    The features, at most ``max_features`` of the model, come to the driver; the texts don't.
    """
    rows = model.features.orderBy("idx").select("term", "idf").collect()
    if not rows:
        return docs.withColumn("features", F.lit(None))
    counted = CountVectorizerModel.from_vocabulary([r.term for r in rows], inputCol="terms", outputCol="_counts").transform(docs)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in rows]), inputCol="_counts", outputCol="_scaled").transform(counted)
    return Normalizer(p=2.0, inputCol="_scaled", outputCol="features").transform(scaled).drop("_counts", "_scaled")


@dataclass
class Linear:
    """A fitted classifier with its TF-IDF model."""

    tfidf: TfIdf
    model: LogisticRegressionModel

    def predict(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label INT, probs MAP<STRING,DOUBLE>) of ``docs(doc_id, terms)``."""
        out = self.model.transform(vectors(self.tfidf, docs))
        p = vector_to_array("probability")
        keys = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i.cast("string"))
        return out.select("doc_id", F.col("prediction").cast("int").alias("label"), F.map_from_arrays(keys, p).alias("probs"))

    def save(self, path: str) -> None:
        self.tfidf.save(f"{path}/tfidf")
        self.model.write().overwrite().save(f"{path}/logreg")


def load(spark: SparkSession, path: str, tfidf: str | None = None) -> Linear:
    """A saved classifier; ``tfidf`` is another folder of its TF-IDF model."""
    from .tfidf import load as load_tfidf

    return Linear(load_tfidf(spark, tfidf or f"{path}/tfidf"), LogisticRegressionModel.load(f"{path}/logreg"))


def fit(tfidf: TfIdf, docs: DataFrame, c: float = 1.0, max_iter: int = 1000) -> Linear:
    """A classifier of ``docs(doc_id, terms, label)``, label 0 or 1: half the squared weights plus ``c`` times the log loss.

    The intercept isn't penalised.  Spark ML's penalty for that objective is ``1 / (c n)``, without standardisation.
    """
    data = vectors(tfidf, docs.select("doc_id", "terms", F.col("label").cast("double").alias("label"))).where("label IS NOT NULL")
    data = cut(data.select("features", "label"), "vectors")  # counted and fitted on without making them again
    n = data.count()
    learner = LogisticRegression(maxIter=max_iter, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, tol=1e-6)
    return Linear(tfidf, learner.fit(data))


def weights(model: Linear) -> list[tuple[str, float]]:
    """(term, weight) of the classifier, by feature."""
    names = [r.term for r in model.tfidf.features.orderBy("idx").collect()]
    return list(zip(names, np.asarray(model.model.coefficients.toArray()).tolist(), strict=True))
