"""Training, evaluation and prediction from end to end."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import knn, linear, metrics, nbayes, splits, tfidf, vocabulary
from ..session import cut
from ..sources.readers import Config, read_features

#: A preprocessor turns a text column and the lower-case flag into an array of tokens.
Preprocess = Callable[[Column, bool], Column]


@dataclass
class TextModel:
    """A naive Bayes model with the vocabulary and settings it reads texts by."""

    bayes: nbayes.NaiveBayes
    vocab: DataFrame
    ngram_range: tuple[int, int] = (1, 1)
    lowercase: bool = True
    preprocess: Preprocess = T.tokens

    def terms(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", T.ngram_range(T.lowered(self.preprocess(F.col("text"), self.lowercase), self.lowercase), *self.ngram_range).alias("terms"))

    def predict(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, label, probs) of ``docs(doc_id, text)``; empty and null texts are decided by the prior."""
        found = nbayes.predictions(self.bayes.scores_of_terms(self.terms(docs), self.vocab))
        return docs.select("doc_id", "text").join(found, "doc_id")

    def save(self, path: str) -> None:
        self.bayes.save(f"{path}/nb_model")
        vocabulary.save_vocabulary(self.vocab, f"{path}/vocab")


def python_preprocessor(tokenize: Callable[[str, bool], list[str]]) -> Preprocess:
    """A preprocessor of a plain Python function of a text and the lower-case flag; null texts have no tokens.

    It runs on Arrow batches outside the JVM: a function of columns is faster where there is one.
    """

    @F.pandas_udf("array<string>")
    def run(text: pd.Series, lowercase: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [str(x) for x in tokenize(t, bool(low))] for t, low in zip(text, lowercase, strict=True)], dtype=object)

    return lambda text, lowercase: run(text, F.lit(lowercase))


def _present(path: str) -> str:
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def load_text_model(spark: SparkSession, path: str, ngram_range: tuple[int, int] = (1, 1), lowercase: bool = True, vocab: str | None = None) -> TextModel:
    """A saved model; FileNotFoundError if model or vocabulary are missing, TypeError if they are something else.

    ``vocab`` is another folder of the vocabulary.
    """
    model, words = _present(f"{path}/nb_model"), _present(vocab or f"{path}/vocab")
    return TextModel(nbayes.load(spark, model), vocabulary.load_vocabulary(spark, words), ngram_range, lowercase)


def load_bayes(spark: SparkSession, *paths: str) -> tuple[nbayes.NaiveBayes | None, DataFrame | None, str | None]:
    """(model, vocabulary, error) of the first of ``paths`` that holds a model; nothing is raised.

    The vocabulary is None where the model has none; without any model the error says what was wrong with each path.
    """
    errors = []
    for path in paths:
        try:
            model = nbayes.load(spark, _present(f"{path}/nb_model"))
        except (FileNotFoundError, TypeError) as e:
            errors.append(str(e))
            continue
        try:
            vocab = vocabulary.load_vocabulary(spark, _present(f"{path}/vocab"))
        except (FileNotFoundError, AnalysisException):
            vocab = None
        return model, vocab, None
    return None, None, "; ".join(errors) or "no path to a model"


def load_knn(spark: SparkSession, path: str, n_features: int | None = None, has_header: bool = True) -> tuple[DataFrame | None, str | None]:
    """(index, error): the training rows of a file of features, scaled to length 1 and stored once; nothing is raised."""
    try:
        rows = read_features(spark, _present(path), n_features, has_header)
        return cut(knn.unit_vectors(rows), "index"), None
    except (FileNotFoundError, AnalysisException) as e:
        return None, str(e)


@dataclass
class Models:
    """Everything the comparison needs; what couldn't be loaded is None and has its reason in ``errors``."""

    bayes: TextModel | None
    linear: linear.Linear | None
    knn: DataFrame | None
    errors: dict[str, str]


_loaded: dict[tuple, Models] = {}


def load_models(spark: SparkSession, bayes: tuple[str, ...], linear_path: str | None = None, features: str | None = None, n_features: int | None = None) -> Models:
    """Naive Bayes of the first good path, the regression and the index of neighbours, loaded once a session and set of paths."""
    key = (spark.sparkContext.applicationId, bayes, linear_path, features, n_features)
    if key not in _loaded:
        errors = {}
        model, vocab, errors["bayes"] = load_bayes(spark, *bayes)
        text = TextModel(model, vocab) if model is not None and vocab is not None else None
        if model is not None and vocab is None:
            errors["bayes"] = "the model has no vocabulary"
        weighted = None
        if linear_path is not None:
            try:
                weighted = linear.load(spark, _present(linear_path))
            except Exception as e:  # what Spark ML raises for a folder it can't read differs by what is wrong
                errors["linear"] = str(e)
        index = None
        if features is not None:
            index, errors["knn"] = load_knn(spark, features, n_features)
        _loaded[key] = Models(text, weighted, index, {k: v for k, v in errors.items() if v})
    return _loaded[key]


@dataclass
class Trained:
    model: TextModel
    split: DataFrame
    predictions: DataFrame
    report: DataFrame


def train(corpus: DataFrame, config: Config = Config(), preprocess: Preprocess = T.tokens) -> Trained:
    """A model of ``corpus(doc_id, text, label)`` and its report on the held-out share.

    The vocabulary is taken from all documents before the split, the number of features from the training part only.
    """
    docs = corpus.select("doc_id", T.ngram_range(T.lowered(preprocess(F.col("text"), config.lowercase), config.lowercase), *config.ngram_range).alias("terms"))
    vocab = cut(vocabulary.vocabulary(docs, config.min_freq, config.max_features), "vocab")
    counts = cut(vocabulary.doc_counts(docs, vocab), "counts")
    split = cut(splits.stratified_split(corpus.select("doc_id", "label"), test_size=config.test_size, seed=config.random_seed), "split")
    bayes = nbayes.fit(split.where("NOT is_test"), counts.join(split.where("NOT is_test").select("doc_id"), "doc_id", "left_semi"), config.alpha)
    model = TextModel(bayes, vocab, config.ngram_range, config.lowercase, preprocess)
    test = split.where("is_test")
    found = bayes.predict(test, counts.join(test.select("doc_id"), "doc_id", "left_semi"))
    rows = test.join(found.withColumnRenamed("label", "pred"), "doc_id").select("doc_id", F.col("label").alias("true"), "pred", "probs")
    extra = corpus.agg(F.count_distinct("label").alias("n_classes")).withColumn("vocab_size", vocab.agg(F.count("*")).scalar())
    report = metrics.summary(rows, config.pos_label).withColumn("n_classes", extra.select("n_classes").scalar()).withColumn("vocab_size", extra.select("vocab_size").scalar())
    return Trained(model, split, rows, report)


def evaluate(model: TextModel, corpus: DataFrame) -> DataFrame:
    """(doc_id, text, true, pred, probs) of ``corpus(doc_id, text, label)``; feed it to :mod:`lexmill.operators.metrics`."""
    found = model.predict(corpus).withColumnRenamed("label", "pred")
    return corpus.select("doc_id", F.col("label").cast("string").alias("true")).join(found, "doc_id").select("doc_id", "text", "true", F.col("pred").cast("string").alias("pred"), "probs")


def train_linear(corpus: DataFrame, low: int = 1, high: int = 2, min_df: int = 5, max_features: int = 5000, c: float = 1.0, test_size: float = 0.2, seed: int = 42, stop_words: tuple[str, ...] = tfidf.STOP_WORDS) -> tuple[linear.Linear, DataFrame]:
    """(model, (doc_id, true, pred, probs) of the held-out share) for ``corpus(doc_id, text, label)`` of labels 0 and 1."""
    split = splits.stratified_split(corpus, test_size=test_size, seed=seed)
    docs = cut(split.select("doc_id", "label", "is_test", tfidf.terms(F.col("text"), stop_words, low, high).alias("terms")), "terms")
    weights = tfidf.fit(docs.where("NOT is_test"), min_df, max_features)
    model = linear.fit(weights, docs.where("NOT is_test"), c)
    found = model.predict(docs.where("is_test")).withColumnRenamed("label", "pred")
    return model, docs.where("is_test").join(found, "doc_id").select("doc_id", F.col("label").alias("true"), F.col("pred").cast("string").alias("pred"), "probs")


def app_prediction(docs: DataFrame, model: TextModel | None, fallback: linear.Linear | None = None) -> DataFrame:
    """(doc_id, label INT, probs, error) as the comparison shows it: labels 0 and 1, both classes in ``probs``.

    Without a model there is an error; with an empty vocabulary the fallback decides, if there is one.
    """
    none = F.create_map(F.lit("0"), F.lit(0.0), F.lit("1"), F.lit(0.0))
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("int").alias("label"), none.alias("probs"), F.lit("NB model not loaded").alias("error"))
    if fallback is not None and model.vocab.isEmpty():
        terms = docs.select("doc_id", tfidf.terms(F.col("text")).alias("terms"))
        found = fallback.predict(terms)
        return found.select("doc_id", "label", T.with_both_classes(F.col("probs")).alias("probs"), F.lit(None).cast("string").alias("error"))
    found = model.predict(docs)
    return found.select("doc_id", T.class_label(F.col("label")).alias("label"), T.with_both_classes(F.col("probs")).alias("probs"), F.lit(None).cast("string").alias("error"))


def text_vectors(model: tfidf.TfIdf, docs: DataFrame, width: int) -> DataFrame:
    """(id, v ARRAY<DOUBLE>) of ``docs(doc_id, terms)``: dense TF-IDF weights, all zeros without a known term."""
    cells = model.weights(docs).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"))  # at most one a feature
    row = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return docs.select("doc_id").join(cells, "doc_id", "left").select(F.col("doc_id").alias("id"), row.alias("v"))


def sparse_vectors(model: tfidf.TfIdf, docs: DataFrame) -> DataFrame:
    """(id, at ARRAY<INT>, v ARRAY<DOUBLE>) of ``docs(doc_id, terms)``: the TF-IDF weights that aren't 0 and their features."""
    cells = model.weights(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("c"))  # at most one a feature
    part = lambda name, kind: F.coalesce(F.col(f"c.{name}"), F.array().cast(kind))
    return docs.select("doc_id").join(cells, "doc_id", "left").select(F.col("doc_id").alias("id"), part("idx", "array<int>").alias("at"), part("weight", "array<double>").alias("v"))


def knn_prediction(docs: DataFrame, train: DataFrame | None, model: tfidf.TfIdf | None, k: int = 9, tie: str = "nearest") -> DataFrame | None:
    """(doc_id, label INT, probs, error) of ``docs(doc_id, terms)`` by the nearest of ``train(id, v, label)``, or sparse ``train(id, at, v, label)``.

    None without training rows to search in; an error in each row without a TF-IDF model to read the texts by.
    """
    if train is None:
        return None
    if model is None:
        none = F.create_map(F.lit("0"), F.lit(0.0), F.lit("1"), F.lit(0.0))
        return docs.select("doc_id", F.lit(None).cast("int").alias("label"), none.alias("probs"), F.lit("TF-IDF vectorizer required for KNN").alias("error"))
    if "at" in train.columns:
        asked = sparse_vectors(model, docs)
    else:
        asked = text_vectors(model, docs, train.select(F.size("v").alias("n")).agg(F.max("n")).first()[0] or 0)
    found = knn.predict(train, asked, k, tie)
    probs = F.create_map(F.lit("0"), F.col("p0"), F.lit("1"), F.col("p1"))
    return found.select(F.col("qid").alias("doc_id"), "label", probs.alias("probs"), F.lit(None).cast("string").alias("error"))
