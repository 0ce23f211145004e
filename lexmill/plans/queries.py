"""One query for each operator, over the tables of a folder: ``name -> callable(spark, folder)``.

Texts are ``spam_assassin_preprocessed``, feature rows ``train_tfidf_features`` (``test_tfidf_features`` ask), labels of
three classifiers ``predictions``.  Nearest-neighbour queries ask for the test rows whose id is divisible by 20, against all
training rows.  Every query gives plain columns, so that SQL can check it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import compare, knn, metrics, nbayes, splits, tfidf, vocabulary
from ..session import cut
from ..sources import readers, writers
from . import pipeline

WIDTH = 272
K = 9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, raw_label), each id once; texts may be null."""
    rows = table(spark, folder, "spam_assassin_preprocessed").select(F.col("id").alias("doc_id"), "text", F.col("label").alias("raw_label"))
    return rows.dropDuplicates(["doc_id"])


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, label) of the texts with a label, labels as ``0`` or ``1``."""
    rows = texts(spark, folder).where("raw_label IS NOT NULL")
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), T.label_number(F.col("raw_label")).cast("string").alias("label"))


def unigrams(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", T.tokens(F.col("text")).alias("terms"))


def r6(name: str):
    return F.round(name, 6).alias(name)


# sources and sinks


@query
def load_labelled(spark, folder):
    rows = table(spark, folder, "spam_assassin").dropDuplicates(["id"])
    return readers.labelled(rows, key="id").select("doc_id", "text", "label")


@query
def load_eval(spark, folder):
    rows = table(spark, folder, "spam_assassin").dropDuplicates(["id"]).withColumnRenamed("label", "target")
    return readers.labelled(rows, readers.EVAL_TEXT, readers.EVAL_LABEL, key="id").select("doc_id", "text", "label")


@query
def parse_features(spark, folder):
    rows = readers.feature_rows(table(spark, folder, "train_tfidf_features"), width=WIDTH)
    cells = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", "label", F.size("v").alias("cells"), F.round(cells, 4).alias("total"), F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query
def jsonl_text_scan(spark, folder):
    rows = texts(spark, folder).where("text IS NOT NULL")
    wrapped = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.to_json(F.struct("text"))).otherwise(F.col("text"))
    return rows.select("doc_id", wrapped.alias("line")).where(F.col("line").rlike(r"\S")).select("doc_id", T.prediction_text(F.col("line")).alias("text"))


@query
def vocab_roundtrip(spark, folder):
    from ..session import write_shared

    path = write_shared(vocabulary.vocabulary(unigrams(corpus(spark, folder)), min_freq=2), "vocab")
    return vocabulary.load_vocabulary(spark, path)


@query
def predictions_json(spark, folder):
    """Every prediction as a JSON line of its text, label and probabilities, read again field by field; unknown texts are null."""
    rows = judged(spark, folder).join(texts(spark, folder).select("doc_id", "text"), "doc_id", "left")
    lines = writers.prediction_lines(rows.select("text", "label", "probs"))
    read = F.from_json("value", "text string, label string, probs map<string,double>")
    fields = lines.select(read.alias("x"), F.size(F.json_object_keys("value")).alias("fields"))
    return fields.select(F.col("x.text").alias("text"), F.col("x.label").alias("label"), F.round(F.col("x.probs")["0"], 6).alias("p0"), F.round(F.col("x.probs")["1"], 6).alias("p1"), "fields")


# text functions


@query
def tokenize(spark, folder):
    return texts(spark, folder).where("text IS NOT NULL").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))


@query
def tokenize_cased(spark, folder):
    rows = table(spark, folder, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", T.joined(T.tokens(F.col("text"), lowercase=False)).alias("tokens"))


@query
def tokenize_nullsafe(spark, folder):
    return texts(spark, folder).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))


@query
def bigrams(spark, folder):
    grams = T.ngrams(T.tokens(F.col("text")), 2)
    return texts(spark, folder).select("doc_id", F.explode(grams).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("cnt"))


@query
def ngrams_1_2(spark, folder):
    grams = T.ngram_range(T.tokens(F.col("text")), 1, 2)
    return texts(spark, folder).select("doc_id", grams.alias("g")).select("doc_id", F.size("g").alias("n"), F.coalesce(F.try_element_at("g", F.lit(-1)), F.lit("")).alias("last"))


@query
def tokens_joined(spark, folder):
    return texts(spark, folder).select("doc_id", T.joined(T.tokens(F.col("text"))).alias("tokens"))


@query
def label_coerce(spark, folder):
    rows = table(spark, folder, "train_tfidf_features").select("label").unionAll(table(spark, folder, "spam_assassin_preprocessed").select("label"))
    counted = rows.groupBy("label").agg(F.count("*").alias("cnt"))
    return counted.select("label", T.label_number(F.col("label")).alias("number"), T.class_label(F.col("label")).alias("class"), "cnt")


def judged(spark, folder):
    """(doc_id, model, label, probs, time_ms), each document and model once."""
    rows = table(spark, folder, "predictions").dropDuplicates(["id", "model"])
    return rows.select(F.col("id").alias("doc_id"), "model", "label", "probs", "time_ms")


@query
def proba_map(spark, folder):
    both = T.with_both_classes(F.col("probs"))
    return judged(spark, folder).select("doc_id", "model", F.round(both["0"], 6).alias("p0"), F.round(both["1"], 6).alias("p1"))


# vocabulary and counts


@query
def term_freq(spark, folder):
    return vocabulary.term_counts(unigrams(corpus(spark, folder)))


@query
def vocab_minfreq(spark, folder):
    return vocabulary.vocabulary(unigrams(corpus(spark, folder)), min_freq=2).select("term", "cnt")


@query
def vocab_topn(spark, folder):
    return vocabulary.vocabulary(unigrams(corpus(spark, folder)), max_features=500)


@query
def vocab(spark, folder):
    return vocabulary.vocabulary(unigrams(corpus(spark, folder)))


@query
def doc_counts(spark, folder):
    docs = unigrams(corpus(spark, folder))
    return vocabulary.doc_counts(docs, cut(vocabulary.vocabulary(docs, min_freq=2), "vocab"))


def sparse(spark, folder, **limits):
    docs = unigrams(corpus(spark, folder))
    return vocabulary.sparse_rows(docs, vocabulary.doc_counts(docs, cut(vocabulary.vocabulary(docs, **limits), "vocab")))


@query
def doc_sparse_map(spark, folder):
    entry = lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))
    return sparse(spark, folder, min_freq=2).select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), entry), " ").alias("counts"))


@query
def doc_dense_top20(spark, folder):
    rows = vocabulary.dense_rows(sparse(spark, folder, max_features=20), 20)
    return rows.select("doc_id", F.array_join(F.transform("row", lambda x: x.cast("string")), ",").alias("row"))


# naive Bayes


class Bayes:
    """What the naive Bayes queries share: the split, counts and fitted model of the corpus."""

    def __init__(self, spark, folder) -> None:
        docs = corpus(spark, folder)
        self.vocab = cut(vocabulary.vocabulary(unigrams(docs), min_freq=2), "vocab")
        self.counts = cut(vocabulary.doc_counts(unigrams(docs), self.vocab), "counts")
        self.split = cut(splits.stratified_split(docs.select("doc_id", "label")), "split")
        self.test = self.split.where("is_test").select("doc_id", "label")
        kept = self.split.where("NOT is_test")
        self.model = nbayes.fit(kept.select("doc_id", "label"), self.counts)
        self.test_counts = self.counts.join(self.test.select("doc_id"), "doc_id", "left_semi")

    def scores(self) -> DataFrame:
        return self.model.scores(self.test, self.test_counts)

    def found(self) -> DataFrame:
        return nbayes.predictions(self.scores())


@query
def stratified_split(spark, folder):
    return splits.stratified_split(corpus(spark, folder).select("doc_id", "label")).select("doc_id", "label", "is_test")


@query
def nb_classes(spark, folder):
    return Bayes(spark, folder).model.priors.select("label")


@query
def nb_vocab_size(spark, folder):
    return spark.createDataFrame([(Bayes(spark, folder).model.vocab_size,)], "vocab_size int")


@query
def nb_priors(spark, folder):
    return Bayes(spark, folder).model.priors.select("label", "n_docs", r6("log_prior"))


@query
def nb_feature_counts(spark, folder):
    return Bayes(spark, folder).model.counts.select("label", "idx", "cnt")


@query
def nb_log_prob(spark, folder):
    return Bayes(spark, folder).model.log_probabilities().select("label", "idx", r6("log_prob"))


@query
def nb_scores(spark, folder):
    return Bayes(spark, folder).scores().select("doc_id", "label", r6("log_score"))


@query
def nb_proba(spark, folder):
    return nbayes.probabilities(Bayes(spark, folder).scores()).select("doc_id", "label", r6("prob"))


@query
def nb_predict(spark, folder):
    return Bayes(spark, folder).found().select("doc_id", "label")


@query
def nb_predict_texts(spark, folder):
    b = Bayes(spark, folder)
    asked = table(spark, folder, "spam_assassin").select(F.col("id").alias("doc_id"), F.col("email_content").alias("text")).dropDuplicates(["doc_id"])
    found = pipeline.TextModel(b.model, b.vocab).predict(asked)
    return found.select("doc_id", "label", F.round(F.col("probs")["1"], 6).alias("p1"))


@query
def nb_predict_app(spark, folder):
    b = Bayes(spark, folder)
    asked = table(spark, folder, "documents").select("doc_id", "text")
    found = pipeline.app_prediction(asked, pipeline.TextModel(b.model, b.vocab))
    return found.select("doc_id", "label", F.round(F.col("probs")["0"], 6).alias("p0"), F.round(F.col("probs")["1"], 6).alias("p1"))


def nb_rows(spark, folder):
    b = Bayes(spark, folder)
    return b.test.join(b.found().withColumnRenamed("label", "pred"), "doc_id").select("doc_id", F.col("label").alias("true"), "pred")


@query
def nb_evaluate(spark, folder):
    return metrics.summary(nb_rows(spark, folder), "1").select(r6("accuracy"), r6("precision"), r6("recall"), r6("f1"), "n")


@query
def train_report(spark, folder):
    done = pipeline.train(corpus(spark, folder), readers.Config(min_freq=2))
    return done.report.select(r6("accuracy"), r6("precision"), r6("recall"), r6("f1"), "n", "n_classes", "vocab_size")


# nearest neighbours


def train_rows(spark, folder):
    return readers.feature_rows(table(spark, folder, "train_tfidf_features"), width=WIDTH).where("v IS NOT NULL")


def asked_rows(spark, folder):
    rows = readers.feature_rows(table(spark, folder, "test_tfidf_features"), width=WIDTH)
    return rows.where("v IS NOT NULL AND id % 20 = 0").select("id", "v")


@query
def knn_unit_vectors(spark, folder):
    cells = knn.unit_vectors(train_rows(spark, folder)).select("id", F.posexplode("v").alias("pos", "x"))
    return cells.where("x <> 0").select("id", "pos", F.round("x", 6).alias("x"))


@query
def knn_topk(spark, folder):
    found = knn.top_k(train_rows(spark, folder), asked_rows(spark, folder), K)
    return found.select("qid", "tid", F.col("rn").cast("int").alias("rn"), r6("sim"))


@query
def knn_predict(spark, folder):
    return knn.predict(train_rows(spark, folder), asked_rows(spark, folder), K).select("qid", "label")


@query
def knn_proba(spark, folder):
    return knn.predict(train_rows(spark, folder), asked_rows(spark, folder), K).select("qid", r6("p0"), r6("p1"))


@query
def knn_predict_batch(spark, folder):
    return knn.predict(train_rows(spark, folder), asked_rows(spark, folder), K).select("qid", "label", r6("p0"), r6("p1"))


@query
def knn_zero_query(spark, folder):
    zeros = table(spark, folder, "test_tfidf_features").select(F.col("row_id").alias("id")).where("id % 20 = 0").distinct()
    zeros = zeros.withColumn("v", F.array_repeat(F.lit(0.0), WIDTH))
    return knn.predict(train_rows(spark, folder), zeros, K).select("qid", "label", r6("p0"), r6("p1"))


@query
def knn_neighbour_labels(spark, folder):
    found = knn.neighbour_labels(train_rows(spark, folder), asked_rows(spark, folder), K)
    return found.select("qid", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query
def cosine_distance(spark, folder):
    rows = train_rows(spark, folder).select("id", "v")
    other = rows.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return rows.join(other, "id").select("id", F.round(V.cosine_distance(F.col("v"), F.col("w")), 6).alias("distance"))


@query
def knn_legacy_topk(spark, folder):
    found = knn.distances(knn.top_k(train_rows(spark, folder), asked_rows(spark, folder), K))
    return found.select("qid", "tid", F.col("rn").cast("int").alias("rn"), r6("distance"))


@query
def knn_legacy_predict(spark, folder):
    near = knn.top_k(train_rows(spark, folder), asked_rows(spark, folder), K)
    return knn.vote(near, K, tie="one").select("qid", "label")


# TF-IDF


def weighted(spark, folder):
    docs = cut(corpus(spark, folder).select("doc_id", tfidf.terms(F.col("text")).alias("terms")), "terms")
    return tfidf.fit(docs, min_df=5, max_features=5000), docs


@query
def tfidf_idf(spark, folder):
    return weighted(spark, folder)[0].features.select("term", "idx", "df", r6("idf"))


@query
def tfidf_weights(spark, folder):
    model, docs = weighted(spark, folder)
    return model.weights(docs).select("doc_id", "idx", r6("weight"))


@query
def knn_text(spark, folder):
    """Texts of the test split whose id is divisible by 20 are voted on by all texts of the train split, on TF-IDF weights of 5,000 1-2-grams."""
    rows = table(spark, folder, "spam_assassin_preprocessed").dropDuplicates(["id"]).where("label IS NOT NULL")
    split = F.lower(F.trim("split"))
    rows = rows.select(F.col("id").alias("doc_id"), split.alias("s"), T.label_number(F.col("label")).alias("label"), tfidf.terms(F.coalesce("text", F.lit(""))).alias("terms"))
    rows = cut(rows, "terms")
    model = tfidf.fit(rows.where("s = 'train'"), min_df=5, max_features=5000)
    vectors = pipeline.sparse_vectors(model, rows.where("s = 'train'"))
    train = cut(vectors.join(rows.select(F.col("doc_id").alias("id"), "label"), "id"), "train")
    found = pipeline.knn_prediction(rows.where("s = 'test' AND doc_id % 20 = 0"), train, model, K)
    return found.select(F.col("doc_id").alias("qid"), "label", F.round(F.col("probs")["0"], 6).alias("p0"), F.round(F.col("probs")["1"], 6).alias("p1"))


@query
def logreg_train(spark, folder):
    from ..operators import linear

    model, _ = pipeline.train_linear(corpus(spark, folder))
    return spark.createDataFrame(linear.weights(model), "term string, weight double")


@query
def logreg_optimal(spark, folder):
    """(n, features, flat): training texts and features, and whether the fitted weights are the optimum.

    The gradient of half the squared weights plus the log loss is worked out here from weights and probabilities; ``flat``
    is whether no part of it, the intercept's included, is above 0.0001 a training text.
    """
    from ..operators import linear

    rows = corpus(spark, folder).where("label IN ('0', '1')")
    model, _ = pipeline.train_linear(rows)
    split = splits.stratified_split(rows).where("NOT is_test")
    docs = cut(split.select("doc_id", F.col("label").cast("double").alias("y"), tfidf.terms(F.col("text")).alias("terms")), "terms")
    miss = cut(docs.select("doc_id", "y").join(model.predict(docs.select("doc_id", "terms")), "doc_id").select("doc_id", (F.col("probs")["1"] - F.col("y")).alias("e")), "misses")
    slope = model.tfidf.weights(docs).join(miss, "doc_id").groupBy("idx").agg(F.sum(F.col("weight") * F.col("e")).alias("g"))
    weights = spark.createDataFrame([(i, w) for i, (_, w) in enumerate(linear.weights(model))], "idx int, w double")
    full = weights.join(slope, "idx", "left").agg(F.count("*").alias("features"), F.max(F.abs(F.col("w") + F.coalesce("g", F.lit(0.0)))).alias("most"))
    return miss.agg(F.count("*").alias("n"), F.abs(F.sum("e")).alias("free")).crossJoin(full).select("n", "features", (F.greatest("most", "free") <= 1e-4 * F.col("n")).alias("flat"))  # one row each


@query
def logreg_predict(spark, folder):
    _, found = pipeline.train_linear(corpus(spark, folder))
    return found.select("doc_id", "true", "pred", F.round(F.col("probs")["1"], 6).alias("p1"))


@query
def logreg_evaluate(spark, folder):
    _, found = pipeline.train_linear(corpus(spark, folder))
    return metrics.summary(found, "1").select(r6("accuracy"), r6("precision"), r6("recall"), r6("f1"), "n")


# metrics and comparison


def judged_rows(spark, folder):
    """(model, true, pred) of the classified documents with a label."""
    true = corpus(spark, folder).select("doc_id", F.col("label").alias("true"))
    return judged(spark, folder).join(true, "doc_id").select("doc_id", "model", "true", F.col("label").alias("pred"))


@query
def accuracy(spark, folder):
    return knn.accuracy(judged_rows(spark, folder), F.col("true"), F.col("pred"), ("model",)).select("model", r6("accuracy"))


@query
def metrics_summary(spark, folder):
    return metrics.summary(judged_rows(spark, folder), "1", ["model"]).select("model", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"), "n")


@query
def metrics_macro(spark, folder):
    return metrics.macro(judged_rows(spark, folder), ["model"]).select("model", r6("precision"), r6("recall"), r6("f1"))


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(judged_rows(spark, folder), ["model"])


@query
def classification_report(spark, folder):
    return metrics.report(judged_rows(spark, folder), ["model"]).select("model", "row", r6("precision"), r6("recall"), r6("f1"), "support")


@query
def nb_knn_agreement(spark, folder):
    rows = judged(spark, folder)
    of = lambda m: rows.where(F.col("model") == m)
    return compare.compare(of("naive_bayes"), of("knn"))


@query
def algorithm_times(spark, folder):
    rows = compare.timings(judged(spark, folder).select("model", "time_ms"))
    return rows.select("model", "n", F.round("total_ms", 3).alias("total_ms"), F.round("mean_ms", 3).alias("mean_ms"), F.round("most_ms", 3).alias("most_ms"))


@query
def confidence_pct(spark, folder):
    return judged(spark, folder).select("doc_id", "model", T.confidence(F.col("probs"), F.col("label")).alias("confidence"))
