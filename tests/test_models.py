"""Naive Bayes, nearest neighbours, TF-IDF, regression and metrics: fixtures F5 to F9."""

import math

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import vectors as V
from lexmill.operators import compare, knn, linear, metrics, nbayes, tfidf, vocabulary
from lexmill.plans.pipeline import TextModel, app_prediction, knn_prediction, load_text_model, text_vectors, train, train_linear
from lexmill.sources.readers import Config

MAILS = [(0, "buy cheap meds", "spam"), (1, "cheap cheap buy", "spam"), (2, "hello how are you", "ham"), (3, "good morning friend", "ham")]


def fitted(spark, mails=MAILS, alpha=1.0):
    rows = spark.createDataFrame(mails, "doc_id long, text string, label string")
    docs = rows.select("doc_id", T.tokens(F.col("text")).alias("terms"))
    vocab = vocabulary.vocabulary(docs)
    return TextModel(nbayes.fit(rows, vocabulary.doc_counts(docs, vocab), alpha), vocab)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_naive_bayes_golden(spark):
    model = fitted(spark)
    assert (model.bayes.classes, model.bayes.vocab_size) == (["ham", "spam"], 10)
    docs = asked(spark, "buy cheap", "good morning", "", "unknown words", None)
    scores = {(r.doc_id, r.label): r.log_score for r in model.bayes.scores(docs, vocabulary.doc_counts(model.terms(docs), model.vocab)).collect()}
    assert scores[0, "ham"] == pytest.approx(-6.35957387) and scores[0, "spam"] == pytest.approx(-3.75341798)
    assert scores[1, "ham"] == pytest.approx(-4.97327951) and scores[2, "spam"] == pytest.approx(math.log(0.5))
    found = {r.doc_id: r for r in model.predict(docs).collect()}
    assert [found[i].label for i in range(5)] == ["spam", "ham", "ham", "ham", "ham"]
    assert found[0].probs["spam"] == pytest.approx(0.93125671)
    assert all(sum(r.probs.values()) == pytest.approx(1) for r in found.values())


def test_prior_is_not_smoothed(spark):
    model = fitted(spark, [(0, "a", "spam"), (1, "b", "spam"), (2, "c", "ham"), (3, "d", None)])
    assert {r.label: round(r.log_prior, 6) for r in model.bayes.priors.collect()} == {"ham": -1.098612, "spam": -0.405465}


def test_impossible_classes_are_uniform(spark):
    model = fitted(spark, [(0, "a", "x"), (1, "b", "y")], alpha=0.0)
    found = model.predict(asked(spark, "a b")).first()
    assert found.label == "x" and found.probs == {"x": 0.5, "y": 0.5}


def test_model_round_trip(spark, tmp_path):
    model = fitted(spark)
    model.save(str(tmp_path))
    again = load_text_model(spark, str(tmp_path))
    assert again.predict(asked(spark, "buy cheap")).first().probs == model.predict(asked(spark, "buy cheap")).first().probs
    with pytest.raises(FileNotFoundError):
        load_text_model(spark, str(tmp_path / "none"))
    with pytest.raises(TypeError):
        nbayes.load(spark, str(tmp_path / "vocab"))


def test_app_prediction(spark):
    docs = asked(spark, "buy cheap")
    assert app_prediction(docs, None).first().error == "NB model not loaded"
    row = app_prediction(docs, fitted(spark)).first()
    assert row.label == 1 and row.error is None and set(row.probs) == {"0", "1", "ham", "spam"}


TRAIN = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 1.0], 0), (3, [0.0, 2.0], 0), (4, [0.0, 0.0], 1)]


def test_knn_golden(spark):
    train = spark.createDataFrame(TRAIN, "id long, v array<double>, label int")
    ask = spark.createDataFrame([(0, [2.0, 0.0]), (1, [1.0, 3.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "id long, v array<double>")
    near = lambda k, q: [(r.tid, round(r.sim, 6)) for r in knn.top_k(train, ask.where(f"id = {q}"), k).orderBy("rn").collect()]
    assert near(2, 0) == [(0, 1.0), (1, 0.707107)]
    assert near(3, 1) == [(2, 0.948683), (3, 0.948683), (1, 0.894427)]
    assert near(4, 2) == [(2, 1.0), (3, 1.0), (1, 0.707107), (0, 0.0)]
    assert len(near(9, 0)) == 5
    found = {r.qid: (r.label, round(r.p0 + r.p1, 6)) for r in knn.predict(train, ask, 3).collect()}
    assert found[1] == (0, 0.666667) and found[3] == (1, 1.0) and 4 not in found
    assert knn.predict(train, ask.where("id = 2"), 4).first().label == 0
    assert knn.predict(train, ask.where("id = 2"), 4, tie="one").first().label == 1
    assert knn.predict(train, ask.where("id = 0"), 9).first().p1 == pytest.approx(3 / 9)
    assert knn.neighbour_labels(train, ask.where("id = 3"), 3).first().labels == [1, 1, 0]
    assert knn.predict(train.limit(0), ask, 3).count() == 0


def test_knn_blocks_give_the_same(spark, monkeypatch):
    rows = spark.range(60).select("id", F.array(*(F.sin(F.col("id") * j) for j in range(1, 5))).alias("v"), (F.col("id") % 2).cast("int").alias("label"))
    whole = sorted(map(str, knn.top_k(rows, rows, 4).collect()))
    monkeypatch.setattr(knn, "BLOCK", 7)
    assert sorted(map(str, knn.top_k(rows, rows, 4).collect())) == whole


def test_cosine_distance(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0], [3.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


def test_tfidf_golden(spark):
    rows = asked(spark, "buy cheap meds", "cheap meds available", "hello friend")
    docs = rows.select("doc_id", T.words(F.col("text")).alias("terms"))
    model = tfidf.fit(docs, min_df=1)
    idf = {r.term: round(r.idf, 6) for r in model.features.collect()}
    assert idf["cheap"] == idf["meds"] == 1.287682 and idf["buy"] == 1.693147
    names = {r.idx: r.term for r in model.features.collect()}
    assert [names[i] for i in range(len(names))] == sorted(names.values())
    first = {names[r.idx]: round(r.weight, 6) for r in model.weights(docs).where("doc_id = 0").collect()}
    assert first == {"buy": 0.680919, "cheap": 0.517856, "meds": 0.517856}
    same = linear.vectors(model, docs).where("doc_id = 0").first().features.toArray()
    assert sorted(round(x, 6) for x in same if x) == [0.517856, 0.517856, 0.680919]


def test_logistic_regression_learns(spark, tmp_path):
    rows = [(i, ("cheap offer now win prize " if i % 2 else "meeting agenda for the project ") + f"word{i % 7}", str(i % 2)) for i in range(60)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model, found = train_linear(corpus, min_df=2)
    assert metrics.summary(found, "1").first().accuracy == 1.0
    model.save(str(tmp_path / "m"))
    docs = corpus.select("doc_id", tfidf.terms(F.col("text")).alias("terms"))
    assert linear.load(spark, str(tmp_path / "m")).predict(docs).where("doc_id = 1").first().label == 1


def test_metrics_golden(spark):
    rows = spark.createDataFrame(list(zip("1111000000", "1100100000", strict=True)) + [(None, "1")], "true string, pred string")
    s = metrics.summary(rows, "1").first()
    assert (s.accuracy, round(s.precision, 6), s.recall, round(s.f1, 6), s.n) == (0.7, 0.666667, 0.5, 0.571429, 10)
    m = metrics.summary(rows, "spam").first()
    assert tuple(round(x, 6) for x in (m.precision, m.recall, m.f1)) == (0.690476, 0.666667, 0.670330)
    assert {(r.true, r.pred): r.n for r in metrics.confusion_matrix(rows).collect()} == {("0", "0"): 5, ("0", "1"): 1, ("1", "0"): 2, ("1", "1"): 2}
    report = {r.row: r for r in metrics.report(rows).collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"} and report["0"].support == 6
    assert metrics.confusion_matrix(rows.limit(0)).count() == 0


def test_compare(spark):
    schema = "doc_id long, label string, probs map<string,double>, time_ms double"
    a = spark.createDataFrame([(1, "1", {"1": 0.9}, 2.0), (2, "0", None, 1.0), (3, None, None, None)], schema)
    b = spark.createDataFrame([(1, "1", {"1": 0.5}, 2.0), (2, "1", {"1": 1.0}, 3.0)], schema)
    got = {r.doc_id: r for r in compare.compare(a, b).collect()}
    assert got[1].agree and got[1].faster == "knn" and got[1].difference_ms == 0.0
    assert not got[2].agree and got[2].faster == "naive_bayes" and got[2].confidence_a == 0.0
    assert got[3].agree is None and got[3].faster is None


def test_train_pipeline(spark):
    rows = [(i, ("buy cheap pills " if i % 2 else "see you at lunch ") + str(i % 5), "spam" if i % 2 else "ham") for i in range(40)]
    done = train(spark.createDataFrame(rows, "doc_id long, text string, label string"), Config(min_freq=2))
    report = done.report.first()
    assert report.accuracy == 1.0 and report.n_classes == 2 and done.predictions.count() == 8


def test_knn_prediction(spark):
    rows = [(i, ("cheap offer prize" if i % 2 else "meeting agenda project") + f" w{i % 3}", i % 2) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").select("doc_id", T.words(F.col("text")).alias("terms"), "label")
    model = tfidf.fit(docs, min_df=2)
    width = model.features.count()
    train_rows = text_vectors(model, docs, width).join(docs.select(F.col("doc_id").alias("id"), "label"), "id")
    ask = spark.createDataFrame([(1, ["prize", "offer"]), (2, ["nothing", "known"])], "doc_id long, terms array<string>")
    got = {r.doc_id: r for r in knn_prediction(ask, train_rows, model, 3).collect()}
    assert got[1].label == 1 and got[1].probs == {"0": 0.0, "1": 1.0} and got[2].label == 0 and got[2].error is None
    assert knn_prediction(ask, None, model) is None
    assert {r.error for r in knn_prediction(ask, train_rows, None).collect()} == {"TF-IDF vectorizer required for KNN"}
