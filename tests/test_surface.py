"""Loaders with fallbacks, the command for nearest neighbours, plain Python preprocessors, stop words, timings, and small or large joins."""

import json

import pytest

from lexmill import cli
from lexmill.operators import compare, joins, knn, nbayes, tfidf, vocabulary
from lexmill.plans import pipeline
from lexmill.sources import readers

DOCS = [(1, "buy cheap meds", "spam"), (2, "cheap cheap buy", "spam"), (3, "hello how are you", "ham"), (4, "good morning friend", "ham")]


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    corpus = spark.createDataFrame(DOCS * 1, "doc_id long, text string, label string")
    docs = corpus.selectExpr("doc_id", "split(text, ' ') AS terms")
    vocab = vocabulary.vocabulary(docs)
    model = nbayes.fit(corpus.select("doc_id", "label"), vocabulary.doc_counts(docs, vocab))
    pipeline.TextModel(model, vocab).save(path)
    return path


def features(path, rows):
    path.write_text("label,f0,f1\n" + "".join(f"{lab},{a},{b}\n" for lab, a, b in rows))
    return str(path)


def test_bayes_loader_falls_back(spark, saved, tmp_path):
    model, vocab, error = pipeline.load_bayes(spark, str(tmp_path / "none"), saved)
    assert model.classes == ["ham", "spam"] and vocab.count() == 10 and error is None
    model, vocab, error = pipeline.load_bayes(spark, str(tmp_path / "none"))
    assert model is None and vocab is None and "none" in error
    nbayes.load(spark, f"{saved}/nb_model").save(str(tmp_path / "bare/nb_model"))
    model, vocab, error = pipeline.load_bayes(spark, str(tmp_path / "bare"))
    assert model is not None and vocab is None and error is None
    assert pipeline.load_bayes(spark)[2]


def test_models_are_loaded_once(spark, saved, tmp_path):
    train = features(tmp_path / "train.csv", [(1, 1, 0), (0, 0, 2)])
    first = pipeline.load_models(spark, (saved,), str(tmp_path / "nowhere"), train)
    assert first is pipeline.load_models(spark, (saved,), str(tmp_path / "nowhere"), train)
    assert first.bayes is not None and first.linear is None and set(first.errors) == {"linear"}
    assert sorted(r.v for r in first.knn.collect()) == [[0.0, 1.0], [1.0, 0.0]]
    missing = pipeline.load_models(spark, (), None, str(tmp_path / "no.csv"))
    assert missing.bayes is None and missing.knn is None and set(missing.errors) == {"bayes", "knn"}


def test_knn_command(spark, tmp_path, capsys):
    train = features(tmp_path / "train.csv", [(1, 1, 0), (1, 1, 1), (0, 0, 1), (0, 0, 2)])
    test = features(tmp_path / "test.csv", [("spam", 2, 0), ("ham", 0, 1), ("ham", 3, 0), ("ham", 0, 0)])
    cli.main(["knn", "--train", train, "--test", test, "--k", "1", "--output-file", str(tmp_path / "out.jsonl")])
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (told["train"], told["test"], told["k"], told["accuracy"]) == (4, 4, 1, 0.75)
    assert len((tmp_path / "out.jsonl").read_text().splitlines()) == 4
    with pytest.raises(SystemExit):
        cli.main(["knn", "--train", str(tmp_path / "gone.csv"), "--test", test])


def test_vocabulary_from_elsewhere(spark, saved, tmp_path, capsys):
    vocabulary.save_vocabulary(vocabulary.load_vocabulary(spark, f"{saved}/vocab"), str(tmp_path / "words"))
    nbayes.load(spark, f"{saved}/nb_model").save(str(tmp_path / "m/nb_model"))
    cli.main(["predict", "--model", str(tmp_path / "m"), "--vocab", str(tmp_path / "words"), "--text", "buy cheap", "--lowercase"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["label"] == "spam"


def test_python_preprocessor(spark):
    tokenize = pipeline.python_preprocessor(lambda text, low: (text.lower() if low else text).split("-"))
    rows = spark.createDataFrame([(1, "A-b"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.t for r in rows.select("doc_id", tokenize(rows.text, True).alias("t")).orderBy("doc_id").collect()] == [["a", "b"], [], [""]]


def test_stop_words(tmp_path, spark):
    (tmp_path / "stop.txt").write_text("# words\nThe\n\nof\nthe\n")
    words = readers.read_stop_words(str(tmp_path / "stop.txt"))
    assert words == ("the", "of")
    row = spark.createDataFrame([("The price of meds",)], "text string")
    assert row.select(tfidf.terms(row.text, words, 1, 1)).first()[0] == ["price", "meds"]


def test_timings(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "model string, time_ms double")
    got = {r.model: tuple(r)[1:] for r in compare.timings(rows).collect()}
    assert got == {"a": (2, 4.0, 2.0, 3.0), "b": (0, None, None, None)}


def test_accuracy_by_model(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("b", None, 1)], "model string, x int, y int")
    assert {r.model: r.accuracy for r in knn.accuracy(rows, rows.x, rows.y, ("model",)).collect()} == {"a": 0.5, "b": 0.0}
    assert knn.accuracy(rows.limit(0), rows.x, rows.y).first().accuracy is None


def test_large_and_small_vocabularies_agree(spark, saved, monkeypatch):
    docs = spark.createDataFrame([(i, t.split()) for i, t, _ in DOCS] + [(9, []), (10, ["unknown"]), (11, ["buy"] * 5)], "doc_id long, terms array<string>")
    vocab, model = vocabulary.load_vocabulary(spark, f"{saved}/vocab"), nbayes.load(spark, f"{saved}/nb_model")
    weights = tfidf.fit(docs, 1, None)

    def all_of():
        scores = {(r.doc_id, r.label): round(r.log_score, 9) for r in model.scores_of_terms(docs, vocab).collect()}
        assert scores == {(r.doc_id, r.label): round(r.log_score, 9) for r in model.scores(docs, vocabulary.doc_counts(docs, vocab)).collect()}
        counts = {tuple(r) for r in vocabulary.doc_counts(docs, vocab).collect()}
        return scores, counts, {(r.doc_id, r.idx): round(r.weight, 9) for r in weights.weights(docs).collect()}

    small = all_of()
    for module in (joins, nbayes):
        monkeypatch.setattr(module, "SMALL_ROWS", 0)
    assert all_of() == small and len(small[0]) == 14
