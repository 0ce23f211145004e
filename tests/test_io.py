"""Readers, writers, command lines and the streaming scorer; fixtures F11 and F12."""

import json
import os

import pytest

from lexmill import cli
from lexmill.operators.components import connected_components
from lexmill.operators.sampling import bounded_sample
from lexmill.sources import readers, writers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_aliases(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'message,body,spam,extra\n"two\nlines, ""quoted""",x,1,9\nNA,y,,9\n')
    assert [(r.text, r.label) for r in readers.read_labelled(spark, p).collect()] == [('two\nlines, "quoted"', "1"), ("", "nan")]
    q = write(tmp_path / "b.csv", "content,target\nhello,ham\n")
    assert [(r.text, r.label) for r in readers.read_evaluation(spark, q).collect()] == [("hello", "ham")]
    with pytest.raises(ValueError):
        readers.read_labelled(spark, q)
    with pytest.raises(FileNotFoundError):
        readers.read_labelled(spark, str(tmp_path / "none.csv"))


def test_feature_rows(spark, tmp_path):
    p = write(tmp_path / "f.csv", "label,f0,f1\n1.7,1,2\nspam,x,2\n\nham,1,2,3,4\n,1\n")
    rows = readers.read_features(spark, p, n_features=3).orderBy("id").collect()
    assert [(r.label, r.v) for r in rows] == [(1, [1, 2, 0]), (1, [0, 2, 0]), (0, [1, 2, 3]), (0, [1, 0, 0])]
    strict = write(tmp_path / "s.csv", "h,a\n1,0.5\n")
    assert readers.read_features(spark, strict, strict=True).first().v == [0.5]


def test_prediction_input(spark, tmp_path):
    p = write(tmp_path / "in.txt", '{"text":"hi"}\n\n  \n{bad\nplain\n')
    assert [r.text for r in readers.read_prediction_input(spark, p).orderBy("doc_id").collect()] == ["hi", "{bad", "plain"]


def test_config(tmp_path):
    assert readers.load_config(None) == readers.Config() == readers.load_config(str(tmp_path / "none"))
    got = readers.load_config(write(tmp_path / "c.yaml", "alpha: 0.5\nngram_range: [1, 2]\nlowercase: false\nother: 3\n"))
    assert (got.alpha, got.ngram_range, got.lowercase, got.min_freq) == (0.5, (1, 2), False, 1)


def test_prediction_files(spark, tmp_path):
    rows = spark.createDataFrame([("é", "1", {"1": 1.0}), ("b", None, None)], "text string, label string, probs map<string,double>")
    out = str(tmp_path / "o" / "x.json")
    writers.write_prediction_file(rows.limit(0), out)
    assert open(out).read() == ""
    writers.write_prediction_file(rows.limit(1), out)
    assert "\\u00e9" in open(out).read() and json.load(open(out))["label"] == "1"
    writers.write_prediction_file(rows, out)
    assert [json.loads(x)["text"] for x in open(out, encoding="utf-8")] == ["é", "b"]
    writers.write_predictions(rows, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_vocabulary_json(spark, tmp_path):
    v = spark.createDataFrame([("b", 1, 2), ("ä", 0, 5)], "term string, idx int, cnt long")
    writers.write_vocabulary_json(v, str(tmp_path / "v.json"))
    assert [(r.term, r.idx) for r in readers_vocab(spark, tmp_path)] == [("ä", 0), ("b", 1)]


def readers_vocab(spark, tmp_path):
    return writers.read_vocabulary_json(spark, str(tmp_path / "v.json")).collect()


def test_command_lines(spark, tmp_path, capsys):
    lines = "".join(f"{'cheap pills offer' if i % 2 else 'see you at lunch'} {i % 5},{'spam' if i % 2 else 'ham'}\n" for i in range(40))
    data, models = write(tmp_path / "d.csv", "text,label\n" + lines), str(tmp_path / "m")
    cli.main(["train", "--data", data, "--save_dir", models])
    assert json.load(open(os.path.join(models, "metrics.json")))["accuracy"] == 1.0
    cli.main(["evaluate", "--data", data, "--model", models, "--lowercase", "--output", str(tmp_path / "r.json")])
    assert json.load(open(tmp_path / "r.json"))["metrics"]["accuracy"] == 1.0
    capsys.readouterr()
    cli.main(["predict", "--model", models, "--text", "cheap offer", "--lowercase"])
    assert json.loads(capsys.readouterr().out)["label"] == "spam"
    with pytest.raises(SystemExit):
        cli.main(["evaluate", "--data", data])


def test_streaming_scores(spark, tmp_path):
    from lexmill.streaming.scoring import read_lines, score_stream
    from test_models import fitted

    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.txt", 'buy cheap\n{"text":"good morning"}\n\nbuy cheap\n')
    query = score_stream(read_lines(spark, str(tmp_path / "in")), fitted(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out") + "/*").collect()]
    assert sorted((r["text"], r["label"]) for r in rows) == [("buy cheap", "spam"), ("buy cheap", "spam"), ("good morning", "ham")]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bounded_sample(spark):
    rows = spark.range(5000)
    got = bounded_sample(rows, "id", 50).collect()
    assert len(got) == 50 and got == bounded_sample(rows.repartition(9), "id", 50).collect()
    assert bounded_sample(rows.limit(7), "id", 50).count() == 7
