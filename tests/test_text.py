"""Token, n-gram, label and probability expressions; golden values of fixtures F10 to F12."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as T


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_tokens(spark):
    rows = [("Free-Entry 2 WIN!",), (None,), ("",), ("ÜBER naïve",)]
    assert values(spark, rows, "t string", T.tokens(F.col("t"))) == [["free", "entry", "2", "win"], [], [], ["ber", "na", "ve"]]
    assert values(spark, rows[:1], "t string", T.tokens(F.col("t"), lowercase=False)) == [["ree", "ntry", "2"]]


def test_very_long_text_is_read_whole(spark):
    assert values(spark, [("ab " * 400_000,)], "t string", F.size(T.tokens(F.col("t")))) == [400_000]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB9 .-é\n", max_size=30), min_size=1, max_size=8))
def test_tokens_as_the_pattern_says(spark, texts):
    assert values(spark, [(t,) for t in texts], "t string", T.tokens(F.col("t"))) == [re.findall("[a-z0-9]+", t.lower()) for t in texts]


def test_ngrams(spark):
    rows = [(["a", "b", "c"],), ([],), (["a"],)]
    at = lambda c: values(spark, rows, "t array<string>", c)
    assert at(T.ngrams(F.col("t"), 2)) == [["a b", "b c"], [], []]
    assert at(T.ngrams(F.col("t"), 3)) == [["a b c"], [], []]
    assert at(T.ngrams(F.col("t"), 0)) == [["a", "b", "c"], [], ["a"]]
    assert at(T.ngram_range(F.col("t"), 0, 1))[0] == ["a", "b", "c"] * 2
    assert at(T.ngram_range(F.col("t"), 2, 1)) == [[], [], []]
    assert at(T.joined(F.col("t"))) == ["a b c", "", "a"]


def test_labels(spark):
    rows = [(x,) for x in ("1.7", "spam", " T ", "ham", "nan", "", None, "-2", "0.4", "inf", "TRUE")]
    assert values(spark, rows, "t string", T.label_number(F.col("t"))) == [1, 1, 1, 0, 0, 0, 0, -2, 0, 0, 1]
    assert values(spark, [("SPAM",), ("1",), ("true",), ("x",), (None,), ("7",)], "t string", T.class_label(F.col("t"))) == [1, 1, 1, 0, 0, 7]


def test_probabilities(spark):
    rows = [([0.25, 0.75],), ([],), (None,)]
    at = lambda c: values(spark, rows, "p array<double>", c)
    assert at(T.probabilities(F.col("p"))) == [{"0": 0.25, "1": 0.75}, {}, {}]
    assert at(T.probabilities(F.col("p"), ["ham", "spam"]))[0] == {"ham": 0.25, "spam": 0.75}
    maps = [({"1": 0.5, "x": 0.5},), (None,)]
    assert values(spark, maps, "p map<string,double>", T.with_both_classes(F.col("p"))) == [{"0": 0.0, "1": 0.5, "x": 0.5}, {"0": 0.0, "1": 0.0}]
    pairs = [({"1": 0.91234}, "1"), ({"1": 0.9}, None), (None, "1"), ({"1": 0.9}, "0")]
    assert values(spark, pairs, "p map<string,double>, l string", T.confidence(F.col("p"), F.col("l"))) == [91.2, 0.0, 0.0, 0.0]


def test_prediction_lines(spark):
    rows = [('{"text":"hi"}',), ('{"a":1}',), ("{bad",), ('{"text":null}',), ("  plain ",), ('{"text":true}',), ('{"text":3}',)]
    assert values(spark, rows, "t string", T.prediction_text(F.col("t"))) == ["hi", '{"a":1}', "{bad", "None", "plain", "True", "3"]
