"""Vocabularies and counts: fixtures F1 to F4."""

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import ranking, splits, vocabulary


def docs(spark, texts, low=1, high=1):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows.select("doc_id", T.ngram_range(T.tokens(F.col("text")), low, high).alias("terms"))


def as_dict(vocab):
    return {r.term: r.idx for r in vocab.collect()}


def test_basic(spark):
    d = docs(spark, ["Buy cheap meds now", "Hello friend how are you", "Cheap meds available buy today"])
    v = vocabulary.vocabulary(d)
    assert {"buy", "cheap"} <= set(as_dict(v))
    counts = {(r.doc_id, r.idx): r.cnt for r in vocabulary.doc_counts(d, v).collect()}
    assert counts[0, as_dict(v)["cheap"]] == 1


def test_ngrams_and_min_freq(spark):
    texts = ["cheap meds available", "cheap meds today", "cheap offer"]
    assert "cheap meds" in as_dict(vocabulary.vocabulary(docs(spark, texts, 1, 2)))
    assert as_dict(vocabulary.vocabulary(docs(spark, texts), min_freq=2)) == {"cheap": 0, "meds": 1}
    assert as_dict(vocabulary.vocabulary(docs(spark, texts), max_features=1)) == {"cheap": 0}


def test_dense_and_sparse(spark):
    d = docs(spark, ["buy cheap", "hello world", "", None])
    v = vocabulary.vocabulary(d)
    assert as_dict(v) == {"buy": 0, "cheap": 1, "hello": 2, "world": 3}
    sparse = vocabulary.sparse_rows(d, vocabulary.doc_counts(d, v))
    assert {r.doc_id: r.counts for r in sparse.collect()} == {0: {0: 1, 1: 1}, 1: {2: 1, 3: 1}, 2: {}, 3: {}}
    dense = {r.doc_id: r.row for r in vocabulary.dense_rows(sparse, 4).collect()}
    assert dense == {0: [1, 1, 0, 0], 1: [0, 0, 1, 1], 2: [0] * 4, 3: [0] * 4}


def test_round_trip(spark, tmp_path):
    v = vocabulary.vocabulary(docs(spark, ["a b c", "b c d"]))
    assert as_dict(v) == {"b": 0, "c": 1, "a": 2, "d": 3}
    vocabulary.save_vocabulary(v, str(tmp_path / "v"))
    assert [r.term for r in vocabulary.load_vocabulary(spark, str(tmp_path / "v")).collect()] == ["b", "c", "a", "d"]


def test_empty(spark):
    d = docs(spark, [])
    v = vocabulary.vocabulary(d)
    assert v.count() == 0 and vocabulary.doc_counts(d, v).count() == 0


def test_dense_index_over_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 10).alias("c"))
    got = ranking.dense_index(rows, "idx", F.desc("c"), F.col("k")).collect()
    want = {(r.k, r.c): i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r.c, r.k)))}
    assert {(r.k, r.c): r.idx for r in got} == want


def test_stratified_split(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "spam").when(F.col("id") % 50 == 1, None).otherwise("ham").alias("label"))
    got = splits.stratified_split(rows)
    counts = {(r.label, r.is_test): r["count"] for r in got.groupBy("label", "is_test").count().collect()}
    for label in ("spam", "ham", None):
        n = counts[label, True] + counts[label, False]
        assert counts[label, True] == -(-n // 5)
    again = splits.stratified_split(rows.repartition(7))
    assert sorted(map(str, got.select("doc_id", "is_test").collect())) == sorted(map(str, again.select("doc_id", "is_test").collect()))
