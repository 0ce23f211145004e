"""Vocabularies and term counts of documents.

Documents are ``(doc_id, terms ARRAY<STRING>)``; terms are tokens or n-grams, see :mod:`lexmill.functions.text`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import is_small
from .ranking import dense_index


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, cnt): occurrences of every term in all documents."""
    return docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))


def vocabulary(docs: DataFrame, min_freq: int = 1, max_features: int | None = None) -> DataFrame:
    """(term, idx, cnt): terms that occur at least ``min_freq`` times, most frequent first, ties by term; ``idx`` from 0.

    With ``max_features`` only the first so many stay.  Empty documents give an empty vocabulary.
    """
    kept = term_counts(docs).where(F.col("cnt") >= min_freq)
    if max_features is not None:
        kept = kept.orderBy(F.desc("cnt"), "term").limit(max_features)
    return dense_index(kept, "idx", F.desc("cnt"), F.col("term")).select("term", F.col("idx").cast("int").alias("idx"), "cnt")


def doc_counts(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, idx, cnt): sparse counts; terms outside the vocabulary don't count, documents without any have no row.

    A vocabulary small enough is sent to the documents, so that only numbers are shuffled; ``vocab`` should be stored.
    """
    if is_small(vocab, "term"):
        known = docs.select("doc_id", F.explode("terms").alias("term")).join(F.broadcast(vocab.select("term", "idx")), "term")
        return known.groupBy("doc_id", "idx").agg(F.count("*").alias("cnt"))
    pairs = docs.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("cnt"))
    return pairs.join(vocab.select("term", "idx"), "term").select("doc_id", "idx", "cnt")


def sparse_rows(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, counts MAP<INT,BIGINT>), an empty map for documents without a known term."""
    maps = counts.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("idx", "cnt")))).alias("counts"))
    return docs.select("doc_id").join(maps, "doc_id", "left").select("doc_id", F.coalesce("counts", F.create_map().cast("map<int,bigint>")).alias("counts"))


def dense_rows(sparse: DataFrame, width: int, dtype: str = "int") -> DataFrame:
    """(doc_id, row ARRAY) of exactly ``width`` cells, 0 where a document has no count."""
    if width == 0:
        return sparse.select("doc_id", F.array().cast(f"array<{dtype}>").alias("row"))
    cell = lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0)).cast(dtype)
    return sparse.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), cell).alias("row"))


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark, path: str) -> DataFrame:
    """A saved vocabulary, in index order."""
    return spark.read.schema("term string, idx int, cnt long").parquet(path).orderBy("idx")
