"""Queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import filled
from ..operators import knn

from ..session import cut
from . import encoding, mixing, neighbours, newtext, overlaps, packing, subjects, terms
from .tokens import with_tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_frequencies(_table(spark, folder, "spam_assassin_preprocessed").select("id", "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_term_frequencies(spark, folder).where("mark IS NOT NULL").select("term", "mark")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps.grouped_pairs(p2_groups(spark, folder))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps.near_duplicate_groups(_mails(spark, folder), overlaps.MAIL_COPIES)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps.cross_split_pairs(_table(spark, folder, "spam_assassin_preprocessed").select("id", "split", "text"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "spam_assassin_preprocessed")
    return overlaps.overlap_report(rows, p3_found(spark, folder))


def _mails(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "spam_assassin").selectExpr("id", "email_content AS text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled(_mails(spark, folder), restore=False)


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled(_mails(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(_table(spark, folder, "train_tfidf_features"))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.most_similar(_table(spark, folder, "train_tfidf_features"), 5, queries="id % 20 = 0")
    return near.selectExpr("id AS row_id", "neighbour", "round(cosine, 6) AS cosine", "CAST(rank AS INT) AS rank")


def p5_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(pairs, enough): the true neighbours of cosine 0.8 and more of the rows whose id is divisible by 20, and whether nine tenths of them are found."""
    rows = _table(spark, folder, "train_tfidf_features")
    near = neighbours.most_similar(rows, 5, queries="id % 20 = 0", probes=neighbours.PROBES).select(F.col("id").alias("qid"), F.col("neighbour").alias("tid"), F.lit(1).alias("hit"))
    once = rows.where("row_id IS NOT NULL").dropDuplicates(["row_id"]).where("exists(features, x -> x <> 0)").select(F.col("row_id").alias("id"), filled(F.col("features"), 272).alias("v"), F.lit(0).alias("label"))
    true = knn.top_k(once, once.where("id % 20 = 0").select("id", "v"), 6).where("qid <> tid").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("rn"))).where("r <= 5 AND sim >= 0.8 - 1e-12")
    return true.join(near, ["qid", "tid"], "left").agg(F.count("*").alias("pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return newtext.new_lines(_mails(spark, folder))


def p6_labelled_lines(spark: SparkSession, folder: str) -> DataFrame:
    return newtext.labelled_lines(_mails(spark, folder))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), _table(spark, folder, "container_sizes"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_report(p7_packed(spark, folder), _table(spark, folder, "container_sizes"))


def p7_held(spark: SparkSession, folder: str) -> DataFrame:
    """(container, texts, overfull, cut_early, misplaced) for every container: nothing but the texts may be more than 0.

    ``texts`` counts those placed; ``overfull`` the windows above the capacity; ``cut_early`` the texts in several pieces
    that would have fitted; ``misplaced`` the texts whose pieces don't add up to their size or overlap in their window.
    """
    packed = cut(p7_packed(spark, folder), "packed")
    sizes = with_tokens(_table(spark, folder, "documents").select("doc_id", "text"), "text").where("tokens > 0").withColumnRenamed("tokens", "size")
    room = _table(spark, folder, "container_sizes").selectExpr("container", "CAST(capacity_tokens AS BIGINT) AS capacity")
    windows = packed.groupBy("container", "window").agg(F.sum("tokens").alias("filled"), F.max(F.col("offset") + F.col("tokens")).alias("reach"))
    full = windows.join(room, "container").groupBy("container").agg(F.count_if(F.expr("filled > capacity OR reach <> filled")).alias("overfull"))
    texts = packed.groupBy("container", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("placed"))
    judged = sizes.crossJoin(F.broadcast(room)).join(texts, ["container", "doc_id"], "full").groupBy("container")  # a handful of containers
    told = judged.agg(F.count("placed").alias("texts"), F.count_if(F.expr("pieces > 1 AND size <= capacity")).alias("cut_early"), F.count_if(F.expr("placed IS DISTINCT FROM size")).alias("misplaced"))
    return told.join(full, "container").select("container", "texts", "overfull", "cut_early", "misplaced")


def p8_held(spark: SparkSession, folder: str) -> DataFrame:
    """(source, max_repeats, above_cap, missed) for every source with a target: copies above the cap, and whether the share is missed by more than 0.002."""
    copies = cut(p8_copies(spark, folder), "copies")
    caps = _table(spark, folder, "source_weights").select(mixing.source_key().alias("source"), "max_repeats")
    above = copies.join(F.broadcast(caps), "source").groupBy("source").agg(F.count_if(F.expr("copies > max_repeats")).alias("above_cap"))
    report = mixing.mix_report(copies, _table(spark, folder, "source_weights")).where("target_share > 0 AND documents > 0")
    report = report.withColumn("goal", F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(0))))  # a handful of sources
    return report.join(above, "source", "left").select("source", "max_repeats", F.coalesce("above_cap", F.lit(0)).alias("above_cap"), (F.abs(F.col("actual_share") - F.col("goal")) > 0.002).alias("missed"))


def p8_copies(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "source_weights"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(p8_copies(spark, folder), _table(spark, folder, "source_weights"))


def _areas(spark: SparkSession, folder: str, every: bool) -> DataFrame:
    return subjects.subject_areas(*(_table(spark, folder, t) for t in ("documents", "subject_labels", "subjects")), every=every)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder, False).select("doc_id", "subject_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder, True).selectExpr("doc_id", "subject_id", "round(share, 6) AS share")


QUERIES = {f.__name__: f for f in (p1_found, p1_term_frequencies, p2_found, p2_groups, p3_found, p3_report, p4_found, p4_restored, p5_found, p5_neighbours, p5_recall, p6_found, p6_labelled_lines, p7_packed, p7_report, p7_held, p8_copies, p8_report, p8_held, p9_found, p9_shares)}
