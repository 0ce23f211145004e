"""Near-duplicate groups (problem 2) and overlaps across splits (problem 3), both on :mod:`.setjoin`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.joins import attach, hot_keys, join_split
from ..session import cut
from .setjoin import SetJoin, similar_sets

MAIL_COPIES = SetJoin(k=3, num=1, den=2, min_words=20)
SPLIT_COPIES = SetJoin(k=2, num=7, den=10, min_words=20)
#: Members of a group that are paired with each other in one task.
PAIR_BLOCK = 4096
#: The default for near-duplicates: five words, similarity 0.8.
STRICT = SetJoin(k=5, num=4, den=5, min_words=5)


def near_duplicate_groups(rows: DataFrame, spec: SetJoin = STRICT) -> DataFrame:
    """(id, group_id, links) for every record of ``rows(id, text)`` with a set of word runs.

    ``group_id`` is the smallest id of the records joined by any chain of links, ``links`` the number of *other texts*
    (sets that differ) linked to the record; equal sets are always one group.  Records whose text is null, empty or
    shorter than the rules ask have no row; rows repeated under one id count once.
    """
    found = similar_sets(rows.select("id", F.lit(0).alias("role"), "text"), spec)
    ends = found.links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    names = connected_components(found.links).select(F.col("node").alias("sid"), "component")
    records = cut(found.records.select("id", "sid"), "records")
    total = records.count()
    full = attach(records, names.join(ends, "sid"), "sid", "left", total)  # linked sets have both
    full = full.select("id", F.coalesce("component", "sid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    full = cut(full, "groups")
    heads = full.groupBy("component").agg(F.min("id").alias("group_id"))
    return attach(full, heads, "component", total=total).select("id", "group_id", F.col("links").cast("long").alias("links"))


def grouped_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of every two members of one group of :func:`near_duplicate_groups`.

    Members of a group of more than PAIR_BLOCK are dealt to blocks by a hash of the id, and any two blocks are one piece
    of work.  The result is as large as the groups make it; use the groups themselves where pairs aren't asked for.
    """
    groups = cut(groups.select("id", "group_id"), "members")
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size")).where("size > 1").withColumn("n", F.ceil(F.col("size") / PAIR_BLOCK).cast("int")).drop("size")
    members = attach(groups, sizes, "group_id").withColumn("block", F.pmod(F.xxhash64("id"), "n").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = members.select(F.col("id").alias("id_a"), "group_id", F.col("block").alias("i"), each.alias("j"))
    right = members.select(F.col("id").alias("id_b"), "group_id", each.alias("i"), F.col("block").alias("j"))
    return left.join(right, ["group_id", "i", "j"]).where("id_a < id_b").select("id_a", "id_b")


def cross_split_pairs(rows: DataFrame, spec: SetJoin = SPLIT_COPIES) -> DataFrame:
    """(id_a, id_b), id_a < id_b, one record of split train and one of test or valid, whose sets of word runs are alike.

    ``rows(id, split, text)``; the split is trimmed and lower-cased, a null or unknown split belongs to none.  Null and
    short texts are in no pair; equal texts are; rows repeated under one id count once.
    """
    split = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    role = F.when(split == "train", 1).when(split.isin("test", "valid"), 2)
    found = similar_sets(rows.select("id", role.alias("role"), "text").where("role IS NOT NULL"), spec, crossed=True)
    records = cut(found.records.select("id", "role", "sid"), "records")
    train = records.where("role = 1").select(F.col("id").alias("t"), F.col("sid").alias("st"))
    held = records.where("role = 2").select(F.col("id").alias("e"), F.col("sid").alias("se"))
    links = found.links
    ways = links.select(F.col("a").alias("st"), F.col("b").alias("se")).unionAll(links.select(F.col("b").alias("st"), F.col("a").alias("se")))
    hot = hot_keys(records, "sid")  # texts that a large part of the records hold
    near = join_split(held, join_split(train, ways, "st", hot, "t"), "se", hot, "e").select("t", "e")
    same = join_split(train.withColumnRenamed("st", "sid"), held.withColumnRenamed("se", "sid"), "sid", hot, "t").select("t", "e")
    return near.unionAll(same).select(F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b"))


def overlap_report(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, records, overlapping, same_label, other_label) for ``rows(id, split, source, label)``.

    ``pairs`` are those of :func:`cross_split_pairs`.  ``overlapping`` counts the records in any pair, the last two those
    with a partner of the same and of another label; labels are compared as text, trimmed and lower-cased, and a null
    label as a label of its own.  Null splits and sources are groups of their own.
    """
    tidy = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    kept = rows.select("id", tidy("split").alias("split"), "source", tidy("label").alias("label")).where("id IS NOT NULL").dropDuplicates(["id"])
    ways = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionAll(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    labels = kept.select(F.col("id").alias("lid"), "label")
    told = ways.join(labels, F.col("id") == F.col("lid")).select("id", "other", F.col("label").alias("own"))
    told = told.join(labels, F.col("other") == F.col("lid")).select("id", F.col("own").eqNullSafe(F.col("label")).alias("same"))
    each = told.groupBy("id").agg(F.max(F.col("same").cast("int")).alias("same"), F.max((~F.col("same")).cast("int")).alias("another"))
    full = kept.join(each, "id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return full.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("same").alias("overlapping"), count("same").alias("same_label"), count("another").alias("other_label"))
