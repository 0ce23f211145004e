"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_shared, write_shared
from .joins import FEW_ROWS, HOT_SHARE


def _least(edges: DataFrame, total: int, own: bool) -> tuple[DataFrame, DataFrame]:
    """(edges(u, v, m), stars(u, m)): each edge with the least neighbour of its ``u`` (or ``u`` itself, with ``own``).

    The edges of a node that holds more than 1 / HOT_SHARE of them stay where they are: there are fewer than HOT_SHARE
    such nodes, which are sent to the edges.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    if own:
        low = low.withColumn("m", F.least("u", "m"))
    hubs = low.where(F.col("d") > max(FEW_ROWS, total // HOT_SHARE)).collect() if total > FEW_ROWS else []
    low = low.select("u", "m")
    if not hubs:
        return edges.join(low, "u"), low
    few = F.broadcast(edges.sparkSession.createDataFrame([(r.u, r.m) for r in hubs], "u long, m long"))
    is_hub = F.col("u").isin([r.u for r in hubs])
    return edges.where(~is_hub).join(low, "u").unionByName(edges.where(is_hub).join(few, "u")), low


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is named by its smallest node.

    Alternating large-star and small-star rounds: a round joins the edges with the minimum of each node's neighbourhood,
    both of them distributed, so that no component has to fit one task; the number of rounds grows with the logarithm of
    the longest path.  Each round is written to the shared folder.  Null ends and self-loops are left out; repeated
    edges count once; an empty table gives an empty result.  RuntimeError if ``max_rounds`` don't suffice.
    """
    spark = edges.sparkSession
    start = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    path = write_shared(start.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state() -> tuple:
        now = spark.read.schema("u long, v long").parquet(path)
        return tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 999983)).first())

    mark = state()
    for _ in range(max_rounds):
        now = spark.read.schema("u long, v long").parquet(path)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * mark[0], own=True)[0].where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        if mark[0] > FEW_ROWS:
            large = cut(large, "edges")
        small, low = _least(large, mark[0], own=False)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = write_shared(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_shared(spark, path)
        path, before = after, mark
        mark = state()
        if mark == before:
            break
    else:
        raise RuntimeError(f"components aren't complete after {max_rounds} rounds")
    stars = spark.read.schema("u long, v long").parquet(path)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
