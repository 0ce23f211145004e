"""k nearest neighbours by cosine, exact, with voting.

Vectors are ``(id, v ARRAY<DOUBLE>)`` of one width, training rows also have ``label INT``.  Sparse vectors also have
``at ARRAY<INT>``, ascending: the cells that ``v`` holds, on both sides.  Both sides are cut into blocks by a hash of the
id; each pair of blocks is one task that multiplies matrices, and the best of all blocks are merged.  No side is broadcast
and no block grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm, unit

#: Rows of a block.
BLOCK = 16_384


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``v`` scaled to length 1; vectors of length 0 or NaN become all zeros.  Null vectors stay null."""
    return rows.withColumn("v", unit(F.col("v")))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return values.to_numpy(zero_copy_only=False)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return _flat(column).reshape(rows, -1)


class _Postings:
    """Sparse rows by cell: what a query's cells meet is all that is added up."""

    def __init__(self, rows: pa.Table) -> None:
        cells, self.size = _flat(rows.column("at")), rows.num_rows
        order = np.argsort(cells, kind="stable")
        self.row = np.repeat(np.arange(self.size), pc.list_value_length(rows.column("at")).to_numpy())[order]
        self.value = _flat(rows.column("v"))[order]
        self.end = np.cumsum(np.bincount(cells)) if len(cells) else np.zeros(0, np.int64)

    def dots(self, queries: pa.Table) -> np.ndarray:
        cells, values = _flat(queries.column("at")), _flat(queries.column("v"))
        ends = np.cumsum(pc.list_value_length(queries.column("at")).to_numpy())
        out = np.zeros((len(ends), self.size))
        for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
            c, v = cells[a:b], values[a:b]
            c, v = c[c < len(self.end)], v[c < len(self.end)]
            n = self.end[c] - np.where(c > 0, self.end[c - 1], 0)
            at = np.arange(n.sum()) + np.repeat(self.end[c] - np.cumsum(n), n)
            out[i] = np.bincount(self.row[at], self.value[at] * np.repeat(v, n), self.size)
        return out


def _block_best(k: int):
    def run(_, queries: pa.Table, train: pa.Table) -> pa.Table:
        q, t, s, lab = [], [], [], []
        if queries.num_rows and train.num_rows:
            train = train.sort_by("id")
            ids, labels = train.column("id").to_numpy(), train.column("label").to_numpy()
            if "at" in train.column_names:
                dots = _Postings(train).dots
            else:
                x = _matrix(train.column("v"), train.num_rows)
                dots = lambda part: _matrix(part.column("v"), part.num_rows) @ x.T
            for at in range(0, queries.num_rows, 256):
                part = queries.slice(at, 256)
                sims = np.round(dots(part), 9)
                take = min(k, len(ids))
                edge = -np.partition(-sims, take - 1, axis=1)[:, take - 1]
                for i, qid in enumerate(part.column("id").to_numpy()):
                    near = np.flatnonzero(sims[i] >= edge[i])  # all that tie with the k-th, in order of id
                    near = near[np.argsort(-sims[i, near], kind="stable")[:take]]
                    q.append(np.full(len(near), qid))
                    t.append(ids[near])
                    s.append(sims[i, near])
                    lab.append(labels[near])
        both = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.table({"qid": both(q, np.int64), "tid": both(t, np.int64), "label": both(lab, np.int32), "sim": both(s, np.float64)})

    return run


def top_k(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, tid, label, sim, rn): the ``k`` most similar training rows of each query, nearest first, ties by ``tid``.

    Similarities are cosines rounded to nine decimals.  If there are no more than ``k`` training rows, all come out.
    Queries and training rows with a null vector are left out; a query of zeros has similarity 0 to all rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    train, queries = unit_vectors(train.where("v IS NOT NULL")), unit_vectors(queries.where("v IS NOT NULL"))
    blocks = max(1, -(-train.count() // BLOCK))
    q_blocks = max(1, -(-queries.count() // BLOCK))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = [c for c in ("at", "v") if c in train.columns]
    renewed = [F.col(c).alias(c) for c in ("id", *vector)]  # both sides may come from one table
    left = queries.select(*renewed, every(blocks).alias("b"), place(q_blocks).alias("a"))
    right = train.select("id", *vector, F.col("label").cast("int").alias("label"), place(blocks).alias("b"), every(q_blocks).alias("a"))
    best = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_block_best(k), "qid long, tid long, label int, sim double")
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), "tid")
    return best.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def majority(train: DataFrame) -> DataFrame:
    """(label): the most frequent training label, the smaller one if equal; no row without training rows."""
    return train.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select("label")


def vote(neighbours: DataFrame, k: int, tie: str = "nearest") -> DataFrame:
    """(qid, label, confidence) from ranked neighbours.

    The larger of the votes for 0 and for 1 wins; labels of other values vote for neither.  A tie goes to the nearest
    neighbour's label (``nearest``) or to 1 (``one``; there, any label but 1 votes for 0).  Confidence is the larger vote by ``k``, also if fewer rows voted.
    """
    ones = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    zeros = F.sum(F.when(F.col("label") != 1 if tie == "one" else F.col("label") == 0, 1).otherwise(0))
    first = F.max(F.when(F.col("rn") == 1, F.col("label"))) if tie == "nearest" else F.lit(1)
    votes = neighbours.groupBy("qid").agg(ones.alias("ones"), zeros.alias("zeros"), first.alias("first"))
    label = F.when(F.col("zeros") > F.col("ones"), 0).when(F.col("ones") > F.col("zeros"), 1).otherwise(F.col("first"))
    return votes.select("qid", label.cast("int").alias("label"), (F.greatest("ones", "zeros") / F.lit(float(k))).alias("confidence"))


def predict(train: DataFrame, queries: DataFrame, k: int = 9, tie: str = "nearest") -> DataFrame:
    """(qid, label, p0, p1): only the predicted label has a probability, its confidence.

    A query without direction (all zeros or NaN) gets the majority label with probability 1.
    """
    queries = queries.where("v IS NOT NULL").withColumn("_norm", norm(F.col("v")))
    good = (F.col("_norm") > 0) & ~F.isnan("_norm")
    found = vote(top_k(train, queries.where(good).drop("_norm"), k), k, tie)
    common = majority(train.where("v IS NOT NULL")).scalar()
    rest = queries.where(~good | F.col("_norm").isNull()).select(F.col("id").alias("qid"), common.cast("int").alias("label"), F.lit(1.0).alias("confidence"))
    return with_probabilities(found.unionByName(rest.where("label IS NOT NULL")))


def with_probabilities(found: DataFrame) -> DataFrame:
    share = lambda c: F.when(F.col("label") == c, F.col("confidence")).otherwise(0.0)
    return found.select("qid", "label", share(0).alias("p0"), share(1).alias("p1"))


def neighbour_labels(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, labels ARRAY<INT>): labels of the nearest rows, nearest first; a query of zeros gets those of the first ids."""
    near = top_k(train, queries, k)
    return near.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "label"))), lambda x: x["label"]).alias("labels"))


def distances(neighbours: DataFrame) -> DataFrame:
    """Neighbours with ``distance``, 1 minus the cosine; rows without direction are at distance 1."""
    return neighbours.withColumn("distance", 1 - F.col("sim"))


def accuracy(rows: DataFrame, true: Column, predicted: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., accuracy): the share of equal labels, a missing one equals none; null without rows."""
    return rows.groupBy(*by).agg(F.avg(F.when(true == predicted, 1.0).otherwise(0.0)).alias("accuracy"))
