"""Filling containers of fixed capacity with texts (problem 7): sum-of-squares packing.

Each text goes to the fill level that leaves the least sum of squared counts of partly filled containers; a level array
holds the counts, so that a step costs one vectorised pass over the levels.  The table is cut into shards of about equal
tokens that are packed independently, each once in a pseudo-random order, which suits many texts, and once by falling size,
which suits few; the packing with fewer containers is taken.  The containers a shard leaves less than ``FULL`` filled are
packed once more, whole, across shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import VOCABULARY, column, sharded, with_tokens

#: Fill from which a container is closed for good; below, it is offered to the second pass.
FULL = 0.98


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, fill of each container) of items in this order; sizes are from 1 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        room = capacity - s
        # change of the sum when a container moves from level h to h + s; full containers and new ones don't count
        now = counts[: room + 1]
        change = np.where(now > 0, 2 * (counts[s:] - now) + 2, never)
        if now[room] > 0:
            change[room] = 1 - 2 * now[room]
        change[0] = 2 * counts[s] + 1 if s < capacity else 0
        h = int(change.argmin())
        if h == 0:
            b = len(fill)
            fill.append(0)
        else:
            b = open_at[h].pop()
            counts[h] -= 1
        level = h + s
        fill[b] = level
        where[i] = b
        if level < capacity:
            counts[level] += 1
            open_at[level].append(b)
    return where, np.array(fill, np.int64)


def packed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sum_of_squares` of items in the better of two orders: as they come, or by falling size."""
    found = sum_of_squares(sizes, capacity)
    order = np.argsort(-sizes, kind="stable")
    where, fill = sum_of_squares(sizes[order], capacity)
    if len(fill) < len(found[1]):
        found = np.empty_like(where), fill
        found[0][order] = where
    return found


def _first(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("doc_id", "ascending")])
        ids, tokens, shard = column(table, "doc_id"), column(table, "tokens"), int(table.column("shard")[0].as_py())
        whole, rest = tokens // capacity, tokens % capacity
        item = np.flatnonzero(rest)
        where, fill = packed(rest[item], capacity)
        cut_doc = np.repeat(np.arange(len(ids)), whole)
        piece = np.arange(len(cut_doc)) - np.repeat(np.cumsum(whole) - whole, whole)
        base = shard << 32
        doc = np.concatenate([cut_doc, item])
        piece = np.concatenate([piece, whole[item]])
        size = np.concatenate([np.full(len(cut_doc), capacity), rest[item]])
        window = base + np.concatenate([len(fill) + np.arange(len(cut_doc)), where])
        filled = np.concatenate([np.full(len(cut_doc), capacity), fill[where]])
        return pa.table({"window": window, "doc_id": ids[doc], "piece": piece.astype(np.int32), "tokens": size.astype(np.int64), "filled": filled})

    return run


def _again(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("window", "ascending")])
        old, filled = column(table, "window"), column(table, "filled")
        where, _ = packed(filled, capacity)
        first = np.full(where.max() + 1, -1)
        first[where[::-1]] = old[::-1]  # a joint container keeps the name of its first part
        return pa.table({"window": old, "joined": first[where]})

    return run


def pack(sized: DataFrame, capacity: int) -> DataFrame:
    """(window, doc_id, piece, offset, tokens): a place for every token of ``sized(doc_id, tokens)``.

    A text longer than the capacity is cut into full containers and a rest; no other text is cut.  ``piece`` counts from
    0 within a text, ``offset`` is the place within the container.  Texts of no tokens have no row; repeated rows of a
    doc_id count once; an empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("a container must hold at least one token")
    sized = sized.where("doc_id IS NOT NULL AND tokens > 0").dropDuplicates(["doc_id"])
    total = int(sized.agg(F.sum("tokens")).first()[0] or 0)
    schema = "window long, doc_id long, piece int, tokens long, filled long"
    placed = cut(sharded(sized, "doc_id", total).groupBy("shard").applyInArrow(_first(capacity), schema), "packed")
    part = placed.where(F.col("filled") < FULL * capacity).select("window", "filled").distinct()
    left = int(part.agg(F.sum("filled")).first()[0] or 0)
    moved = sharded(part, "window", left).select("window", "filled", "shard", "turn").groupBy("shard").applyInArrow(_again(capacity), "window long, joined long")
    placed = placed.join(moved, "window", "left").select(F.coalesce("joined", "window").alias("window"), "doc_id", "piece", "tokens")
    before = F.sum("tokens").over(_order().rowsBetween(-(2**31), -1))
    return placed.select("window", "doc_id", "piece", F.coalesce(before, F.lit(0)).alias("offset"), "tokens")


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("window").orderBy("doc_id", "piece")


def pack_documents(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`pack` of ``documents(doc_id, text)`` for every row of the small table ``containers(container, capacity_tokens)``.

    Adds ``container``.  Null texts have no row.  A container without a capacity of at least one token is left out.
    """
    sized = cut(with_tokens(documents.select("doc_id", "text"), "text", vocabulary), "sized")
    out = None
    for row in containers.where("capacity_tokens > 0").orderBy("container").collect():  # a handful of sizes
        one = pack(sized, int(row.capacity_tokens)).select(F.lit(row.container).alias("container"), "*")
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = pack(sized, 1).where("false").select(F.lit("").alias("container"), "*")
    return out


def pack_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, windows, tokens, capacity_tokens, fill) of :func:`pack_documents`; fill is tokens by capacity used."""
    sums = packed.groupBy("container").agg(F.count_distinct("window").alias("windows"), F.sum("tokens").alias("tokens"))
    fill = F.col("tokens") / (F.col("windows") * F.col("capacity_tokens"))
    return sums.join(F.broadcast(containers), "container").select("container", "windows", "tokens", "capacity_tokens", F.round(fill, 6).alias("fill"))
