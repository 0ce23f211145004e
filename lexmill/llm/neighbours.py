"""Most similar vectors for every vector (problem 5): learned partitions, on two levels.

On a bounded sample a neighbour graph is built exactly and cut into balanced coarse parts; a small softmax classifier
learns, for each sample vector, where its neighbours lie.  A bounded sample of every coarse part is then cut into fine parts
in the same way, one coarse part a task, so that the rows fitted on grow with the number of parts.  The classifiers file
every row of the collection under its most probable fine part and send each query to the most probable ones, where
candidates are ranked by exact cosine.  A fine part should hold ``PART_ROWS`` rows however large the table is, so that the
work of a query doesn't grow with it.  A coarse part is one task, so that a query is sent once for all the fine parts it
visits there.  Coarse parts are split into blocks of at most ``BLOCK`` rows by a hash of the row's id, so that one holding
a third of all rows is as many tasks as it needs; each block gives its own best, which are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import bounded_sample
from ..session import cut

#: Most rows the coarse parts are learned on, and most rows the fine parts of one coarse part are learned on.
SAMPLE, FINE_SAMPLE = 8000, 2000
#: Rows a fine part should hold; parts that a smaller table is still cut into, with LEAST_ROWS rows each or more.
PART_ROWS, LEAST_PARTS, LEAST_ROWS = 250, 64, 8
#: Fine parts a query visits for neighbours of large cosine, and for neighbours of any; coarse parts it looks into.
PROBES, WIDE_PROBES, LOOKS = 24, 64, 12
#: Rows and queries in one task.
BLOCK, QUERY_BLOCK = 20_000, 50_000
#: Most bytes of the fine classifiers, which are sent to all executors; tables that would need more get larger parts.
ROUTER_BYTES = 1 << 26
GRAPH_NEIGHBOURS = 10


def clean(rows: DataFrame, key: str, features: str) -> DataFrame:
    """(id, v) with ``v`` as float32 bytes, each id once: null cells and missing last cells are 0.

    Rows with a null id, null features or without any non-zero, finite cell are left out.
    """
    cell = lambda x: F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(0.0)).cast("float")
    kept = rows.select(F.col(key).cast("long").alias("id"), F.transform(features, cell).alias("v")).where("id IS NOT NULL AND exists(v, x -> x <> 0)")
    return kept.mapInArrow(_packed, "id long, v binary").dropDuplicates(["id"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = batch.column(1)
        at = (4 * np.asarray(cells.offsets)).astype(np.int32)
        values = np.ascontiguousarray(cells.values.to_numpy(zero_copy_only=False), np.float32)
        v = pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(at), pa.py_buffer(values)])
        yield pa.RecordBatch.from_arrays([batch.column(0), v], names=["id", "v"])


def _unit(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of unit length; missing last cells are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width))
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] // 4
    values = np.frombuffer(column.buffers()[2], np.float32, at[-1] - at[0], 4 * int(at[0])).astype(np.float64)
    size = np.diff(at)
    if (size == width).all():
        out = values.reshape(-1, width)
    else:
        out = np.zeros((len(size), width))
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(values)) - np.repeat(at[:-1] - at[0], size)] = values
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def balanced_parts(x: np.ndarray, parts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(part of each row of ``x``, neighbours): a neighbour graph cut into parts of nearly equal size.

    Parts start as balanced clusters and then take over nodes most of whose neighbours they hold, within their capacity.
    """
    n, k = len(x), min(GRAPH_NEIGHBOURS, len(x) - 1)
    near = np.empty((n, k), np.int64)
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        near[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    capacity = int(np.ceil(n / parts * 1.1))
    centre = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(8):
        score = x @ centre.T
        part[:] = -1
        room = np.full(parts, capacity)
        for i in np.argsort(-score.max(axis=1)):  # the surest first
            for p in np.argsort(-score[i]):
                if room[p]:
                    part[i] = p
                    room[p] -= 1
                    break
        for p in range(parts):
            if (part == p).any():
                c = x[part == p].mean(axis=0)
                centre[p] = c / max(np.linalg.norm(c), 1e-12)
    for _ in range(10):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), k), part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, k)), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            if size[best[i]] < capacity:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part, near


def learn_router(x: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Weights (width + 1, parts) of a softmax classifier from a unit vector to the parts that hold it and its neighbours."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    parts = max(min(parts, n // 2), 1)
    out = np.zeros((width + 1, parts))
    if parts < 2:
        return out.astype(np.float32)
    part, near = balanced_parts(x, parts, rng)
    target = np.zeros((n, parts))
    np.add.at(target, (np.arange(n), part), 3)
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1)
    target /= target.sum(axis=1, keepdims=True)
    m, v = np.zeros_like(out), np.zeros_like(out)
    for t in range(1, 301):
        e = (np.exp(_log_softmax(x @ out[:-1] + out[-1])) - target) / n
        g = np.vstack([x.T @ e + 1e-5 * out[:-1], e.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        out -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return out.astype(np.float32)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Router:
    """The classifiers of both levels; fine parts are numbered through, those of coarse part ``c`` from ``first[c]`` on."""

    coarse: np.ndarray
    fine: list[np.ndarray]

    def __post_init__(self) -> None:
        self.first = np.cumsum([0, *(f.shape[1] for f in self.fine)])

    @property
    def width(self) -> int:
        return len(self.coarse) - 1

    def best(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable fine parts of each row, -1 where there are fewer: coarse and fine chances are multiplied."""
        chance = _log_softmax(x @ self.coarse[:-1] + self.coarse[-1])
        looks = min(LOOKS, chance.shape[1])
        looked = np.argsort(-chance, axis=1, kind="stable")[:, :looks]
        most = max(f.shape[1] for f in self.fine)
        score = np.full((len(x), looks * most), -np.inf)
        name = np.full((len(x), looks * most), -1)
        for c, f in enumerate(self.fine):
            row, turn = np.nonzero(looked == c)
            if len(row):
                at = (turn * most)[:, None] + np.arange(f.shape[1])
                score[row[:, None], at] = _log_softmax(x[row] @ f[:-1] + f[-1]) + chance[row, c][:, None]
                name[row[:, None], at] = self.first[c] + np.arange(f.shape[1])
        order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(name, order, axis=1)

    def coarse_of(self, part: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, part, "right") - 1


def part_counts(total: int, width: int) -> tuple[int, int]:
    """How many coarse parts a table is cut into, and each of them into how many fine ones."""
    parts = max(total // PART_ROWS, min(LEAST_PARTS, total // LEAST_ROWS), 1)
    parts = min(parts, max(ROUTER_BYTES // (4 * (width + 1)), 1))
    coarse = math.isqrt(parts)
    return coarse, -(-parts // coarse)


def _fit_fine(width: int, fine: int):
    def run(table: pa.Table) -> pa.Table:
        weights = learn_router(_unit(table.sort_by("id").column("v"), width), fine)
        return pa.table({"coarse": table.column("coarse")[:1], "weights": pa.array([weights.tobytes()])})

    return run


def learn(data: DataFrame, total: int, width: int) -> Router:
    """The classifiers for ``data(id, v)``."""
    spark = data.sparkSession
    coarse, fine = part_counts(total, width)
    sample = bounded_sample(data, "id", SAMPLE).select("v").toArrow()
    x = _unit(sample.column(0), width)
    top = learn_router(x, coarse)
    told = spark.sparkContext.broadcast(Router(top, [np.zeros((width + 1, 1), np.float32)] * top.shape[1]))
    filed = data.mapInArrow(_route(told, 1), _ROUTED).withColumnRenamed("part", "coarse")
    # a coarse part of this share of the rows gives about twice FINE_SAMPLE of them, smaller ones all they can
    turn = F.xxhash64("id", F.lit(3))
    limit = min(2.0 * FINE_SAMPLE * top.shape[1] / max(total, 1), 1.0)
    few = filed.where(F.pmod(turn, F.lit(1 << 30)) < int(limit * (1 << 30))).withColumn("rn", F.row_number().over(Window.partitionBy("coarse").orderBy(turn, "id"))).where(F.col("rn") <= FINE_SAMPLE)
    fitted = few.groupBy("coarse").applyInArrow(_fit_fine(width, fine), "coarse int, weights binary")
    found = {r.coarse: np.frombuffer(r.weights, np.float32).reshape(width + 1, -1) for r in fitted.collect()}
    return Router(top, [found.get(c, np.zeros((width + 1, 1), np.float32)) for c in range(top.shape[1])])


_ROUTED = "id long, v binary, part int, fine binary"


def _route(router, probes: int):
    """A row for each coarse part a row is sent to, with the fine parts it visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = router.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                piece = batch.slice(begin, 1024)
                best = r.best(_unit(piece.column(1), r.width), probes)
                row, turn = np.nonzero(best >= 0)
                fine = best[row, turn]
                coarse = r.coarse_of(fine)
                order = np.lexsort((fine, coarse, row))
                row, fine, coarse = row[order], fine[order].astype(np.int32), coarse[order]
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(coarse, prepend=-1) != 0))
                at = (4 * np.append(first, len(row))).astype(np.int32)
                visits = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(fine))])
                pick = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pick), piece.column(1).take(pick), pa.array(coarse[first].astype(np.int32)), visits], names=["id", "v", "part", "fine"])

    return run


def _visits(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, fine part) of every visit."""
    column = column.combine_chunks()
    fine = [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    return np.repeat(np.arange(len(fine)), [len(f) for f in fine]), np.concatenate(fine)


def _first_of_row(row: np.ndarray, cosine: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest cosines of each row, equal ones by the smaller id."""
    order = np.lexsort((ids, -cosine, row))
    row = row[order]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    return order[np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row))) < k]


def _best(width: int, k: int):
    def run(_, queries: pa.Table, index: pa.Table) -> pa.Table:
        rows, ids, cosines = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if queries.num_rows and index.num_rows:
            owner, fine = _visits(index.column("fine"))
            order = np.lexsort((index.column("id").to_numpy(), fine))
            name, x, fine = index.column("id").to_numpy()[owner[order]], _unit(index.column("v"), width)[owner[order]], fine[order]
            asker, asked = _visits(queries.column("fine"))
            by = np.argsort(asked, kind="stable")
            asker, asked = asker[by], asked[by]
            q, own = _unit(queries.column("v"), width), queries.column("id").to_numpy()
            for f in np.unique(fine).tolist():
                lo, hi = np.searchsorted(fine, [f, f + 1])
                a, b = np.searchsorted(asked, [f, f + 1])
                step = max(1, 2_000_000 // int(hi - lo))
                for at in range(a, b, step):
                    who = asker[at : min(at + step, b)]
                    s = np.round(q[who] @ x[lo:hi].T, 12)
                    me = np.minimum(np.searchsorted(name[lo:hi], own[who]), hi - lo - 1)
                    mine = np.flatnonzero(name[lo + me] == own[who])
                    s[mine, me[mine]] = -3
                    take = min(k, int(hi - lo))
                    edge = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
                    i, j = np.nonzero((s >= edge[:, None]) & (s > -2))
                    kept = _first_of_row(i, s[i, j], j, k)
                    i, j = i[kept], j[kept]
                    rows.append(who[i])
                    ids.append(name[lo + j])
                    cosines.append(s[i, j])
        row, near, cosine = (np.concatenate(x) for x in (rows, ids, cosines))
        kept = _first_of_row(row, cosine, near, k)
        own = queries.column("id").to_numpy() if queries.num_rows else row
        return pa.table({"id": own[row[kept]].astype(np.int64), "neighbour": near[kept], "cosine": cosine[kept]})

    return run


def most_similar(rows: DataFrame, k: int, key: str = "row_id", features: str = "features", queries: str | None = None, probes: int = WIDE_PROBES) -> DataFrame:
    """(id, neighbour, cosine, rank): for each row the ``k`` others of largest cosine that the visited parts hold.

    ``queries`` is a condition on ``id`` that picks the rows that ask; all rows are indexed and, without it, all ask.
    ``probes`` is how many parts a query visits.  Equal cosines are ranked by the smaller id; equal rows under different
    ids are neighbours.  Rows left out by :func:`clean` neither ask nor are found.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    data = cut(clean(rows, key, features), "vectors")
    total, width = data.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    width = max((width or 0) // 4, 1)
    router = spark.sparkContext.broadcast(learn(data, total, width))
    asked = data.where(queries) if queries else data
    filed = cut(data.mapInArrow(_route(router, 1), _ROUTED), "filed")
    sent = asked.mapInArrow(_route(router, probes), _ROUTED)
    rows_in = filed.groupBy("part").agg(F.count("*").alias("rows_in"))
    asks_in = sent.groupBy("part").agg(F.count("*").alias("asks_in"))
    # a part of more rows or queries than a task should have is as many tasks as it takes; few parts are that large
    sizes = rows_in.join(asks_in, "part", "full").selectExpr("part", f"int(ceil(coalesce(rows_in, 1) / {BLOCK})) AS r", f"int(ceil(coalesce(asks_in, 1) / {QUERY_BLOCK})) AS q")
    large = {x.part: (x.r, x.q) for x in sizes.where("r > 1 OR q > 1").collect()}

    def splits(i: int):
        return F.coalesce(F.create_map(*[F.lit(x) for p, n in large.items() for x in (p, n[i])])[F.col("part")], F.lit(1)) if large else F.lit(1)

    up_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    by_rows, by_asks = splits(0), splits(1)
    left = sent.select("id", "v", "fine", "part", mine(by_asks).alias("a"), up_to(by_rows).alias("b"))
    right = filed.select("id", "v", "fine", "part", up_to(by_asks).alias("a"), mine(by_rows).alias("b"))
    found = left.groupBy("part", "a", "b").cogroup(right.groupBy("part", "a", "b")).applyInArrow(_best(width, k), "id long, neighbour long, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(rows: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows one of which is among the other's ``k`` most similar, with a cosine of ``least`` or more."""
    near = most_similar(rows, k, probes=PROBES).where(F.col("cosine") >= least - 1e-12)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
