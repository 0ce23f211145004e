"""Frequency of every distinct term (problem 1): occurrences, records, and a mark of use.

A range-partitioned external sort of (term, record) pairs.  Each batch of records gives one sorted run of pairs with the
number of times a record holds a term, so that repeats within a record never leave their task; runs are cut at the range
boundaries and written to the shuffle, and each partition merges the pieces of its range and scans the runs of equal terms.
The range is over the term's hash *and* the record, so the pairs of a term that a third of all records hold spread over as
many partitions as they need; partitions are as many as keep one at about ``PART_PAIRS`` pairs.  The boundaries come from a
bounded sample and decide nothing but the balance.  Each partition gives partial counts, which are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import bounded_sample
from . import kernels

#: Records the range boundaries are taken from; pairs a partition holds about, at most.
SAMPLE, PART_PAIRS = 2000, 2_000_000


def sorted_run(ids: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(hash, id, times) of a batch's pairs, by hash and id, and the term of each distinct hash, in order of the hashes."""
    hashes, owners, times, names = [], [], [], {}
    for at, raw, offsets in kernels.text_chunks(column):
        words = kernels.words_of(raw, offsets)
        if not len(words.hash):
            continue
        order = np.argsort(words.hash)
        order = order[np.argsort(words.doc[order].astype(np.uint32), kind="stable")]
        h, doc = words.hash[order], words.doc[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
        hashes.append(h[first])
        owners.append(ids[at + doc[first]])
        times.append(np.diff(first, append=len(h)).astype(np.int32))
        unique, pick = np.unique(words.hash, return_index=True)
        for u, i in zip(unique.tolist(), pick.tolist(), strict=True):
            if u not in names:
                names[u] = words.folded[words.start[i] : words.end[i]].tobytes()
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), []
    h, owner, n = np.concatenate(hashes), np.concatenate(owners), np.concatenate(times)
    order = np.argsort(owner, kind="stable")
    order = order[np.argsort(h[order], kind="stable")]
    h, owner, n = h[order], owner[order], n[order]
    return h, owner, n, [names[u] for u in h[np.flatnonzero(np.diff(h, prepend=~h[0]))].tolist()]


def part_of(h: np.ndarray, ids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the boundaries, pairs in order, are not above each pair; the pairs ``(h, ids)`` are in order too.

    The boundaries are looked up among the pairs, so that the work is in their number, whatever terms they fall on.
    """
    low, high = np.searchsorted(h, bounds[0], "left"), np.searchsorted(h, bounds[0], "right")
    for i in np.flatnonzero(low < high):
        low[i] += np.searchsorted(ids[low[i] : high[i]], bounds[1][i], "left")
    return np.cumsum(np.bincount(low, minlength=len(h) + 1))[: len(h)]


def _runs(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ids, times, names = sorted_run(np.asarray(batch.column(0)), batch.column(1))
            if not len(h):
                continue
            part = part_of(h, ids, bounds.value)
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            number = np.cumsum(head) - 1
            head[1:] |= part[1:] != part[:-1]
            first = np.flatnonzero(head)  # a piece of a run: one term in one part
            size = np.diff(first, append=len(h)).astype(np.int32)
            edge = np.flatnonzero(np.diff(part[first], prepend=-1))
            to_piece = np.append(edge, len(first)).astype(np.int32)
            to_pair = np.append(first[edge], len(h)).astype(np.int32)
            terms = pa.array([names[k] for k in number[first].tolist()], pa.binary()).cast(pa.string())
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at), values)
            cols = [pa.array(part[first[edge]].astype(np.int32)), lists(to_piece, terms), lists(to_piece, pa.array(size)), lists(to_pair, pa.array(ids)), lists(to_pair, pa.array(times))]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "terms", "sizes", "ids", "times"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the pieces of a range and scans it: a pair counts once, as repeats are copies of a record."""
    pieces = [b.column(i).flatten() for b in batches if b.num_rows for i in (1, 2, 3, 4)]
    if not pieces:
        return
    coded = pa.concat_arrays(pieces[0::4]).dictionary_encode()
    size, ids, times = (np.concatenate([np.asarray(x) for x in pieces[i::4]]) for i in (1, 2, 3))
    names = kernels.string_array(coded.dictionary)
    words = [kernels.words_of(raw, at).hash for _, raw, at in kernels.text_chunks(names)]
    rank = np.argsort(np.argsort(np.concatenate(words)))  # terms in the order of the runs; each is one word
    key = rank[np.asarray(coded.indices)]
    code = np.repeat(np.asarray(coded.indices), size)
    low = int(ids.min())
    bits = (int(ids.max()) - low).bit_length()
    if bits + len(rank).bit_length() < 64:  # term and record as one number: the pieces rise in it, and the sort merges them
        order = np.argsort(np.repeat(key, size) << bits | (ids - low), kind="stable")
    else:
        order = np.lexsort((ids, np.repeat(key, size)))
    code, ids, times = code[order], ids[order], times[order].astype(np.int64)
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(np.diff(code, prepend=-1))
    cols = [coded.dictionary.take(pa.array(code[at])), pa.array(np.add.reduceat(np.where(fresh, times, 0), at)), pa.array(np.add.reduceat(fresh.astype(np.int64), at))]
    yield pa.RecordBatch.from_arrays(cols, names=["term", "occurrences", "records"])


def _boundaries(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ids) that cut the pairs of ``rows`` into about equal parts, ``least`` or more of them."""
    total = rows.count()
    sample = bounded_sample(rows, "id", SAMPLE).toArrow()
    if not sample.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, ids, *_ = sorted_run(sample.column("id").to_numpy(), sample.column("text").combine_chunks())
    parts = max(least, -(-len(h) * total // (sample.num_rows * PART_PAIRS)))
    at = np.unique(len(h) * np.arange(1, parts) // parts)
    return (h[at], ids[at]) if len(h) else (h, ids)


def term_frequencies(rows: DataFrame, rare_below: int = 3, common_share: tuple[int, int] = (1, 5)) -> DataFrame:
    """(term, occurrences, records, mark) for every word of ``rows(id, text)``.

    ``mark`` is ``rare`` if fewer than ``rare_below`` records hold the word, ``common`` if more than the given share of
    all records do, otherwise null; rare wins where both hold.  Records are the distinct ids with a non-null text, empty
    texts included; rows repeated under an id are taken as copies and count once; rows with a null id are left out.  An
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long"), F.col("text").cast("string")).where("id IS NOT NULL AND text IS NOT NULL")
    bounds = _boundaries(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = rows.mapInArrow(_runs(spark.sparkContext.broadcast(bounds)), "part int, terms array<string>, sizes array<int>, ids array<long>, times array<int>")
    runs = pieces.repartitionById(len(bounds[0]) + 1, F.col("part")).mapInArrow(_scan, "term string, occurrences long, records long")
    total = rows.select("id").agg(F.count_distinct("id")).scalar()
    num, den = common_share
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * den > total * num, "common")
    counts = runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return counts.select("term", "occurrences", "records", mark.alias("mark"))
