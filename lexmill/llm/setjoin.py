"""Exact similarity join of records by their sets of word runs (problems 2 and 3).

The join is a pigeonhole over a partition of the universe of word runs.  With at most ``n - ceil(d n)`` of its ``n`` runs
missing from any partner of Jaccard similarity ``d`` or more, a record shares at least one of its ``n - ceil(d n) + 1``
cheapest segments with every partner, whatever segments of the universe are formed and whatever fixed order prices them.
Segments here hold one run of a record each; the price is the run's document frequency in a fixed-size count sketch over
the whole collection, and the cheapest are taken (cost-based allocation).  A segment too dear, i.e. a run too frequent,
is not indexed alone but as subsets of two.  Why not segments of several runs with one-deletion neighbourhoods: see the
README, with figures.

Steps, each over whole tables:

1. one pass gives each record's set hash, size and a parity bitmap, and the count sketch (see sketch_bits);
2. a second pass emits the signatures as arrays, routed to their partitions; there they are sorted and equal ones paired,
   under the length and position filters, so that no list of a signature's records leaves its task;
3. pairs are joined with the bitmaps: bits that differ are a lower bound of the symmetric difference (exact filter);
4. the sets of the remaining records, chosen with a Bloom filter of bounded size, are joined to the pairs and intersected.

Equal sets are one class from step 2 on: copies add one row each to the class table and nothing else, however many.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, write_shared
from . import kernels

#: Bounds of the count sketch's size; it has 2 ** bits cells, a byte each once it is summed up.
LEAST_SKETCH_BITS, SKETCH_BITS = 14, 24
_CHUNK, PRICE_STEPS = 1 << 14, 8
#: A run is indexed only together with a second one from an estimated document frequency of HOT on, or of HOT_LOAD times
#: the sketch's mean count, if that is more: then the noise of the sketch makes no run dear, however full it is.
HOT, HOT_LOAD = 4096, 8
#: Words of a bitmap: the first _SMALL of them for sets of at most _SMALL_SET runs, whose bits are the larger ones' folded.
_WORDS, _SMALL, _SMALL_SET = 12, 4, 130
#: Bounds of the Bloom filter's size in bits, 16 a key between them; fuller ones let more sets through, never fewer.
LEAST_BLOOM_BITS, BLOOM_BITS = 18, 28
#: Signatures a partition holds about, at most; sets with one signature that are paired in one task.
PART_SIGNATURES, LIST_BLOCK = 2_000_000, 4096


@dataclass(frozen=True)
class SetJoin:
    """Runs of ``k`` words, records of at least ``min_words`` words, similarity of at least ``num / den``."""

    k: int
    num: int
    den: int
    min_words: int

    def need(self, n: np.ndarray) -> np.ndarray:
        """Least number of common runs of a record of n runs with any partner."""
        return -(-n * self.num // self.den)

    def both(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Least number of common runs of records of n and m runs."""
        return -(-(n + m) * self.num // (self.num + self.den))


def _sets(spec: SetJoin, column: pa.Array):
    """(first record, offsets, runs) by chunk."""
    for at, raw, offsets in kernels.text_chunks(column):
        yield at, *kernels.shingles(kernels.words_of(raw, offsets), spec.k, spec.min_words)


def _set_hash(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each set: sums of two mixes, mixed again; 0 for the empty set."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(kernels.mix(h ^ np.uint64(0xD6E8FEB86659FD93)), out=sums[1:])
    out = sums[offsets[1:]] - sums[offsets[:-1]]
    return kernels.mix(out + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _parity(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A bitmap for each set: how often each bit is hit, modulo 2; of the smaller width for small sets, then zeros."""
    docs, width = len(offsets) - 1, 64 * _WORDS
    n = np.diff(offsets)
    doc = np.repeat(np.arange(docs), n)
    bit = ((h >> np.uint64(20)) % np.uint64(width)).astype(np.int64)
    bit[n[doc] <= _SMALL_SET] %= 64 * _SMALL
    odd = (np.bincount(doc * width + bit, minlength=docs * width) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(docs, width), axis=1).view(np.int64).reshape(docs, _WORDS)


_PROFILE = "kind string, id long, role int, sid long, n int, " + ", ".join(f"w{i} long" for i in range(_WORDS)) + ", chunk int, cell int, counts binary"


def sketch_bits(rows: DataFrame) -> int:
    """The sketch has a cell for about six runs of ``rows``, by the plan's estimate of their size, within its bounds."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max((size // 16).bit_length(), LEAST_SKETCH_BITS), SKETCH_BITS)


def _profile(spec: SetJoin, bits: int):
    names = ["kind", "id", "role", "sid", "n", *(f"w{i}" for i in range(_WORDS)), "chunk", "cell", "counts"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * _WORDS, pa.int32(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            ids, roles = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            for at, offsets, h in _sets(spec, batch.column(2)):
                n = np.diff(offsets)
                have = np.flatnonzero(n)
                if not len(have):
                    continue
                np.add.at(cells, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
                w = _parity(offsets, h)[have]
                m = len(have)
                cols = [pa.array(["doc"] * m), pa.array(ids[at + have], pa.int64()), pa.array(roles[at + have], pa.int32()), pa.array(_set_hash(offsets, h)[have]), pa.array(n[have], pa.int32())]
                cols += [pa.array(np.ascontiguousarray(w[:, i])) for i in range(_WORDS)] + [pa.nulls(m, t) for t in types[-3:]]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
        for c in range(0, len(cells), _CHUNK):
            part = cells[c : c + _CHUNK]
            if part.any():
                part = part.astype(np.min_scalar_type(part.max()))
                cols = [pa.array(["sketch"]), *(pa.nulls(1, t) for t in types[1:-3]), pa.array([c // _CHUNK], pa.int32()), pa.array([part.itemsize], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch's pieces; gives the sum, and log2 of each count + 1 in steps of 1 / PRICE_STEPS."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, cell, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            piece = np.frombuffer(zlib.decompress(counts), f"u{cell}")
            if c in sums:
                sums[c] += piece
            else:
                sums[c] = piece.astype(np.int64)
    for c, x in sums.items():
        prices = np.minimum(np.round(np.log2(x + 1.0) * PRICE_STEPS), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([prices.tobytes()])], names=["chunk", "logs"])


def _sketch(pieces: DataFrame, bits: int) -> np.ndarray:
    """The whole sketch: 2 ** bits prices of a byte."""
    out = np.zeros(1 << bits, np.uint8)
    for c, logs in pieces.select("chunk", "cell", "counts").repartition("chunk").mapInArrow(_add_chunks, "chunk int, logs binary").collect():
        out[c * _CHUNK : (c + 1) * _CHUNK] = np.frombuffer(logs, np.uint8)
    return out


def _ordered(h: np.ndarray, doc: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of each record by rising price, equal prices by hash; ``h`` is sorted by record and hash."""
    bits = len(sketch).bit_length() - 1
    price = sketch[(h >> np.uint64(64 - bits)).astype(np.int64)]
    order = np.argsort((doc.astype(np.uint64) << np.uint64(8)) | price.astype(np.uint64), kind="stable")
    return h[order], price[order]


def _signatures(spec: SetJoin, sketch, parts: int, load: float):
    hot = round(np.log2(max(HOT, HOT_LOAD * load) + 1.0) * PRICE_STEPS)
    names = ["part", "sid", "n", "role", "cnt", "sig", "pos"]
    types = [pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int16())]

    def signs(offsets, h):
        """(record, signature, position) of a chunk."""
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        h, price = _ordered(h, doc, sketch.value)
        pos = np.arange(len(h)) - offsets[doc]
        need = spec.need(n)
        inside = pos < (n - need + 1)[doc]
        dear = price > hot
        alone = inside & (~dear | (need <= 1)[doc])
        out = [(doc[alone], h[alone], pos[alone])]
        if (dear & inside).any():
            reach = pos < np.minimum(n, n - need + 2)[doc]
            first = np.flatnonzero(dear & inside)
            step = 1
            while len(first):
                first = first[first + step < len(h)]
                first = first[(doc[first] == doc[np.minimum(first + step, len(h) - 1)]) & reach[first + step]]
                out.append((doc[first], kernels.mix(h[first] * np.uint64(0x9DDFEA08EB382D69) + h[first + step]), pos[first]))
                step += 1
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            got, base, seen = [], 0, []
            for at, offsets, h in _sets(spec, batch.column(1)):
                n, sid = np.diff(offsets), _set_hash(offsets, h)
                d, s, p = signs(offsets, h)
                got.append((d + base, s, p))
                seen.append((sid, n, roles[at : at + len(n)]))
                base += len(n)
            if not got:
                continue
            d, s, p = (np.concatenate(x) for x in zip(*got, strict=True))
            sid, n, role = (np.concatenate(x) for x in zip(*seen, strict=True))
            _, lead, copy_of = np.unique(sid, return_index=True, return_inverse=True)
            if len(lead) < len(sid):  # equal sets leave a batch once, with all their roles
                joint = np.zeros(len(lead), role.dtype)
                np.bitwise_or.at(joint, copy_of, role)
                role = joint[copy_of]
                once = np.zeros(len(sid), bool)
                once[lead] = True
                d, s, p = d[once[d]], s[once[d]], p[once[d]]
            part = ((s >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((d, part))
            part, d, s, p = part[order], d[order], s[order], p[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            rows = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                which, cnt = np.unique(d[i:j], return_counts=True)
                rows.append((int(part[i]), sid[which], n[which].astype(np.int32), role[which].astype(np.int32), cnt.astype(np.int32), s[i:j].astype(np.uint32).view(np.int32), np.minimum(p[i:j], 32767).astype(np.int16)))
                if len(rows) >= 64:
                    yield _rows(rows, names, types)
                    rows = []
            if rows:
                yield _rows(rows, names, types)

    return run


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = [pa.array([r[0] for r in rows], types[0])]
    for i in range(1, len(types)):
        at = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r[i]) for r in rows], out=at[1:])
        cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([r[i] for r in rows]))))
    return pa.RecordBatch.from_arrays(cols, names=names)


_PAIRS = "a long, b long, sig long, block int, blocks int, entries binary"
_ENTRY = np.dtype([("sid", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("role", "<i4")])


def _near(spec: SetJoin, crossed: bool, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of entries of one signature pass the filters of size, position and role; ``one`` isn't the longer set."""
    n, m = one["n"].astype(np.int64), two["n"].astype(np.int64)
    ok = (n >= spec.need(m)) & (1 + np.minimum(n - one["pos"] - 1, m - two["pos"] - 1) >= spec.both(n, m))
    if crossed:
        ok &= ((one["role"] & 1) & (two["role"] >> 1) | (one["role"] >> 1) & (two["role"] & 1)) > 0
    return ok


class _Found:
    """Pairs as they are found; given out, each once, as soon as they are many."""

    def __init__(self) -> None:
        self.kept, self.held = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.kept.append((a, b))
            self.held += len(a)

    def out(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.held >= least:
            a, b = (np.concatenate(x) for x in zip(*self.kept, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            self.kept, self.held = [], 0
            rest = [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), *rest], names=["a", "b", "sig", "block", "blocks", "entries"])


def _pairs(spec: SetJoin, crossed: bool):
    """Pairs of the sets with a signature; lists of more than LIST_BLOCK sets come out in blocks, by rising size, unpaired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                sid, n, role, cnt, sig, pos = (np.asarray(batch.column(j)[i].values) for j in range(1, 7))
                got.append((np.full(len(sig), part, np.int64) << 32 | sig.view(np.uint32), np.repeat(sid, cnt), np.repeat(n, cnt), np.repeat(role, cnt), pos))
        if not got:
            return
        sig, sid, n, role, pos = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        if not len(sig):
            return
        order = np.lexsort((sid, n, sig))
        new = np.ones(len(sig), bool)
        sig, sid = sig[order], sid[order]
        new[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
        entries = np.empty(int(new.sum()), _ENTRY)
        entries["sid"], entries["n"], entries["pos"] = sid[new], n[order][new], pos[order][new]
        entries["role"] = np.bitwise_or.reduceat(role[order], np.flatnonzero(new))
        sig = sig[new]
        del sid, n, role, pos, order
        first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
        size = np.diff(first, append=len(sig))
        for i in np.flatnonzero(size > LIST_BLOCK):
            blocks = -(-int(size[i]) // LIST_BLOCK)
            for j in range(blocks):
                piece = entries[first[i] + j * LIST_BLOCK : first[i] + min((j + 1) * LIST_BLOCK, int(size[i]))]
                cols = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int(sig[first[i]])]), pa.array([j], pa.int32()), pa.array([blocks], pa.int32()), pa.array([piece.tobytes()])]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "sig", "block", "blocks", "entries"])
        alive, step, found = np.flatnonzero(np.repeat(size <= LIST_BLOCK, size)), 1, _Found()
        n = entries["n"].astype(np.int64)
        need = spec.need(n)
        while True:
            alive = alive[alive + step < len(sig)]
            other = alive + step
            good = (sig[alive] == sig[other]) & (n[alive] >= need[other])
            alive, other = alive[good], other[good]
            if not len(alive):
                break
            ok = _near(spec, crossed, entries[alive], entries[other])
            found.add(entries["sid"][alive[ok]], entries["sid"][other[ok]])
            yield from found.out(2_000_000)
            step += 1
        yield from found.out()

    return run


def _block_pairs(spec: SetJoin, crossed: bool):
    """Pairs of two blocks of one list, or within one; rows come sorted by list and pair of blocks."""

    def pair(one: np.ndarray, two: np.ndarray | None, found: _Found) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(one), 512):
            i, j = np.meshgrid(np.arange(at, min(at + 512, len(one))), np.arange(len(one if two is None else two)), indexing="ij")
            i, j = i.ravel(), j.ravel()
            if two is None:
                i, j = i[i < j], j[i < j]
            a, b = one[i], (one if two is None else two)[j]
            ok = _near(spec, crossed, a, b)
            found.add(a["sid"][ok], b["sid"][ok])
            yield from found.out(2_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = _Found(), None
        for batch in batches:
            for sig, low, high, block, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                entries = np.frombuffer(raw, _ENTRY)
                if low == high:
                    yield from pair(entries, None, found)
                elif waiting is None:
                    waiting = entries  # the lower block comes first
                else:
                    if waiting["n"][-1] >= spec.need(entries["n"][:1].astype(np.int64))[0]:
                        yield from pair(waiting, entries, found)
                    waiting = None
        yield from found.out()

    return run


def _all_pairs(lists: DataFrame, spec: SetJoin, crossed: bool, parts: int) -> DataFrame:
    """(a, b): the pairs of :func:`_pairs`, long lists included, each pair once."""
    lists = cut(lists, "pairs")
    short = lists.where("a IS NOT NULL").select("a", "b")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    long = lists.where("a IS NULL").select("sig", "block", other.alias("other"), "entries").select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "entries")
    met = long.repartition(parts, "sig", "low", "high").sortWithinPartitions("sig", "low", "high", "block").mapInArrow(_block_pairs(spec, crossed), _PAIRS)
    return short.unionAll(met.select("a", "b")).repartition(parts, "a").dropDuplicates(["a", "b"])


_WORD_CHUNK = 12


def _bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = np.asarray(batch.column(0))
            at = bit >> (_WORD_CHUNK + 6)
            for c in np.unique(at).tolist():
                mine = bit[at == c] & ((64 << _WORD_CHUNK) - 1)
                words = chunks.setdefault(c, np.zeros(1 << _WORD_CHUNK, np.uint64))
                np.bitwise_or.at(words, mine >> 6, np.uint64(1) << (mine & 63).astype(np.uint64))
        for c, words in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([words.tobytes()])], names=["chunk", "words"])

    return run


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over ``keys(sid)`` of a size that follows their number, within its bounds."""
    most = keys.count()
    bits = min(max((16 * most).bit_length(), LEAST_BLOOM_BITS), BLOOM_BITS)
    mask = (1 << bits) - 1
    hit = keys.select(F.explode(F.array(F.col("sid").bitwiseAND(mask), F.shiftrightunsigned("sid", 30).bitwiseAND(mask))).alias("bit"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for c, words in hit.repartition(F.shiftright("bit", _WORD_CHUNK + 6)).mapInArrow(_bits(bits), "chunk long, words binary").collect():
        out[c << _WORD_CHUNK : (c + 1) << _WORD_CHUNK] = np.frombuffer(words, np.uint64)
    return out


def _maybe(bloom: np.ndarray, sid: np.ndarray) -> np.ndarray:
    out = np.ones(len(sid), bool)
    for shift in (0, 30):
        bit = (sid.view(np.uint64) >> np.uint64(shift)) & np.uint64(64 * len(bloom) - 1)
        out &= ((bloom[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def _members(spec: SetJoin, bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()
            for _, offsets, h in _sets(spec, batch.column(0)):
                sid = _set_hash(offsets, h)
                want = np.flatnonzero((np.diff(offsets) > 0) & _maybe(bloom.value, sid))
                want = [i for i in want.tolist() if sid[i] not in done and not done.add(sid[i])]
                if want:
                    yield pa.RecordBatch.from_arrays([pa.array(sid[want]), pa.array([h[offsets[i] : offsets[i + 1]].tobytes() for i in want])], names=["sid", "runs"])

    return run


def _verify(spec: SetJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                if int((both[1:] == both[:-1]).sum()) >= spec.both(len(p), len(q)):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _unlike(na: Column, nb: Column) -> Column:
    """Bits that differ in bitmaps ``aw*`` and ``bw*``: no more than the runs only one of the sets has."""

    def apart(a: list[Column], b: list[Column]) -> Column:
        return reduce(add, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)))

    def folded(side: str) -> list[Column]:
        return [reduce(lambda x, y: x.bitwiseXOR(y), (F.col(f"{side}w{j}") for j in range(i, _WORDS, _SMALL))) for i in range(_SMALL)]

    whole = apart([F.col(f"aw{i}") for i in range(_WORDS)], [F.col(f"bw{i}") for i in range(_WORDS)])
    return F.when((na > _SMALL_SET) == (nb > _SMALL_SET), whole).otherwise(apart(folded("a"), folded("b")))


@dataclass
class Joined:
    """``records(id, role, sid, n)``, each id once; ``links(a, b)`` of different sets, each pair once, a < b."""

    records: DataFrame
    links: DataFrame


def similar_sets(rows: DataFrame, spec: SetJoin, crossed: bool = False) -> Joined:
    """All pairs of sets of word runs in ``rows(id, role, text)`` whose similarity reaches the threshold.

    ``role`` is a mask; with ``crossed`` a pair needs bit 0 in one set's records and bit 1 in the other's.  Null ids and
    texts, empty texts and texts of fewer than ``min_words`` words belong to no pair and to no record.  Rows repeated under one
    id count once.  An empty table gives empty results.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long"), F.col("role").cast("int"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    bits = sketch_bits(rows)
    table = write_shared(rows.mapInArrow(_profile(spec, bits), _PROFILE), "profile", ("kind",))
    plain = spark.read.schema(_PROFILE).parquet(table)
    sketch = spark.sparkContext.broadcast(_sketch(plain.where("kind = 'sketch'"), bits))
    found = plain.where("kind = 'doc'")
    words = [f"w{i}" for i in range(_WORDS)]

    runs = int(found.agg(F.sum("n")).first()[0] or 0)
    signatures = runs * (spec.den - spec.num) // spec.den
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-signatures // PART_SIGNATURES))
    signs = rows.select("role", "text").mapInArrow(_signatures(spec, sketch, parts, runs / len(sketch.value)), "part int, sid array<long>, n array<int>, role array<int>, cnt array<int>, sig array<int>, pos array<short>")
    pairs = _all_pairs(signs.repartitionById(parts, F.col("part")).mapInArrow(_pairs(spec, crossed), _PAIRS), spec, crossed, parts)
    classes = found.select("sid", "n", *words).groupBy("sid").agg(F.first("n").alias("n"), *(F.first(b).alias(b) for b in words))
    left = classes.select(F.col("sid").alias("a"), F.col("n").alias("na"), *(F.col(b).alias(f"a{b}") for b in words))
    right = classes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), *(F.col(b).alias(f"b{b}") for b in words))
    unlike = _unlike(F.col("na"), F.col("nb"))
    least = F.ceil((F.col("na") + F.col("nb")) * spec.num / F.lit(spec.num + spec.den) - 1e-9)
    near = pairs.join(left, "a").join(right, "b").where(unlike <= F.col("na") + F.col("nb") - 2 * least).select("a", "b")
    near = cut(near, "near")

    bloom = spark.sparkContext.broadcast(_bloom(near.select(F.explode(F.array("a", "b")).alias("sid")).distinct()))
    sets = rows.select("text").mapInArrow(_members(spec, bloom), "sid long, runs binary").dropDuplicates(["sid"])
    both = near.join(sets.select(F.col("sid").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("runs").alias("y")), "b")
    links = cut(both.select("a", "b", "x", "y").mapInArrow(_verify(spec), "a long, b long"), "links")
    return Joined(found.select("id", "role", "sid", "n").dropDuplicates(["id"]), links)
