"""Vectorised text kernels shared by the operators of this subpackage.

A *word* is a longest run of ``[a-z0-9]`` in the lower-cased text.  Words are found on the raw UTF-8 buffer of an Arrow
string column and hashed to 64 bits without making a Python object per word, so that a pass over a corpus costs about as
much as decoding it.  Nulls and empty texts have no words; a text of any length is processed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_FOLD = np.zeros(256, np.uint8)
for _lo, _hi, _shift in ((48, 58, 0), (65, 91, 32), (97, 123, 0)):
    _FOLD[_lo:_hi] = np.arange(_lo, _hi) + _shift
#: As _FOLD, with the bytes of characters outside ASCII as letters too.
FOLD_LETTERS = _FOLD.copy()
FOLD_LETTERS[128:] = np.arange(128, 256)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Characters outside ASCII whose lower case holds an ASCII letter: KELVIN SIGN and CAPITAL I WITH DOT ABOVE.
_ODD = (b"\xe2\x84\xaa", b"\xc4\xb0")


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:  # doubling: powers[k + j] = powers[k] * powers[j]
            step = np.uint64(pow(base, done, 1 << 64))
            take = min(done, size - done)
            out[done : done + take] = out[:take] * step
            done += take
        _POWERS[str(base)] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a run of records: hash, record (position in the run), and byte span in ``folded``."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    folded: np.ndarray
    docs: int


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column


def text_chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES):
    """(first record, folded bytes, record offsets) for runs of whole records of about ``size`` bytes."""
    array = string_array(column)
    if not len(array):
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    body = memoryview(raw[offsets[0] : offsets[-1]]).tobytes() if len(raw) else b""
    if any(x in body for x in _ODD):
        fixed = [None if t is None else t.lower() for t in array.to_pylist()]
        array = pa.array(fixed, pa.large_string())
        offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1)
        raw = np.frombuffer(array.buffers()[2], np.uint8)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _FOLD) -> Words:
    """The words of one chunk of :func:`text_chunks`."""
    docs = len(offsets) - 1
    folded = fold[raw]
    inside = folded != 0
    n = len(folded)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, z, folded, docs)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cuts = offsets[1:-1]
    first[cuts[cuts < n]] = True
    start = np.flatnonzero(inside & first)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~inside[1:]
    end = np.flatnonzero(inside & last) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[folded] * _powers(_BASE, n), out=sums[1:])
    h = mix((sums[end] - sums[start]) * _powers(_BASE_INV, n)[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(h, doc, start, end, folded, docs)


def shingles(words: Words, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of runs of ``k`` consecutive words: (offsets by record, hashes sorted within each record, each once).

    Records with fewer than ``min_words`` words, or fewer than ``k``, have an empty set.
    """
    counts = np.bincount(words.doc, minlength=words.docs)
    h, doc = words.hash, words.doc
    if len(h) < k:
        return np.zeros(words.docs + 1, np.int64), np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9DDFEA08EB382D69) + h[j : len(h) - k + 1 + j]
    out = mix(out)
    at = doc[: len(out)]
    good = (at == doc[k - 1 :]) & (counts[at] >= min_words)
    out, at = out[good], at[good]
    order = np.argsort(out)
    by = at[order]
    order = order[np.argsort(by.astype(np.uint16) if words.docs < 1 << 16 else by, kind="stable")]
    out, at = out[order], at[order]
    if len(out):
        new = np.empty(len(out), bool)
        new[0] = True
        new[1:] = (out[1:] != out[:-1]) | (at[1:] != at[:-1])
        out, at = out[new], at[new]
    offsets = np.zeros(words.docs + 1, np.int64)
    np.cumsum(np.bincount(at, minlength=words.docs), out=offsets[1:])
    return offsets, out
