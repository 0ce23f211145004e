"""Terms, near-duplicates and overlaps against brute force, and their handling of odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import kernels, overlaps, setjoin, terms

LONG = "very long text " * 40_000


def mails(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = [rng.choice(vocab)] * rng.randint(0, 2)
            texts.append(" ".join(words) or "w1")
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(15, 60))))
    return texts


def runs(text, k, least):
    w = re.findall("[a-z0-9]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= least else set()


def alike(a, b, spec):
    return a and b and len(a & b) * spec.den >= spec.num * len(a | b)


def odd(spark):
    text = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty, K"
    rows = [(1, text), (1, text), (2, text.upper().replace(" ", "\n\t")), (3, None), (4, ""), (5, "   "), (None, text), (6, LONG), (7, LONG), (8, "short"), (9, text.replace("K", "K"))]
    return spark.createDataFrame([(i, t, "train" if i and i % 2 else " TEST ", 0, "x") for i, t in rows], "id long, text string, split string, sid int, part string")


def test_word_hashes_tell_words_apart():
    texts = ["a ab  ba-B9 İx K9", "", None, "ab", "é9é"]
    import pyarrow as pa

    got = []
    for at, raw, offsets in kernels.text_chunks(pa.array(texts), size=8):
        w = kernels.words_of(raw, offsets)
        got += [(at + d, w.folded[s:e].tobytes().decode(), h) for d, s, e, h in zip(w.doc, w.start, w.end, w.hash.tolist(), strict=True)]
    want = [(i, m) for i, t in enumerate(texts) for m in re.findall("[a-z0-9]+", (t or "").lower())]
    assert [(d, w) for d, w, _ in got] == want
    assert len({h for *_, h in got}) == len({w for _, w in want})
    by = {}
    for _, w, h in got:
        assert by.setdefault(w, h) == h


@pytest.mark.parametrize(("hot", "block"), [(4096, 4096), (2, 4096), (4096, 3)])
@pytest.mark.parametrize("spec", [overlaps.MAIL_COPIES, overlaps.STRICT, setjoin.SetJoin(2, 7, 10, 20)])
def test_links_as_brute_force(spark, monkeypatch, spec, hot, block):
    monkeypatch.setattr(setjoin, "HOT", hot)
    monkeypatch.setattr(setjoin, "HOT_LOAD", 1)
    monkeypatch.setattr(setjoin, "LIST_BLOCK", block)  # as it is pickled with the functions of this process
    texts = mails(3)
    sets = [runs(t, spec.k, spec.min_words) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j], spec)}
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, role int, text string").repartition(3)
    found = setjoin.similar_sets(rows, spec)
    ids = {}
    for r in found.records.collect():
        ids.setdefault(r.sid, []).append(r.id)
    got = {(max(i, j), min(i, j)) for r in found.links.collect() for i in ids[r.a] for j in ids[r.b]}
    got |= {(i, j) for same in ids.values() for i in same for j in same if i > j}
    assert got == want and want


class Value:
    def __init__(self, value):
        self.value = value


def test_full_sketch_makes_few_more_signatures():
    """A sketch as full as at a hundred times the data at most doubles the signatures a record has."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 150) % 50_000) for _ in range(3000)]
    spec = overlaps.MAIL_COPIES
    sets = list(setjoin._sets(spec, pa.array(texts)))
    runs = np.concatenate([h for *_, h in sets])
    made = []
    for bits in (22, 15):  # 2 ** 7 times fuller
        counts = np.bincount((runs >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) * 200.0
        prices = np.minimum(np.round(np.log2(counts + 1) * setjoin.PRICE_STEPS), 255).astype(np.uint8)
        signs = setjoin._signatures(spec, Value(prices), 4, counts.mean())
        batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(texts)], names=["role", "text"])
        made.append(sum(len(x) for b in signs(iter([batch])) for x in b.column(5).to_pylist()))
    assert made[1] <= 2 * made[0]


def test_pairs_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "PAIR_BLOCK", 4)
    groups = spark.createDataFrame([(i, i % 3 // 2) for i in range(40)] + [(99, 7)], "id long, group_id long")
    got = [tuple(r) for r in overlaps.grouped_pairs(groups).collect()]
    assert sorted(got) == [(i, j) for i in range(40) for j in range(i + 1, 40) if i % 3 // 2 == j % 3 // 2]


def test_groups(spark):
    groups = {r.id: (r.group_id, r.links) for r in overlaps.near_duplicate_groups(odd(spark).select("id", "text"), overlaps.MAIL_COPIES).collect()}
    assert set(groups) == {1, 2, 6, 7, 9}
    assert groups[1] == groups[2] == groups[9] == (1, 0) and groups[6] == groups[7] == (6, 0)
    pairs = overlaps.grouped_pairs(overlaps.near_duplicate_groups(odd(spark), overlaps.MAIL_COPIES))
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (1, 9), (2, 9), (6, 7)}
    assert overlaps.near_duplicate_groups(odd(spark).limit(0), overlaps.MAIL_COPIES).count() == 0


def test_chains_are_one_group(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[20 * i : 20 * i + 60]) for i in range(7)]  # neighbours share half of their runs, others don't
    spec = setjoin.SetJoin(1, 1, 2, 5)
    got = {r.id: r for r in overlaps.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spec).collect()}
    assert {r.group_id for r in got.values()} == {0}
    assert got[0].links == 1 and got[3].links == 2


def test_cross_split(spark):
    assert {tuple(r) for r in overlaps.cross_split_pairs(odd(spark)).collect()} == {(1, 2), (2, 9), (6, 7)}
    texts = mails(5)
    splits = ["train", "Test ", "valid", None, "other"]
    rows = [(i, splits[i % 5], t) for i, t in enumerate(texts)]
    spec = overlaps.SPLIT_COPIES
    sets = [runs(t, 2, 20) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(sets[i], sets[j], spec) and {i % 5, j % 5} in ({0, 1}, {0, 2})}
    assert {tuple(r) for r in overlaps.cross_split_pairs(spark.createDataFrame(rows, "id long, split string, text string")).collect()} == want


def test_overlap_report(spark):
    rows = odd(spark).selectExpr("id", "split", "text", "'s' AS source", "CAST(id % 3 AS STRING) AS label")
    found = overlaps.cross_split_pairs(rows)
    got = {(r.split, r.source): r for r in overlaps.overlap_report(rows, found).collect()}
    assert got["test", "s"].records == 4 and got["test", "s"].overlapping == 2 and got["train", "s"].overlapping == 3


def test_terms(spark):
    rows = odd(spark)
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(rows.select("id", "text", "part")).collect()}
    docs = {r.id: r.text for r in rows.collect() if r.id is not None and r.text is not None}
    occ, rec = Counter(), Counter()
    for t in docs.values():
        w = re.findall("[a-z0-9]+", t.lower())
        occ.update(w)
        rec.update(set(w))
    n = len(docs)
    assert got == {t: (occ[t], rec[t], "rare" if rec[t] < 3 else "common" if rec[t] * 5 > n else None) for t in occ}
    assert terms.term_frequencies(rows.limit(0)).count() == 0


def test_parts_of_pairs():
    """Boundaries on one frequent term cost no more than others."""
    import time

    rng = np.random.default_rng(2)
    h, ids = np.sort(rng.integers(0, 5, 1_000_000).astype(np.uint64)), rng.integers(0, 10**9, 1_000_000)
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    at = np.sort(rng.integers(0, len(h), 500))
    bounds = h[at], ids[at] - rng.integers(0, 2, 500)
    began = time.perf_counter()
    got = terms.part_of(h, ids, bounds)
    assert time.perf_counter() - began < 0.3
    for i in rng.integers(0, len(h), 300):
        assert got[i] == sum((b, c) <= (h[i], ids[i]) for b, c in zip(*bounds, strict=True))
    assert terms.part_of(h[:0], ids[:0], bounds).tolist() == [] and not terms.part_of(h, ids, (h[:0], ids[:0])).any()


def test_terms_of_far_ids(spark):
    """Ids over the whole range of 64 bits."""
    rows = spark.createDataFrame([(-(2**63), "a b a"), (2**63 - 1, "b c"), (0, "b")], "id long, text string")
    got = {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(rows).collect()}
    assert got == {"a": (2, 1), "b": (3, 3), "c": (1, 1)}


def test_terms_split_over_partitions(spark):
    """One term in all records, spread over more than one range: counts add up."""
    rows = spark.range(3000).selectExpr("id", "concat('the the w', id % 7) AS text")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(rows).collect()}
    assert got["the"] == (6000, 3000, "common") and got["w3"][1] == 429 and got["w3"][2] is None
