"""Subject areas of documents (problem 9): averaged word and subword embeddings with independent logistic outputs.

A sentence is the mean of its words' vectors, a word's vector the sum of its own row and the mean of its subwords' rows of
one hashed table.  A logistic output per subject gives the chance that a sentence is about it, and a document treats a
subject if at least ``QUARTER`` of its sentences are.  Labels are per document, so the document's fraction is trained: the
gradient reaches the sentences through it.  Training is spread over partitions: in every step each partition gives the
gradient of its documents at the shared parameters, their sum is the gradient of all, and one optimiser (Adam) steps.
Annotators who disagree give a label between 0 and 1.

A second model of the same kind then learns the sentences themselves, as the first one sees them, over all documents, a
slice of them a step: it can't fit the annotators' errors, it knows the words of all documents, and it gives chances near
0 or 1.  That one scores every document.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import bounded_sample
from ..session import cut, drop_shared, write_shared
from . import kernels

#: Most labelled documents used for training, and partitions they are spread over.
LABELLED, PARTITIONS = 4000, 4
#: Steps after which the first model is held against the labels, most such rounds, and the agreement at which it ends.
STEPS, MOST_ROUNDS, AGREED = 16, 8, 0.93
#: Steps of the second model; documents of a step at least.  So every document is used, and from their product on once.
SLICES, SLICE_DOCS = 32, 2000
#: Documents of a partition in a step of the second model; arrays of gradients that are sent to the driver as they are.
PART_DOCS, MOST_SUMS = 20_000, 16
BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (4, 5)
#: Chance from which the first model counts a sentence as about a subject, and how near to it a case is doubtful.
ABOUT, DOUBT = 0.3, 0.06
#: Chance from which the second model counts a sentence.
COUNTED = 0.4
QUARTER, SHARPNESS, RATE, SMOOTH = 0.25, 20.0, 0.05, 0.05


def sentences(column: pa.Array):
    """(first record, words, sentence of each word, record of each sentence) by chunk.

    A sentence ends at ``.``, ``!`` or ``?`` before white space or the end, at an empty line, and at a line's end after a
    comma or colon.  Stretches without words aren't sentences, nor are those not ended by one of the three signs (greetings,
    names), unless the record has no other.
    """
    for at, raw, offsets in kernels.text_chunks(column):
        words = kernels.words_of(raw, offsets, kernels.FOLD_LETTERS)
        n = len(raw)
        if not len(words.hash):
            yield at, words, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        stop = (raw == 46) | (raw == 33) | (raw == 63)
        white = (raw == 32) | (raw == 10) | (raw == 13) | (raw == 9)
        after = np.ones(n, bool)
        after[:-1] = white[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = True  # a record's last byte, whatever the next one begins with
        ends = stop & after
        line = raw == 10
        ends[1:] |= line[1:] & (line[:-1] | (raw[:-1] == 44) | (raw[:-1] == 58))
        count = np.cumsum(ends)
        mark = count[words.start]  # sentence ends before the word
        new = np.ones(len(mark), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (words.doc[1:] != words.doc[:-1])
        number, doc = np.cumsum(new) - 1, words.doc[new]
        closing = np.append(np.flatnonzero(ends), n)
        close = closing[np.searchsorted(closing, words.end[np.append(new[1:], True)], "left")]
        whole = (close < offsets[doc + 1]) & np.append(stop, False)[close]
        whole |= np.bincount(doc[whole], minlength=words.docs)[doc] == 0
        if not whole.all():
            keep = whole[number]
            words = kernels.Words(words.hash[keep], words.doc[keep], words.start[keep], words.end[keep], words.folded, words.docs)
            number, doc = (np.cumsum(whole) - 1)[number[keep]], doc[whole]
        yield at, words, number, doc


@lru_cache(maxsize=300_000)
def buckets_of(word: bytes) -> list[int]:
    """Rows of the table for a word: its own, then those of its subwords; kept, as a worker meets words again and again."""
    framed = b"<" + word + b">"
    grams = {framed[i : i + n] for n in GRAMS if n < len(framed) for i in range(len(framed) - n + 1)}
    return [zlib.crc32(framed) % BUCKETS, *(zlib.crc32(b"#" + g) % BUCKETS for g in sorted(grams))]


class Lexicon:
    """Words by hash, with the table rows of each; grows as texts come in."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.own: list[int] = []
        self.subs: list[list[int]] = []

    def add(self, words: kernels.Words) -> np.ndarray:
        """The number of each word."""
        unique, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        number = np.empty(len(unique), np.int64)
        for i, (h, f) in enumerate(zip(unique.tolist(), first.tolist(), strict=True)):
            k = self.at.get(h)
            if k is None:
                k = self.at[h] = len(self.own)
                rows = buckets_of(words.folded[words.start[f] : words.end[f]].tobytes())
                self.own.append(rows[0])
                self.subs.append(rows[1:] or rows[:1])
            number[i] = k
        return number[inverse]

    def arrays(self, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own row, subword rows, offsets of those) of the words from ``start`` on."""
        subs = self.subs[start:]
        size = np.array([len(s) for s in subs], np.int64)
        at = np.zeros(len(subs) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        flat = np.fromiter((x for s in subs for x in s), np.int64, at[-1])
        return np.array(self.own[start:], np.int64), flat, at


def word_vectors(table: np.ndarray, own: np.ndarray, subs: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(own):
        return np.zeros((0, table.shape[1]), table.dtype)
    return table[own] + np.add.reduceat(table[subs], at[:-1], axis=0) / np.diff(at)[:, None].astype(table.dtype)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def initial(subjects: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.5, (WIDTH, subjects)).astype(np.float32), np.full(subjects, -2.0, np.float32)


def prepared(texts: list[str]) -> dict[str, np.ndarray] | None:
    """What the gradient of these documents needs of them; None without any word."""
    lexicon = Lexicon()
    word, sent, doc = [], [], []
    base = 0
    for at, words, s, d in sentences(pa.array(texts, pa.large_string())):
        word.append(lexicon.add(words))
        sent.append(s + base)
        doc.append(d + at)
        base += len(d)
    word, sent, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, sent, doc))
    if not len(word):
        return None
    own, subs, at = lexicon.arrays()
    first = np.flatnonzero(np.diff(sent, prepend=-1))
    doc_first = np.flatnonzero(np.diff(doc, prepend=-1))
    by_word = np.argsort(word, kind="stable")
    rows = np.concatenate([own, subs])
    order = np.argsort(rows, kind="stable")
    row_first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    size = np.diff(at)
    return {
        "word": word, "own": own, "subs": subs, "at": at, "first": first, "size": np.diff(first, append=len(sent)).astype(np.float32),
        "doc_first": doc_first, "docs": doc[doc_first], "in_doc": np.repeat(np.arange(len(doc_first)), np.diff(doc_first, append=len(doc))),
        "word_first": np.flatnonzero(np.diff(word[by_word], prepend=-1)), "sent_by_word": sent[by_word], "row_first": row_first, "touched": rows[order][row_first],
        "source": np.concatenate([np.arange(len(own)), np.repeat(np.arange(len(own)), size)])[order],
        "share": np.concatenate([np.ones(len(own)), np.repeat(1 / size, size)]).astype(np.float32)[order, None],
    }


def _chances(d: dict, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector of each sentence, and its chances."""
    h = np.add.reduceat(word_vectors(model[0], d["own"], d["subs"], d["at"])[d["word"]], d["first"], axis=0) / d["size"][:, None]
    return h, _sigmoid(h @ model[1] + model[2])


def gradient(d: dict, model: tuple, labels: np.ndarray | None = None, teacher: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sums over these documents of the gradients of table, outputs and biases, and how many cases they are.

    Without ``labels``, the ``teacher``'s view of each sentence is learned; doubtful ones count nothing.
    """
    h, p = _chances(d, model)
    if teacher is None:
        y = labels[d["docs"]] * (1 - 2 * SMOOTH) + SMOOTH
        count = np.bincount(d["in_doc"]).astype(np.float32)[:, None]
        q = np.add.reduceat(p, d["doc_first"], axis=0) / count
        e = SHARPNESS * (_sigmoid(SHARPNESS * (q - QUARTER)) - y)
        dz, cases = (e / count)[d["in_doc"]] * p * (1 - p), len(d["docs"])
    else:
        was = _chances(d, teacher)[1]
        dz, cases = (p - (was >= ABOUT).astype(np.float32)) * (np.abs(was - ABOUT) > DOUBT), len(p)
    dh = (dz @ model[1].T) / d["size"][:, None]
    dv = np.add.reduceat(dh.astype(np.float32)[d["sent_by_word"]], d["word_first"], axis=0)
    dt = np.zeros(model[0].shape, np.float32)
    dt[d["touched"]] = np.add.reduceat(dv[d["source"]] * d["share"], d["row_first"], axis=0)
    return dt, (h.T @ dz).astype(np.float32), dz.sum(axis=0).astype(np.float32), cases


class Adam:
    """The optimiser's state, one for all partitions."""

    def __init__(self, model: tuple) -> None:
        self.model, self.t = tuple(x.copy() for x in model), 0
        self.moments = [(np.zeros_like(x), np.zeros_like(x)) for x in model]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, (m, v) in zip(self.model, grads, self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def agreement(d: dict, model: tuple) -> np.ndarray:
    """(agreed, given, labelled): cases where the model's view of a document, its labels, or both have a subject."""
    q = np.add.reduceat(_chances(d, model)[1], d["doc_first"], axis=0) / np.bincount(d["in_doc"])[:, None]
    given, true = q >= QUARTER, d["labels"][d["docs"]] > 0.5
    return np.array([(given & true).sum(), given.sum(), true.sum()], float)


def fractions(column: pa.Array, scorer: Scorer) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first record, sentences of each record, share of them about each subject) by chunk."""
    for at, words, sent, doc in sentences(column):
        logits = scorer.words(words)
        if not len(doc):
            yield at, np.zeros(words.docs, np.int64), np.zeros((words.docs, scorer.subjects))
            continue
        first = np.flatnonzero(np.diff(sent, prepend=-1))
        z = np.add.reduceat(logits, first, axis=0) / np.diff(first, append=len(sent))[:, None] + scorer.bias
        n = np.bincount(doc, minlength=words.docs)
        q = np.zeros((words.docs, scorer.subjects))
        have = np.flatnonzero(np.diff(doc, prepend=-1))
        q[doc[have]] = np.add.reduceat((_sigmoid(z) >= COUNTED).astype(np.float64), have, axis=0)
        yield at, n, q / np.maximum(n, 1)[:, None]


class Scorer:
    """Logits of words under a trained model; a word's are worked out once."""

    def __init__(self, model: tuple) -> None:
        self.table, self.out, self.bias = model
        self.subjects = len(self.bias)
        self.clear()

    def clear(self) -> None:
        self.lexicon, self.known = Lexicon(), np.zeros((0, self.subjects), np.float32)

    def words(self, words: kernels.Words) -> np.ndarray:
        if len(self.known) > 500_000:
            self.clear()
        number = self.lexicon.add(words)
        fresh = self.lexicon.arrays(len(self.known))
        if len(fresh[0]):
            self.known = np.concatenate([self.known, word_vectors(self.table, *fresh) @ self.out])
        return self.known[number]


_SUMS = "table binary, out binary, bias binary, cases long"


def _sums(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    total = None
    for one in found:
        total = one if total is None else tuple(a + b for a, b in zip(total, one, strict=True))
    if total is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in total[:3]), pa.array([total[3]], pa.int64())], names=["table", "out", "bias", "cases"])


def _labelled_sums(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = (pickle.loads(x) for batch in batches for x in batch.column(0).to_pylist())  # written by _store
        yield from _sums(gradient(d, model.value, labels=d["labels"]) for d in stored)

    return run


def _sentence_sums(model, teacher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = (prepared(batch.column(0).to_pylist()) for batch in batches)
        yield from _sums(gradient(d, model.value, teacher=teacher.value) for d in ready if d)

    return run


def _store(subjects: int):
    """Documents of a partition as :func:`prepared` gives them, with their labels, so that no step tells words apart again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        d = prepared(texts) if texts else None
        if d:
            d["labels"] = np.array(labels, np.float32).reshape(len(texts), subjects)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(d, 5)], pa.binary())], names=["stored"])

    return run


def _added(shapes: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _sums((*(np.frombuffer(zlib.decompress(x), np.float32).reshape(k) for x, k in zip(r, shapes, strict=False)), r[3]) for r in rows)

    return run


def _step(adam: Adam, rows: DataFrame, sums, parts: int = PARTITIONS) -> bool:
    """One step of the optimiser along the summed gradients of ``rows``, of about ``parts`` partitions; False without any."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(adam.model)
    found = rows.mapInArrow(sums(shared), _SUMS)
    if parts > MOST_SUMS:  # added up in groups first, so that few arrays reach the driver
        found = found.repartition(math.isqrt(parts)).mapInArrow(_added([x.shape for x in adam.model]), _SUMS)
    parts = found.collect()
    shared.destroy()
    cases = sum(r.cases for r in parts)
    if cases:
        adam.step([sum(np.frombuffer(zlib.decompress(r[i]), np.float32) for r in parts).reshape(x.shape) / np.float32(cases) for i, x in enumerate(adam.model)])
    return bool(cases)


def _agreement(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                d = pickle.loads(x)
                counts = agreement(d, model.value)
                yield pa.RecordBatch.from_arrays([pa.array([float(c)]) for c in counts], names=["agreed", "given", "labelled"])

    return run


def train(rows: DataFrame, subjects: int) -> tuple:
    """Parameters trained on ``rows(text, y)``, ``y`` a label from 0 to 1 for each subject."""
    stored = cut(rows.mapInArrow(_store(subjects), "stored binary"), "training")
    adam = Adam(initial(subjects))
    for _ in range(MOST_ROUNDS):
        for _ in range(STEPS):
            if not _step(adam, stored, _labelled_sums):
                return adam.model
        told = rows.sparkSession.sparkContext.broadcast(adam.model)
        seen = stored.mapInArrow(_agreement(told), "agreed double, given double, labelled double").groupBy().sum().first()
        if 2 * (seen[0] or 0) >= AGREED * ((seen[1] or 0) + (seen[2] or 0)):
            break
    return adam.model


def train_sentences(documents: DataFrame, teacher: tuple) -> tuple:
    """Parameters trained on the teacher's view of the sentences of all of ``documents(doc_id, text)``, a slice of them a step."""
    spark = documents.sparkSession
    total = documents.count()
    slices = min(SLICES, max(1, total // SLICE_DOCS))
    each = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(slices)).cast("int").alias("slice")
    parts = max(PARTITIONS, total // (slices * PART_DOCS))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(parts)).alias("part")
    dealt = documents.select("doc_id", "text", each, spread).repartition("slice", "part").select("text", "slice")
    path = write_shared(dealt, "slices", ("slice",))
    told, adam = spark.sparkContext.broadcast(teacher), Adam(initial(len(teacher[2]), 10))
    for t in range(SLICES):
        rows = spark.read.schema("text string, slice int").parquet(path).where(F.col("slice") == t % slices).select("text")
        _step(adam, rows, lambda shared: _sentence_sums(shared, told), parts)
    drop_shared(spark, path)
    return adam.model


def _assign(model, ids: list[int], every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        names = np.array(ids, np.int64)
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for at, n, q in fractions(batch.column(1), scorer):
                doc, subject = np.nonzero((q >= QUARTER) | (every & (n > 0))[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at + doc], pa.int64()), pa.array(names[subject]), pa.array(q[doc, subject].astype(np.float64))], names=["doc_id", "subject_id", "share"])

    return run


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, subject_id, share) for the subjects each of ``documents(doc_id, text)`` treats; ``share`` of its sentences.

    ``labels(doc_id, subject_id, annotator)`` are the hand labels; a null subject is "none of them".  ``subjects`` names
    the outputs.  With ``every``, all subjects of every document with a sentence come out.  Null, empty and wordless
    texts and null doc_ids have no row; repeated rows of a doc_id count once.  Without labels there is nothing to learn
    and no row.
    """
    ids = [r.subject_id for r in subjects.select("subject_id").where("subject_id IS NOT NULL").distinct().orderBy("subject_id").collect()]
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id", "annotator").agg(F.collect_set("subject_id").alias("s"))
    votes = said.groupBy("doc_id").agg(*(F.avg(F.array_contains("s", F.lit(i)).cast("double")).alias(f"y{i}") for i in ids))
    chosen = bounded_sample(votes, "doc_id", LABELLED)
    # at most LABELLED rows, so they are sent to the documents, and only those picked are compared for repeats
    labelled = documents.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", F.array(*(F.col(f"y{i}") for i in ids)).alias("y"))
    first = train(cut(labelled.repartition(PARTITIONS, F.xxhash64("text")), "labelled"), len(ids))
    second = train_sentences(documents, first)
    model = documents.sparkSession.sparkContext.broadcast(second)
    found = documents.mapInArrow(_assign(model, ids, every), "doc_id long, subject_id long, share double")
    return found.dropDuplicates(["doc_id", "subject_id"])
