"""Encoding repair, mail lines, packing, mixing, neighbours and subjects: round trips, brute force, held-out accuracy, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import encoding, mixing, neighbours, newtext, packing, subjects, tokens

ENGLISH = "the café of the naïve résumé is for you and it was from Zoë"
GERMAN = "die Prüfung für das Gerät und die Größe über den Straßen"
RUSSIAN = "просит вернуть договор до пятницы для отчёт и номер код"


def reader():
    texts = [f"{t} {i}" for i in range(30) for t in (ENGLISH, GERMAN, RUSSIAN, "é à — “x” €")]
    return encoding.Reader(encoding.train_dictionaries(texts))


@pytest.mark.parametrize("read,written", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp1252", "cp1251"), ("koi8_r", "cp1251")])
def test_encoding_round_trip(read, written):
    r = reader()
    for text in (GERMAN, ENGLISH, RUSSIAN) if written == "utf-8" else (RUSSIAN,):
        try:
            garbled = text.encode(written).decode(read)
        except UnicodeDecodeError:
            continue
        fixed, how, lost = r.repair("so " + garbled)
        assert fixed == "so " + text and how and not lost
        twice = garbled.encode("utf-8").decode("latin-1") if written == "utf-8" else None
        if twice and read in ("cp1252", "latin-1") and text != RUSSIAN:
            assert r.repair(twice)[0] == text


def test_right_text_is_left_alone():
    r = reader()
    for text in (ENGLISH, GERMAN, RUSSIAN, RUSSIAN.upper(), "ÎLE DE SÃO, REUNIÃO 4 × 9 ± 2 µm ½ ª", "&eacute; =E9", ""):
        assert r.repair(text) == (text, [], False)
    assert r.repair("lost �")[2] and r.repair("\x80 left")[2]


def odd_texts(spark, *more):
    rows = [(1, None), (2, ""), (3, "   "), (None, "x Ã© y"), (4, "Ã© " * 50_000), (4, "Ã© " * 50_000), (5, "plain"), *more]
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "id long, text string, h int, label string")


def test_garbled(spark):
    rows = odd_texts(spark, (6, "was schÃ¶n"), (7, "schön"), (8, "sch�n"))
    got = {r.id: r for r in encoding.garbled(rows).collect()}
    assert set(got) == {4, 6, 8} and got[6].restored == "was schön" and got[8].lost and got[8].chains == ""
    assert {r.id for r in encoding.garbled(rows, restore=False).collect()} == {4, 6, 8}
    assert encoding.garbled(rows.limit(0)).count() == 0


MAIL = """From: A B <a@b.example>
Subject: Re: lunch

Hi Anna,
see below what I thought about the plan.

On 2 Jul 2023, Anna Bell wrote:
> shall we meet
> on Monday?

Yes, at noon.

Best regards,
Tom Smith
Accounts, Basux Ltd
phone +00 555 0148

****************************************
This message and its attachments are confidential and meant only for
the addressee.
"""


def new_of(text):
    model, again = newtext.train([MAIL] * 5)
    lines = text.split("\n")
    s = newtext._joined(*newtext.features(lines), again)
    path = newtext.best_paths([s], model)[0]
    return [i + 1 for i in range(len(lines)) if s[i] and path[i] == newtext.NEW]


def test_mail_lines():
    assert new_of(MAIL) == [4, 5, 11]
    forward = "FYI\n\n---------- Forwarded message ----------\nFrom: X\nTo: Y\n\nold text here\n\nCheers,\nX"
    assert new_of(forward) == [1]
    assert new_of("call me\n\nSent from my pocket phone") == [1]
    assert new_of("When Anna wrote: sort it, I thought\nof Monday and the rest.") == [1, 2]
    assert new_of("") == []


def test_best_paths_as_one_by_one():
    model = newtext.prior()
    rng = random.Random(1)
    runs = [[rng.randrange(newtext.PLAIN) for _ in range(rng.randint(0, 30))] for _ in range(40)]
    together = newtext.best_paths(runs, model)
    for run, path in zip(runs, together, strict=True):
        assert path.tolist() == (newtext.best_paths([run], model)[0].tolist() if run else [])


def test_new_lines(spark):
    rows = odd_texts(spark, (9, MAIL), (9, MAIL), (10, "a\r\n\r\n> b\r\nc"))
    got = {}
    for r in newtext.new_lines(rows).collect():
        got.setdefault(r.id, []).append(r.line_no)
    assert sorted(got[9]) == [4, 5, 11] and 2 not in got and 3 not in got and got[5] == [1]
    assert newtext.new_lines(rows.limit(0)).count() == 0
    notice = "\n".join(MAIL.split("\n")[16:])  # told by how many mails hold it
    more = spark.createDataFrame([(20 + i, f"Item {i} is here.\n\n{notice}") for i in range(8)], "id long, text string")
    labels = {r.line_no: r.label for r in newtext.labelled_lines(rows.select("id", "text").unionAll(more)).where("id = 9").collect()}
    assert labels[1] == "header" and labels[8] == "quoted" and labels[14] == "signature" and labels[19] == "notice"


def test_sum_of_squares_keeps_capacity():
    sizes = np.random.default_rng(1).integers(1, 100, 3000)
    where, fill = packing.sum_of_squares(sizes, 128)
    assert (np.bincount(where, weights=sizes).astype(int) == fill).all() and fill.max() <= 128
    assert sizes.sum() / (len(fill) * 128) > 0.97


def test_pack(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.choice([3, 50, 100, 101, 250, 1000]), "x") for i in range(400)] + [(5000, 0, "x"), (5001, None, "x"), (None, 7, "x"), (0, None, "y")][:3]
    sized = spark.createDataFrame(rows + rows[:3], "doc_id long, tokens long, shard string")
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 10_000)
    got = packing.pack(sized, 100).collect()
    total, places = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        places.setdefault(r.window, []).append((r.offset, r.tokens))
    assert total == {i: n for i, n, _ in rows if i is not None and n}
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r.tokens)
    assert all(len(p) == 1 or sum(p) > 100 for p in pieces.values())
    assert packing.pack(sized.limit(0), 100).count() == 0


def test_pack_documents(spark):
    docs = odd_texts(spark).withColumnRenamed("id", "doc_id").where("doc_id IS NOT NULL")
    sizes = spark.createDataFrame([("s", 64), ("none", 0), ("null", None)], "container string, capacity_tokens int")
    packed = packing.pack_documents(docs, sizes)
    assert {r.container for r in packed.collect()} == {"s"}
    report = packing.pack_report(packed, sizes).first()
    assert report.tokens == packed.agg(F.sum("tokens")).first()[0] and report.fill > 0.9


def test_token_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tokens.VOCABULARY, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "", "Größe <|endoftext|>\n\n x", "a" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(rows, "text").collect()}
    assert got == {i: len(coder.encode_ordinary(t)) for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        assert coder.decode(coder.encode_ordinary(t)) == t


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([" Big", "big", "BIG", "small-one", "Small_One", None, "other"]), "word " * rng.randint(1, 400)) for i in range(600)]
    docs = [d for d in docs if d[1] not in ("small-one", "Small_One") or d[0] % 4 == 0]
    rows = spark.createDataFrame(docs + docs[:5] + [(None, "big", "x"), (9000, "big", None), (9001, "big", "")], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("big", 0.6, 1), ("small one", 0.4, 4), ("absent", 0.0, 2), (None, 0.1, 1), ("gone", 0.2, 0)], "source string, target_share double, max_repeats int")
    copies = mixing.mix(rows, weights)
    got = {r.source: r for r in mixing.mix_report(copies, weights).collect()}
    assert abs(got["big"].actual_share - 0.6) < 0.01 and got["small_one"].most_copies <= 4
    assert got["absent"].tokens_used == 0 and copies.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.mix(rows.limit(0), weights).count() == 0
    assert mixing.mix(rows, weights.limit(0)).count() == 0


def test_rates_reach_the_goal(spark):
    rng = np.random.default_rng(4)
    t = rng.integers(1, 2000, 500).tolist()
    hist = spark.createDataFrame([("a" if i % 5 else "b", x, 1) for i, x in enumerate(t)], "source string, tokens long, n long")
    rates = mixing.solve_rates(hist, [("a", 0.5, 1), ("b", 0.5, 3)])
    sums = {}
    for i, x in enumerate(t):
        s = "a" if i % 5 else "b"
        l, mean, cap = rates[s]
        sums[s] = sums.get(s, 0) + x * min(cap, np.exp(min(l / mean * x, 50)))
    assert sums["a"] == pytest.approx(sums["b"], rel=1e-5)


def vectors(n=1500, d=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    return np.abs(centres[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)


def test_neighbours_recall(spark, monkeypatch):
    x = vectors()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i])[:5].tolist()}
    monkeypatch.setattr(neighbours, "PART_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 200)
    got = neighbours.most_similar(rows, 5).collect()
    assert len({(r.id, r.neighbour) for r in got} & want) >= 0.9 * len(want)
    assert {r.id for r in got} == set(range(len(x))) and max(r.rank for r in got) == 5
    assert all(abs(r.cosine - s[r.id, r.neighbour]) < 1e-6 for r in got)
    asked = neighbours.most_similar(rows, 5, queries="id % 20 = 0").collect()
    assert {r.id for r in asked} == set(range(0, len(x), 20))


def test_neighbours_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (3, [2.0, None]), (4, None), (5, [0.0, 0.0]), (6, []), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [float("nan"), 1.0])]
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "row_id long, features array<float>, part int, id string")
    got = {(r.id, r.rank): (r.neighbour, round(r.cosine, 6)) for r in neighbours.most_similar(table, 2).collect()}
    assert got[1, 1] == (2, 1.0) and got[1, 2] == (3, 1.0) and got[3, 1] == (1, 1.0) and got[7, 1] == (8, 1.0)
    assert {i for i, _ in got} == {1, 2, 3, 7, 8}
    assert neighbours.most_similar(table.limit(0), 2).count() == 0
    assert {tuple(r) for r in neighbours.similar_pairs(table, 2).collect()} == {(1, 2), (1, 3), (2, 3), (7, 8)}


WORDS = {1: "compiler server database parser kernel".split(), 2: "court lawyer verdict appeal statute".split()}


def lessons(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        subject = rng.choice([None, 1, 2])
        lines = [f"We saw the {rng.choice('table chair window garden'.split())} of {rng.randint(1, 9)} today." for _ in range(rng.randint(3, 6))]
        if subject:
            lines += [f"The {rng.choice(WORDS[subject])} and the {rng.choice(WORDS[subject])} are here!" for _ in range(rng.randint(3, 6))]
        rng.shuffle(lines)
        out.append((i, " ".join(lines), subject))
    return out


def test_subjects_held_out(spark):
    rows = lessons(400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "..."), (None, "court"), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, s, a) for i, _, s in rows[:200] for a in ("x", "y")], "doc_id long, subject_id long, annotator string")
    names = spark.createDataFrame([(1, "software"), (2, "law")], "subject_id long, subject string")
    found = subjects.subject_areas(docs, labels, names).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.subject_id)
    right = sum(got.get(i, set()) == ({s} if s else set()) for i, _, s in rows[200:])
    assert right >= 185 and not set(got) & {9000, 9001, 9002, None} and len(found) == len({(r.doc_id, r.subject_id) for r in found})
    every = subjects.subject_areas(docs, labels, names, every=True)
    assert every.count() == 800
    assert subjects.subject_areas(docs.limit(0), labels, names).count() == 0


def test_sentences_are_cut():
    texts = ["Hi Ann,\nOne two. Three 4.5 five! Six?\n\nBest,\nTom", "", "...", "no end", "One two. three", "(end.)"]
    (at, words, sent, doc), *_ = subjects.sentences(pa.array(texts))
    assert doc.tolist() == [0, 0, 0, 3, 4, 5] and np.bincount(sent).tolist() == [2, 4, 1, 2, 2, 1]
    assert len(words.hash) == len(sent)


def test_sentences_do_not_depend_on_neighbours():
    """A text's last sentence counts whether or not another text follows."""
    texts = ["One two. Three four!", "five six? Seven", "eight."]
    alone = [[len(sent) for _, _, sent, _ in subjects.sentences(pa.array([t]))] for t in texts]
    (_, words, sent, doc), *_ = subjects.sentences(pa.array(texts))
    assert np.bincount(doc).tolist() == [2, 1, 1] and [sum(a) for a in alone] == np.bincount(words.doc).tolist()


class Kept:
    """An optimiser that keeps the gradient it is given."""

    def __init__(self, model):
        self.model = model

    def step(self, grads):
        self.grads = grads


def test_subject_gradients_add_up(spark, monkeypatch):
    """However the documents are spread and their gradients added, a step is along the one over all of them."""
    texts = [f"the judge read the law {i}. stars and atoms, said the physicist!" for i in range(40)]
    model, teacher = subjects.initial(2), subjects.initial(2, 3)
    *whole, cases = subjects.gradient(subjects.prepared(texts), model, teacher=teacher)
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    told = spark.sparkContext.broadcast(teacher)
    for most in (16, 2):
        monkeypatch.setattr(subjects, "MOST_SUMS", most)
        kept = Kept(model)
        assert subjects._step(kept, rows, lambda shared: subjects._sentence_sums(shared, told), 5)
        for got, want in zip(kept.grads, whole, strict=True):
            assert np.allclose(got, want / cases, atol=1e-6)
