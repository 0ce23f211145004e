"""Nearest neighbours of texts on all TF-IDF features, and sparse vectors against dense ones."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import knn
from lexmill.plans.queries import QUERIES


def test_sparse_neighbours_as_dense(spark, monkeypatch):
    rng = np.random.default_rng(3)
    full = np.where(rng.random((60, 30)) < 0.2, rng.integers(1, 5, (60, 30)), 0).astype(float)
    full[7] = 0
    dense = spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(full)], "id long, v array<double>, label int")
    sparse = spark.createDataFrame([(i, np.flatnonzero(r).tolist(), r[r > 0].tolist(), i % 2) for i, r in enumerate(full)], "id long, at array<int>, v array<double>, label int")
    plain = lambda rows: sorted(map(tuple, rows.collect()))
    monkeypatch.setattr(knn, "BLOCK", 25)
    assert plain(knn.top_k(sparse, sparse.drop("label"), 4)) == plain(knn.top_k(dense, dense.drop("label"), 4))
    assert plain(knn.predict(sparse, sparse.drop("label"), 5)) == plain(knn.predict(dense, dense.drop("label"), 5))
    assert knn.top_k(sparse.where("id = 7"), sparse.drop("label"), 3).where("sim = 0").count() == 60


def brute_force_texts(rows, k):
    terms = {}
    for i, _, _, text in rows:
        w = text.split()
        terms[i] = Counter(w + [" ".join(p) for p in zip(w, w[1:], strict=False)])
    train = sorted(i for i, s, *_ in rows if s == "train")
    label = {i: y for i, _, y, _ in rows}
    df = Counter(t for i in train for t in terms[i])
    tf = sum((terms[i] for i in train), Counter())
    at = {t: j for j, t in enumerate(sorted(sorted((t for t in df if df[t] >= 5), key=lambda t: (-tf[t], t))[:5000]))}
    assert len(at) > 300 and any(" " in t for t in at)
    idf = {t: np.log((1 + len(train)) / (1 + df[t])) + 1 for t in at}

    def vector(i):
        v = np.zeros(len(at))
        for t, n in terms[i].items():
            if t in at:
                v[at[t]] = n * idf[t]
        return v / (np.linalg.norm(v) or 1)

    x = np.array([vector(i) for i in train])
    y = np.array([label[i] for i in train])
    out = {}
    for i, s, *_ in rows:
        if s == "test" and i % 20 == 0:
            q = vector(i)
            votes = y[np.argsort(-np.round(x @ q, 9), kind="stable")[:k]]
            best = (int(votes.sum() * 2 > len(votes)) if q.any() else int(y.mean() > 0.5))
            p = (votes == best).sum() / k if q.any() else 1.0
            out[i] = (best, *((0.0, round(p, 6)) if best else (round(p, 6), 0.0)))
    return out


def test_knn_text_uses_all_features(spark, tmp_path):
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(f"w{a:03d} v{a:03d}" if b else f"v{a:03d} w{a:03d}" for a, b in zip(rng.integers(0, 400, n), rng.random(n) < 0.5, strict=True))
    rows = [(i, "test" if i % 20 == 0 else "train", int(rng.random() < 0.4), say(25)) for i in range(400)]
    rows[40] = (40, "test", 1, "nothing known")
    table = spark.createDataFrame(rows, "id long, split string, label int, text string").withColumn("label", F.col("label").cast("string"))
    table.write.parquet(f"{tmp_path}/spam_assassin_preprocessed.parquet")
    got = {r.qid: (r.label, r.p0, r.p1) for r in QUERIES["knn_text"](spark, str(tmp_path)).collect()}
    assert got == brute_force_texts(rows, 9)
