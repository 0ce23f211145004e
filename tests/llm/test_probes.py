"""Problem 5 finds neighbours of any cosine when there are many parts."""

import numpy as np

from lexmill.llm import neighbours


def test_recall_at_all_cosines_with_many_parts(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(1500, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, j) for i in range(0, len(x), 20) for j in np.argsort(-s[i])[:5].tolist()}
    monkeypatch.setattr(neighbours, "PART_ROWS", 25)
    got = {(r.id, r.neighbour) for r in neighbours.most_similar(rows, 5, queries="id % 20 = 0").collect()}
    assert len(got & want) >= 0.9 * len(want)
