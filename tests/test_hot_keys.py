"""Components, and joins in which a key holds many rows, against plain ones."""

import pytest

from lexmill import session
from lexmill.operators import components, joins


@pytest.fixture(params=[False, True])
def hot(request, monkeypatch):
    if request.param:  # the hot way already for a few rows
        for module in (joins, components):
            monkeypatch.setattr(module, "FEW_ROWS", 3)
        monkeypatch.setattr(joins, "SPLIT_ROWS", 4)
    return request.param


def rows(spark):
    return spark.createDataFrame([(i, None if i == 40 else 7 if i % 3 else i) for i in range(60)], "id long, k long")


def test_attach(spark, hot):
    facts = spark.createDataFrame([(7, "seven"), (9, "nine")], "k long, name string")
    assert joins.hot_keys(rows(spark), "k") == ({7: 39} if hot else {})
    want = {(i, 7 if i % 3 else i) for i in range(60) if i != 40 and (i % 3 or i == 9)}
    got = joins.attach(rows(spark), facts, "k").collect()
    assert {(r.id, r.k) for r in got} == want and len(got) == len(want)
    assert joins.attach(rows(spark), facts, "k", "left").count() == 60


def test_join_split(spark, hot):
    large, small = rows(spark), rows(spark).withColumnRenamed("id", "other")
    found = joins.join_split(large, small, "k", joins.hot_keys(large, "k"), "id").select("id", "other").collect()
    same = [(a, b) for a in range(60) for b in range(60) if 40 not in (a, b) and (7 if a % 3 else a) == (7 if b % 3 else b)]
    assert sorted(map(tuple, found)) == sorted(same)


def test_components(spark, hot):
    star = [(0, i) for i in range(1, 30)]
    path = [(i, i + 1) for i in range(100, 140)]
    odd = [(None, 1), (5, 5), (0, 3), (None, None)]
    edges = spark.createDataFrame(star + path + odd, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(30)} | {i: 100 for i in range(100, 141)}
    assert components.connected_components(edges.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        components.connected_components(edges, max_rounds=1)


def test_shared_tables_are_deleted(spark, tmp_path):
    import os

    kept = dict(session._tables)
    path = session.write_shared(spark.range(5))
    assert os.path.exists(path.removeprefix("file://"))
    session._tables.clear()
    session._tables[path] = session._deleter(spark, path)
    session.drop_all_shared()
    session._tables.update(kept)
    assert not os.path.exists(path.removeprefix("file://"))
