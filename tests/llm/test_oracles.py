"""Queries of the subpackage against their SQL on the smallest tables; those without SQL run and keep to their columns."""

import pytest
from conftest import DATA

from lexmill.llm.oracles import ORACLES
from lexmill.llm.queries import QUERIES

FOUND = {"p1_found": ["term", "mark"], "p2_found": ["id_a", "id_b"], "p3_found": ["id_a", "id_b"], "p4_found": ["id"], "p5_found": ["id_a", "id_b"], "p6_found": ["id", "line_no"], "p9_found": ["doc_id", "subject_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in FOUND:
        assert df.columns == FOUND[name]
    got = df.collect()
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        order = lambda cols, rows: sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
        assert order(df.columns, got) == order(columns, want.fetchall())
