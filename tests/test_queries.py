"""Every query of the core against its SQL on the smallest tables, and the core's independence."""

import os
import re

import pytest

from conftest import DATA, ROOT
from lexmill.plans.oracles import ORACLES
from lexmill.plans.queries import QUERIES


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([x[i] + 0.0 if isinstance(x[i], float) else x[i] for i in at]) for x in found)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"logreg_train", "logreg_predict", "logreg_evaluate"}))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_core_does_not_need_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "lexmill")):
        if os.path.basename(folder) != "llm":
            for name in (n for n in names if n.endswith(".py")):
                assert not re.search(r"^\s*(from|import)\s.*\bllm\b", open(os.path.join(folder, name)).read(), re.M), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
