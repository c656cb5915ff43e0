"""Every query with an SQL twin gives the same rows as DuckDB."""

import math

import pytest

from tidings.plans.oracle import ORACLE
from tidings.plans.queries import QUERIES

# full boosting rounds; test_models has the same checks with few rounds
SLOW = {"compare_contract", "eval_contract", "versions_contract"}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (int(value) if value.is_integer() else value)
    return value


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in ORACLE if n not in SLOW])
def test_same_rows(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(_plain, r)) for r in df.select(*columns).collect()), key=repr)
    result = duck.sql(ORACLE[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    theirs = sorted(
        (tuple(_plain(r[i]) for i in places) for r in result.fetchall()), key=repr
    )
    assert ours == theirs
    assert ours
