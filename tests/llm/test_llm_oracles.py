"""Queries of the text operators against their SQL twins."""

import math

import pytest

from clickloom.llm.queries import ORACLES, QUERIES


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    ours = QUERIES[name](spark, sf_dir)
    columns = sorted(ours.columns)
    theirs = duck.execute(
        f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) AS twin"
    ).fetchall()
    mine = [tuple(map(plain, row)) for row in ours.select(*columns).collect()]
    assert sorted(mine, key=repr) == sorted((tuple(map(plain, row)) for row in theirs), key=repr)


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
