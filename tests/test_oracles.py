"""Every registered query against its SQL twin."""

import math

import pytest

import __spark_entry__ as driver
from clickloom.plans import streams  # noqa: F401  (registers the streaming queries)
from clickloom.plans.queries import ORACLES, QUERIES

DUCK_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
}


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


def _table(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(_value(row[i]) for i in order) for row in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    got = _table(result.columns, [tuple(row) for row in result.collect()])
    wanted = duck.execute(ORACLES[name])
    names = [column[0] for column in wanted.description]
    types = {column[0]: str(column[1]) for column in wanted.description}
    assert got == _table(names, wanted.fetchall())
    for column, kind in result.dtypes:
        assert types[column] in (DUCK_TYPE.get(kind, kind), '"NULL"'), (column, kind)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= driver.queries().items()
    assert ORACLES.items() <= driver.oracle_sql().items()


def test_entry(spark):
    assert driver.entry(spark).count() == 744
