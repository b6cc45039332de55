"""Every registered query runs; those with SQL give the rows the SQL gives."""

import pytest

from feedmill.plans import catalog
from tests.oracle import compare, connect

NAMES = sorted(catalog.load())


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, con, name):
    query = catalog.QUERIES[name]
    frame = query.run(spark, small)
    if query.sql is None:
        assert frame.count() > 0
    else:
        problems = [p for p in compare(frame, con, query.sql) if p != "empty result"]
        assert not problems, problems


def test_every_operator_has_a_query_or_a_test():
    covered = {i for q in catalog.QUERIES.values() for i in q.ids}
    wanted = (
        {f"S{i}" for i in range(1, 18)} | {f"P{i}" for i in range(1, 20)} | {f"J{i}" for i in range(1, 14)}
        | {f"D{i}" for i in range(1, 12)} | {f"A{i}" for i in range(1, 18)} | {f"W{i}" for i in range(1, 8)}
        | {f"K{i}" for i in range(1, 8)} | {f"U{i}" for i in range(1, 4)} | {f"X{i}" for i in range(1, 25)}
        | {f"V{i}" for i in range(1, 7)} | {f"F{i}" for i in range(1, 7)} | {f"T{i}" for i in range(1, 10)}
        | {f"M{i}" for i in range(1, 11)}
    )
    assert wanted - covered == set()
