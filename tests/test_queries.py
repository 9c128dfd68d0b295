"""Each query of the library against its SQL in DuckDB, value for value."""

import math

import pytest

from quartermill.plans.registry import ORACLES, QUERIES

from .conftest import DATA


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in ORACLES:
        sql = duck.execute(ORACLES[name])
        names = [c[0] for c in sql.description]
        assert sorted(names) == sorted(df.columns)
        want = rows_of(names, sql.fetchall())
        assert len(got) == len(want)
        bad = [(g, w) for g, w in zip(got, want) if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, (float, int)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4)) for a, b in zip(g, w))]
        assert not bad, (len(bad), bad[:3])
