import pytest

from roadloom.plans.queries import ORACLES, QUERIES

from .conftest import SF


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) if name in ORACLES else df.collect()
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        order = [want.columns.index(c) for c in columns]
        want = sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=key)
        assert len(got) == len(want)
        assert got == want
    assert got or name == "noise_topk"
