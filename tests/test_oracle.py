"""Every registered query of the reference's own operators against its SQL."""

import glob
import math
import os

import duckdb
import pytest

from sheetlens.plans import catalogue

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    """Text that is equal where values are: doubles to nine digits, all else exactly."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    if type(x).__name__ == "Decimal":
        return f"{x.normalize():f}"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(plain, x)) + "]"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLES:
        assert got[0]
        return
    rel = duck.execute(catalogue.ORACLES[name])
    want = rows([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_comparison_sees_single_units():
    assert plain(1_700_000_000_123) != plain(1_700_000_000_124) and plain(True) != plain(1) and plain(0.1 + 0.2) == plain(0.3)
    assert rows(["b", "a"], [(2, 1), (1, 1)]) == rows(["a", "b"], [(1, 1), (1, 2)]) != rows(["a", "b"], [(1, 1), (1, 3)])
