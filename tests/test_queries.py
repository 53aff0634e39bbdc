"""Every query of the engine gives what its SQL gives in DuckDB."""

import os

import duckdb
import pytest

from quarry.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, round(x, 6) if isinstance(x, float) else x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = ordered([tuple(r[n] for n in names) for r in df.collect()])
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = ordered([tuple(r[i] for i in at) for r in result.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 1e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_the_engine_stands_without_the_training_data_operators():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[1]
    for f in (root / "quarry").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"quarry\.llm|from quarry import llm", f.read_text()), f
