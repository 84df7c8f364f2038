"""Every query with an SQL equivalent, against it, on the smallest tables."""

import os

import duckdb
import pytest

from deltaloom import queries


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    one = lambda v: bytes(v).hex() if isinstance(v, (bytes, bytearray)) else round(v, 6) if isinstance(v, float) else v
    return sorted(([one(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(name, spark, sf, oracle):
    df = queries.QUERIES[name](spark, sf)
    want = oracle.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), columns)


def test_every_query_has_an_equivalent():
    assert set(queries.SQL) == set(queries.QUERIES)


def test_nothing_outside_imports_the_optional_subpackage():
    root = os.path.dirname(queries.__file__)
    for folder, _, files in os.walk(root):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as text:
                        assert "llm" not in text.read()
