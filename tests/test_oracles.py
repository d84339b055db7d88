"""Each query of the engine against its SQL in another engine, over whole tables."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def plain(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: [(x is not None, x) for x in r]
    return sorted((tuple(r[i] for i in order) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in found.collect()], found.columns)
    if name not in ORACLES:
        assert got
        return
    answer = duck.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    wanted = plain(answer.fetchall(), columns)
    assert sorted(columns) == sorted(found.columns)
    assert not any(isinstance(x, datetime.datetime) for r in got for x in r)
    odd = [(a, b) for a, b in zip(got, wanted, strict=False) if a != b]
    assert len(got) == len(wanted) and not odd, (len(got), len(wanted), odd[:4])
