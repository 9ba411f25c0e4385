"""Every query of the engine that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestar import queries as engine

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_same_rows(spark, duck, name):
    df = engine.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = duck.sql(engine.ORACLES[name])
    place = [rel.columns.index(c) for c in columns]
    assert found == sorted(repr(tuple(r[i] for i in place)) for r in rel.fetchall())


def test_all_have_an_oracle_but_the_stateful():
    assert set(engine.QUERIES) - set(engine.ORACLES) == {"pq_train", "rng_prune_graph", "ldg_layout", "beam_search", "graph_cache_entry_bfs"}
