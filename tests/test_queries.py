"""Every registered query of the engine against DuckDB, or its own bounds."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from vesperine.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, np.bool_, int, np.integer)):
        return float(value)  # a nullable long may come as a double
    return float(f"{value:.9g}") if isinstance(value, (float, np.floating)) else str(value)


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, row)) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert table(QUERIES[name](spark, SF).toPandas()) == table(duck.execute(ORACLES[name]).df())


def test_approximate_searches_reach_their_recall(spark):
    for name in ("pq_rerank_recall", "ivf_recall", "simhash_recall", "graph_beam_recall"):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == 5 and sum(r.recall for r in rows) / len(rows) >= 0.9, name


def test_cell_graph_reaches_its_recall(spark):
    assert QUERIES["cell_graph_recall"](spark, SF).first().recall >= 0.9


def test_crc32c_of_all_documents(spark):
    assert QUERIES["crc32c_documents"](spark, SF).filter("crc32c between 0 and 4294967295").count() == 200
