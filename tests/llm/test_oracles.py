"""The corpus queries that have SQL against that SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from tillage.llm.oracles import ORACLES
from tillage.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    duck = duckdb.connect()
    for name_ in ("pages", "documents", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{sf_dir}/{name_}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)
