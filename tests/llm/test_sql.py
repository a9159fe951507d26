"""The operators that SQL can express against their DuckDB SQL, over whole tables."""

from pathlib import Path

import duckdb
import pytest

from streamloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf_dir):
    db = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir), db.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    order = [want.columns.index(c) for c in columns]
    found = sorted((tuple(map(clean, r)) for r in got.select(columns).collect()), key=repr)
    assert found and found == sorted((tuple(clean(r[k]) for k in order) for r in want.fetchall()), key=repr)
