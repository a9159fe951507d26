"""Each timeline query against its SQL, and the driver's entry points."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from streamloom.plans import oracles, queries

ROOT = Path(__file__).parents[1]


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def data(request):
    """A folder of tables, and DuckDB over it; the larger one has ties that the other lacks."""
    folder, db = f"/root/testdata/{request.param}", duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return folder, db


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(name, spark, data):
    got = driver.queries()[name](spark, data[0])
    want = data[1].sql(oracles.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = rows(got.columns, got.collect())
    assert found and found == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert 0 < driver.entry(spark).count() <= 10


def test_every_query_has_a_name_of_its_own_sql():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_training_data_package(tmp_path, gone):
    for p in ROOT.iterdir():
        if p.name not in ("streamloom", ".git", *gone):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "streamloom").mkdir()
    for p in (ROOT / "streamloom").iterdir():
        if p.name != "llm":
            (tmp_path / "streamloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert 'chat_spikes' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
