"""Every registered query of the reference's own operators against its SQL, and the entry points without rollcall.llm."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from rollcall.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(columns), sorted(repr([clean(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_like_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry_points_without_the_optional_subpackage(tmp_path):
    import shutil

    repo = Path(__file__).resolve().parent.parent
    for x in ("rollcall", "__spark_entry__.py"):
        (shutil.copytree if (repo / x).is_dir() else shutil.copy)(repo / x, tmp_path / x)
    shutil.rmtree(tmp_path / "rollcall/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and 'flagship_roster' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}).returncode == 0
