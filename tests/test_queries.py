"""Every registered query against its SQL, and the entry module."""

import collections
import decimal
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from evidentia.plans import registry

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 4) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", list(registry.ALL))
def test_query(spark, duck, name):
    query, sql = registry.ALL[name]
    out = query(spark, SF)
    columns = sorted(out.columns)
    got = collections.Counter(tuple(map(plain, r)) for r in out.select(*columns).collect())
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert columns == [want.columns[i] for i in order]
    assert got == collections.Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(tmp_path):
    for name in ("evidentia", "__spark_entry__.py"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "evidentia" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    for module in (tmp_path / "evidentia").rglob("*.py"):
        assert "evidentia.llm" not in module.read_text()
