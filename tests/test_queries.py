"""Every query equals its SQL as DuckDB runs it."""

from __future__ import annotations

import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import connect, difference

from rolodyne import registry

NAMES = list(registry.queries())


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf, duck, name):
    rows = registry.queries()[name](spark, sf).toPandas()
    assert difference(rows, duck.execute(registry.oracle_sql()[name]).df()) is None
    assert len(rows)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_points(spark):
    spec = importlib.util.spec_from_file_location("entry_point", "__spark_entry__.py") or pytest.fail("no entry point")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(NAMES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_entry_points_without_the_training_data_part(tmp_path, also):
    root = Path(__file__).parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists() and name not in also:
            shutil.copy(root / name, tmp_path / name)
    shutil.copytree(root / "rolodyne", tmp_path / "rolodyne", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
