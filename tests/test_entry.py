"""The driver's entry points, and that the rest stands without the corpus part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_every_list_query_has_its_sql():
    import __spark_entry__ as E
    from tidepool.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLE) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_flagship_plan(spark):
    import __spark_entry__ as E

    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("the driver's tables aren't here")
    frame = E.entry(spark)
    plan = frame._jdf.queryExecution().toString()
    assert all(x in plan for x in ("TakeOrderedAndProject", "WindowGroupLimit", "LeftSemi", "BroadcastHashJoin"))
    assert frame.count() > 0


def test_imports_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [x for x in q if x.startswith('op') or x == 'pipeline'], q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=100)
