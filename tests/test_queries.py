"""Every query of the library itself, held against its SQL."""

import pytest
from compare import assert_same

from locusmill.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module_imports(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_module_without_the_training_data_folder(tmp_path):
    """In a copy without both ``llm`` folders everything else imports, the pipeline's file with it."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    skipped = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=skipped)
    code = "import __spark_entry__ as e; assert 'locate_passages' in e.queries() and e.oracle_sql() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy")}, check=True)
