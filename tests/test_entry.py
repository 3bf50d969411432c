import shutil
import subprocess
import sys

from conftest import ROOT, SMALL

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["vec_id", "x", "y", "label"] and out.count() == 500


def test_rest_works_without_the_subpackage(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = f"import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), list(q); assert set(e.oracle_sql()) <= set(q); print({SMALL!r})"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(root)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
