"""The driver's entry points, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
_SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def _ask(folder: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-c", _SAYS], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_queries_without_the_training_data_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    assert not (copy / "docfathom" / "llm").exists()
    n, own, pipeline = _ask(copy)
    assert int(n) > 100 and (own, pipeline) == ("0", "False")


def test_queries_with_a_subpackage_that_does_not_import(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (copy / "docfathom" / "llm").mkdir()
    (copy / "docfathom" / "llm" / "__init__.py").write_text("import a_module_that_is_not_there\n")
    n, own, pipeline = _ask(copy)
    assert int(n) > 100 and (own, pipeline) == ("0", "False")
