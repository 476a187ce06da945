"""The engine works without the corpus operators: a copy without them imports, runs a query and passes tests of its own."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[1]


def test_the_rest_works_alone(tmp_path):
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "test_separation.py")
    shutil.copytree(TOP, copy, ignore=skip)
    assert not (copy / "tallyloom" / "llm").exists() and not (copy / "tests" / "llm").exists()
    env = os.environ | {"PYTHONPATH": str(copy)}
    names = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(s) <= set(q) and not any(n.startswith('op1') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", names], cwd=copy, env=env, check=True, timeout=120)
    some = ["tests/test_language.py", "tests/test_many.py::test_mentions_in_texts", "-k", "registry or resolution or names or mentions"]
    ran = subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", *some], cwd=copy, env=env, capture_output=True, text=True, timeout=900)
    assert ran.returncode == 0, ran.stdout[-2000:]
