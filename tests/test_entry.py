"""The driver's entry with and without the corpus folders."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT


@pytest.mark.parametrize("gone", [("rolecall/llm", "tests/llm"), ("rolecall/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_folders(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True)
        (copy / name).unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    names = said.stdout.split()
    assert said.returncode == 0, said.stderr
    assert "stored_jobs" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
