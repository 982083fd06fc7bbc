"""The library without its training-data operators: a copy of the tree without their folders, with and without the pipeline's module."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_llm_folders(tmp_path, pipeline):
    without = ("llm", ".git", "__pycache__", ".pytest_cache", *(() if pipeline else ("corpus_pipeline.py",)))
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(*without))
    assert not (copy / "ampliq" / "llm").exists() and (copy / "corpus_pipeline.py").exists() == pipeline
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(q) == set(s) and len(q) >= 64 and 'pipeline' not in q, len(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)


def test_test_files_have_names_of_their_own():
    names = [f for d, _, files in os.walk(os.path.join(REPO, "tests")) for f in files if f.endswith(".py")]
    assert len(names) == len(set(names))
