"""The library works without its training-data package."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as entry
assert "decide" in entry.queries() and "decide" in entry.oracle_sql()
assert not [n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit() or n == "pipeline"]
import bench
"""


@pytest.mark.parametrize("leave", [False, True])
def test_without_the_training_data_package(tmp_path, leave):
    """leave: corpus_pipeline.py and compiled files stay behind."""
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if leave else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    if leave:
        (tmp_path / "copy/ledgerloom/llm/__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
