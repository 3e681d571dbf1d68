"""The entry point with and without the optional parts, each on a copy of the repository in a process of its own."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"
RUNS = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(e.entry(spark).count() > 0)
"""


def said(folder, code):
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.strip().splitlines()[-1]


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "lattica"):
        if os.path.exists(at := f"{ROOT}/{name}"):
            (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    return tmp_path


@pytest.mark.parametrize("gone", [["lattica/llm", "corpus_pipeline.py"], ["lattica/llm"], ["lattica/llm/queries.py"]])
def test_without_optional_parts(copy, gone):
    for name in gone:
        at = copy / name
        shutil.rmtree(at, ignore_errors=True) if at.is_dir() else at.unlink(missing_ok=True)
    if gone == ["lattica/llm"]:  # what deleting the sources may leave behind
        (copy / "lattica/llm/__pycache__").mkdir(parents=True)
    n, names = said(copy, SAYS).split(" ", 1)
    assert int(n) > 100 and names == "[]"
    if len(gone) == 2:
        assert said(copy, RUNS) == "True"
