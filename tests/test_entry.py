"""The driver's contract on a copy of the tree without the llm subpackage."""

import os
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent
ASK = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as e
names = set(e.queries())
assert "ask_result" in names and set(e.oracle_sql()) <= names, names
assert bool([n for n in names if n.startswith("op") or n == "pipeline"]) == (sys.argv[1] == "with"), names
if sys.argv[2]:
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    assert len(e.entry(spark).columns) > 1
"""


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    gone = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, copy, ignore=gone)
    tables = pathlib.Path("/root/testdata/sf0.001").exists()
    subprocess.run([sys.executable, "-c", ASK, "without", "1" if tables else ""], cwd=copy, check=True, timeout=300, env=os.environ | {"PYTHONPATH": str(copy)})
    slip = copy / "kelpmill/llm"
    slip.mkdir()
    (slip / "__init__.py").touch()
    (slip / "queries.py").write_text("from kelpmill.llm import nothing_like_that")
    assert subprocess.run([sys.executable, "-c", ASK, "without", ""], cwd=copy, timeout=300, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True).returncode
    shutil.rmtree(slip)
    shutil.copy(ROOT / "corpus_pipeline.py", copy)  # it alone can't be imported
    subprocess.run([sys.executable, "-c", ASK, "without", ""], cwd=copy, check=True, timeout=300, env=os.environ | {"PYTHONPATH": str(copy)})
