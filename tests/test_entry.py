"""The entry and its queries work without the text operators, which are a part of their own."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
names = set(entry.queries())
assert names >= set(entry.oracle_sql()) and "u1_resolve_url" in names, names
assert ("pipeline" in names) == (sys.argv[3] == "whole") == any(n.startswith("op1_") for n in names)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
pages = spark.createDataFrame([(1, "http://h.example/a", "<a href='b'>x</a>")], "page_id long, url string, html string")
pages.write.parquet(sys.argv[2] + "/data/pages.parquet")
print("rows", entry.queries()["u2_uri_segments"](spark, sys.argv[2] + "/data").count())
"""


@pytest.mark.parametrize("kind", ["whole", "alone"])
def test_entry_with_and_without_the_text_operators(tmp_path, kind):
    source = Path(__file__).resolve().parent.parent
    if kind == "whole" and not (source / "pagelake" / "llm").exists():
        pytest.skip("the text operators are not there")
    left_out = ["llm"] if kind == "alone" else []
    shutil.copytree(
        source, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out)
    )
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    if kind == "whole" and "PYTHONPATH" in os.environ:
        environment["PYTHONPATH"] = os.environ["PYTHONPATH"]
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(tmp_path / "repo"), str(tmp_path / "work"), kind],
        cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300,
    )
    assert "rows" in done.stdout, done.stderr[-3000:]
