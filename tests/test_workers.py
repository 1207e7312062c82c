"""The driver may hold a session whose workers do not know this repository."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, sys.argv[1])
import pandas as pd
from pyspark.sql import types as T
from pagelake.operators.nodes import with_nodes
from pagelake.operators.scrape import scrape_with
pages = spark.sql(
    "SELECT 'u' AS uri, '<p>a<p>b' AS body, 't' AS crawl_tag, now() AS crawled_at, now() AS crawl_timestamp"
)
assert len(with_nodes(pages.select("uri", "body"), "body").first()["nodes"]) == 2
schema = T.StructType([T.StructField("size", T.LongType())])
assert scrape_with(pages, lambda rows: rows.assign(size=rows["body"].str.len()), schema).first()["size"] == 8
print("parsed")
"""


def test_python_code_reaches_the_workers(tmp_path):
    repository = str(Path(__file__).resolve().parent.parent)
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, repository], cwd=tmp_path, env=environment,
        capture_output=True, text=True, timeout=300,
    )
    assert "parsed" in done.stdout, done.stderr[-2000:]
