import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def awkward(spark):
    import text_cases
    return spark.createDataFrame(text_cases.rows(), text_cases.SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    import text_cases
    return spark.createDataFrame([], text_cases.SCHEMA)
