import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, an extra column that differs by case alone."""
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a", 1, "x"), (1, "one two three four five six seven eight nine ten", "en", "a", 1, "x"),
        (2, "One two three four five six seven eight nine ten", "en", None, 1, None), (3, None, None, None, None, None), (4, "", "de", "b", 0, "x"),
        (None, "lonely text here", "fr", "c", 3, "x"), (5, "word " * 30000, "en", "b", 5, "x"), (6, "   \t\n ", "en", "b", 5, "x"), (7, "single", "de", "b", 5, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string")
