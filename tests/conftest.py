import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from twinlabel.session import configure  # noqa: E402


# Column expressions at module level need a session while tests are collected.
_SESSION = (
    SparkSession.builder.master("local[4]")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    .getOrCreate()
)
_SESSION.sparkContext.setLogLevel("ERROR")
configure(_SESSION)


@pytest.fixture(scope="session")
def spark():
    return _SESSION


@pytest.fixture
def evaluate(spark):
    """evaluate(rows, ddl, expr, ...) -> list of values (or tuples) in row order."""

    def run(rows, ddl, *exprs):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {ddl}")
        out = df.select("_i", *[e.alias(f"c{n}") for n, e in enumerate(exprs)]).collect()
        out = sorted(out, key=lambda r: r[0])
        return [r[1] if len(exprs) == 1 else tuple(r[1:]) for r in out]

    return run
