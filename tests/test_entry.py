import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 45


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and "routed_category" in rows[0].asDict()


def test_nothing_hands_rows_to_the_driver():
    for path in (ROOT / "twinlabel").rglob("*.py"):
        text = path.read_text(encoding="utf-8")
        assert not re.search(r"\.(collect|toPandas|localCheckpoint|crossJoin|rdd)\b\(?", text), path
