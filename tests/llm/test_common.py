from pyspark.sql import functions as F

from twinlabel.llm.common import ascii_lower, drawn, pick, small, unpack, with_row_key


def test_a_drawn_sample_is_that_of_the_smallest_hashes(spark):
    many = spark.range(50_000)
    want = {r.id for r in many.orderBy(F.xxhash64("id", F.lit(7))).limit(100).collect()}
    assert {r.id for r in drawn(many, 100, "id").collect()} == want
    assert drawn(many.limit(30), 100, "id").count() == 30
    assert drawn(many.limit(0), 100, "id").count() == 0


def test_lower_case_of_ascii_only(evaluate):
    rows = ["ABC xyz", "ÉTÉ Été İI Σς K Ⅷ Ⓐ ǅ", "", None, "ß STRASSE"]
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert evaluate(rows, "x string", ascii_lower(F.col("x"))) == [r and r.translate(az) if r else r for r in rows]


def test_rows_are_carried_past_clashing_names(docs, rows):
    carried = pick(docs, "doc_id", "text", carry=True)
    assert carried.columns == ["doc_id", "text", "_row"]
    back = unpack(carried, docs.columns)
    assert back.columns == docs.columns and back.count() == len(rows)
    assert with_row_key(carried).where("_key is null or _hash is null").count() == 0


def test_only_a_small_table_is_broadcast(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(spark.range(5), 10)) and not hinted(small(spark.range(20), 10))
