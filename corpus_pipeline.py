"""A training corpus from raw documents: language, exact copies, near copies, benchmark
passages, and a mix of the sources.

Each stage works on every row its predecessor kept.  All but the last return the columns
of ``documents``; the last adds the place of each row in the mix.  Missing values, empty
texts, repeated rows and further columns are treated as the stages' operators state; an
empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinlabel.llm.common import written
from twinlabel.llm.decontamination import without_contaminated
from twinlabel.llm.exact_dedup import without_exact_duplicates
from twinlabel.llm.language_id import in_some_language
from twinlabel.llm.mixing import mixed_rows
from twinlabel.llm.near_copies import without_near_copies
from twinlabel.session import configure


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts without letters and texts whose words are in no language for certain."""
    return in_some_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return without_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the row with the smallest doc_id stays."""
    return without_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a passage of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their place in a mix of the sources."""
    return mixed_rows(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", benchmark),
    ("source_mixing", mix),
]

# The language model and the fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
