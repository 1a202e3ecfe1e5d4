"""Payloads stored once, so that every stage finds them without moving them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove


class PayloadStore:
    """Rows with their payloads in a table of buckets, by the number of their place.

    Places are unique, so buckets are even whatever repeats in the rows.  A join by place takes
    the table as it lies, a task per bucket: the other side goes to the buckets, and no payload
    is shuffled or sorted.  Columns other than the payload are read without it.
    """

    def __init__(self, rows: DataFrame, path: str, buckets: int):
        self.spark: SparkSession = rows.sparkSession
        self.path, self.name = path, f"payloads_{uuid.uuid4().hex}"
        (
            rows.withColumn("place", F.monotonically_increasing_id())
            .repartition(buckets, "place")
            .write.bucketBy(buckets, "place")
            .option("path", path)
            .saveAsTable(self.name)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def beside(self, calls: DataFrame, *payload: str) -> DataFrame:
        """``calls``, one row per place, with the payload columns of their place."""
        wanted = self.rows().select("place", *payload)
        return wanted.join(calls.hint("shuffle_hash"), "place")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)
