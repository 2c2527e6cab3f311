"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import storage

# The white space that separates words: blank and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a document row: rows that agree in id and text share every decision."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text, F.lit(7)).alias("h"))


class Scratch:
    """Tables written to the shared folder, with a way to delete the ones no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label

    def pin(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = storage.fresh_path(self.spark, self.label)
        return storage.pin_to(df, path), path

    def drop(self, path: str | None) -> None:
        if path:
            storage.unpin(self.spark, path)

    def table(self, df: DataFrame, by: str, buckets: int) -> tuple[DataFrame, str, str]:
        """Written as a table (and its name and path) in buckets of ``by``: joins on it shuffle the other side only."""
        path, name = storage.fresh_path(self.spark, self.label), f"basketry_{uuid.uuid4().hex}"
        storage.keep_track(path)
        df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(name)
        return self.spark.table(name), name, path

    def drop_table(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.drop(path)
