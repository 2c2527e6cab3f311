"""Published layout: splits as Parquet partitions, reports as CSV, metric history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.splits import all_splits, split_rows


def named_splits(interactions: DataFrame, merge_train_val: bool = False) -> dict[str, DataFrame]:
    """``train``, ``validation``, ``test`` rows; merged training leaves out validation."""
    if merge_train_val:
        return {
            "train": split_rows(interactions, "train_validation"),
            "test": split_rows(interactions, "test"),
        }
    return {s: split_rows(interactions, s) for s in ("train", "validation", "test")}


def save_splits(interactions: DataFrame, path: str) -> None:
    """Write all splits, one Parquet partition per split."""
    all_splits(interactions).write.partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Read back one split; only its folder is listed and scanned."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Repeatable development subset: the first ``n`` rows in ``order``."""
    return df.orderBy(*order).limit(n)


def write_report(report: DataFrame, folder: str, task: str, order: str = "row_no") -> str:
    """One CSV file per task, template rows first, ``order`` dropped after sorting.

    A report has one row per template plus two, so a single file is fine.
    """
    path = f"{folder}/{task}"
    rows = report.coalesce(1).sortWithinPartitions(order).drop(order)
    rows.write.option("header", True).mode("overwrite").csv(path)
    return path


def append_history(metrics: DataFrame, path: str, exp_name: str) -> None:
    """Put long metric rows of one run (template, epoch, ...) under its name.

    Rows go to the partition of their run, or of their (run, epoch) if there is an ``epoch``,
    and replace what it holds; other partitions stay.  So a run that is written again, by a
    retry or a restart, is there once.
    """
    own = ["exp_name", "epoch"] if "epoch" in metrics.columns else ["exp_name"]
    named = metrics.withColumn("exp_name", F.lit(exp_name))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*own).parquet(path)
