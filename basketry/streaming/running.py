"""Running evaluation of a prediction table that keeps growing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.operators.errors import answer_pairs, counted_errors, zone_errors, zone_sums
from basketry.operators.metricspec import Metric
from basketry.operators.ranking import ranking_metrics


def prediction_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Prediction files as a stream; new files are picked up by later triggers.

    ``files_per_trigger`` makes updates come after so many files; without it one takes all
    that are there.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _updates(running: DataFrame, publish: Callable[[DataFrame, str], None], out_path: str, checkpoint: str) -> int:
    done: list[int] = []

    def each(result: DataFrame, batch_id: int) -> None:
        publish(result, f"{out_path}/update={batch_id}")
        done.append(batch_id)

    query = (
        running.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()
    return len(set(done))  # a retried update counts once


def run_metrics(
    predictions: DataFrame,
    metrics: list[Metric],
    keys: list[str],
    out_path: str,
    checkpoint: str,
) -> int:
    """Consume all available prediction files; returns the number of updates.

    The same row expressions as in batch feed one running aggregate.  Its state is one
    row per ``keys`` (task, template), so it needs no watermark.  After every trigger
    the whole result is written to a folder of its own, ``update=<batch id>``.
    """

    def publish(result: DataFrame, path: str) -> None:
        result.write.mode("overwrite").parquet(path)

    return _updates(ranking_metrics(predictions, metrics, keys), publish, out_path, checkpoint)


def run_errors(
    predictions: DataFrame, keys: list[str], out_path: str, checkpoint: str, scale: tuple[float, float, float] | None = None
) -> int:
    """Like :func:`run_metrics` for RMSE and MAE.

    The range that cuts the answers widens as truths arrive.  With the ``scale`` of the truths (low,
    high, step) the state is a few sums per zone of it (``errors.zone_sums``), however long the
    stream is.  Without one the state counts equal (answer, truth) pairs, which grows with the
    distinct answers.
    """
    pairs = answer_pairs(predictions, keys)
    if scale is None:
        kept = pairs.groupBy(*keys, "pred", "truth").agg(F.count(F.lit(1)).alias("n"))
    else:
        kept = zone_sums(pairs, keys, scale)

    def publish(result: DataFrame, path: str) -> None:
        found = counted_errors(result, keys) if scale is None else zone_errors(result, keys, scale)
        found.write.mode("overwrite").parquet(path)

    return _updates(kept, publish, out_path, checkpoint)


def latest(spark: SparkSession, out_path: str) -> DataFrame:
    """The result after the last update."""
    updates = spark.read.parquet(out_path)
    last = updates.selectExpr("max(update)").first()[0]  # one number
    return updates.filter(updates["update"] == last).drop("update")
