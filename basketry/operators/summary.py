"""Summaries over long metric rows (task, template_id, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.operators.metricspec import metric
from basketry.operators.numbering import running_sums

MEAN, BEST = "mean", "best"


def larger_is_better(names: list[str]) -> Column:
    """BOOLEAN per ``metric`` name, from the metric's direction."""
    up = [n for n in names if metric(n).larger_is_better]
    return F.col("metric").isin(up)


def cost(value: Column, larger: Column) -> Column:
    """Value to minimise."""
    return F.when(larger, -value).otherwise(value)


def template_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean and best value over the templates, per task and metric."""
    best = F.min(cost(F.col("value"), larger_is_better(names)))
    return (
        metrics.groupBy("task", "metric")
        .agg(F.avg("value").alias(MEAN), best.alias("cost"))
        .withColumn(BEST, cost(F.col("cost"), larger_is_better(names)))
        .drop("cost")
    )


def best_template(metrics: DataFrame, names: list[str], order: str = "template_no") -> DataFrame:
    """Best template per task and metric; the first template wins a tie.

    The minimum of (cost, order) merges before the shuffle, so no window is needed.
    """
    spot = F.struct(
        cost(F.col("value"), larger_is_better(names)).alias("cost"), F.col(order), F.col("template_id"), F.col("value")
    )
    known = metrics.filter(F.col("value").isNotNull())
    best = known.groupBy("task", "metric").agg(F.min(spot).alias("spot"))
    return best.select("task", "metric", "spot.template_id", "spot.value")


def best_epoch(epochs: DataFrame, larger: bool, keys: list[str]) -> DataFrame:
    """Epoch with the best ``value``; the earliest one wins a tie."""
    spot = F.struct(cost(F.col("value"), F.lit(larger)).alias("cost"), F.col("epoch"), F.col("value"))
    known = epochs.filter(F.col("value").isNotNull())
    best = known.groupBy(*keys).agg(F.min(spot).alias("spot"))
    return best.select(*keys, F.col("spot.epoch").alias("best_epoch"), F.col("spot.value").alias("value"))


def report_long(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Template rows followed by the mean and best rows: (task, row_no, label, metric, value)."""
    rows = metrics.select(
        "task", F.col("template_no").alias("row_no"), F.col("template_id").alias("label"), "metric", "value"
    )
    summary = template_summary(metrics, names)
    last = 2**31  # after every template
    for i, label in enumerate((MEAN, BEST)):
        rows = rows.unionByName(
            summary.select(
                "task",
                F.lit(last + i).cast("bigint").alias("row_no"),
                F.lit(label).alias("label"),
                "metric",
                F.col(label).alias("value"),
            )
        )
    return rows


def report_wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """The report with one column per metric, ``Template ID`` first."""
    wide = report_long(metrics, names).groupBy("task", "row_no", "label").pivot("metric", names)
    return wide.agg(F.first("value")).withColumnRenamed("label", "Template ID")


def report_rows(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Formatted rows ``label & value & ...`` with the best template of each metric marked."""
    best = best_template(metrics, names).select(
        "task", "metric", F.col("template_id").alias("label"), F.lit(True).alias("is_best")
    )
    cells = report_long(metrics, names).join(best, ["task", "metric", "label"], "left")
    shown = F.format_string("%.4f", "value")
    marked = F.when(F.col("is_best"), F.concat(F.lit(r"\textbf{"), shown, F.lit("}"))).otherwise(shown)
    wide = (
        cells.withColumn("cell", marked)
        .groupBy("task", "row_no", "label")
        .pivot("metric", names)
        .agg(F.first("cell"))
    )
    line = F.concat(
        F.concat_ws(" & ", "label", *[F.coalesce(F.col(f"`{n}`"), F.lit("-")) for n in names]), F.lit(r" \\")
    )
    return wide.select("task", "row_no", line.alias("line"))


def batch_mean(losses: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the batch losses: a small last batch weighs like a full one."""
    return losses.groupBy(*keys).agg(F.avg("loss").alias("Loss"))


def running_mean(rows: DataFrame, keys: list[str], index: str, value: str, out: str) -> DataFrame:
    """Mean of all values up to each index, per key."""
    counted = rows.withColumn("one", F.lit(1))
    sums = running_sums(counted, keys, index, {"sum_so_far": value, "n_so_far": "one"})
    return sums.withColumn(out, F.col("sum_so_far") / F.col("n_so_far")).drop(
        "one", "sum_so_far", "n_so_far"
    )


def progress_point(batch: Column, batches: Column) -> Column:
    """Whole percent of batches done after a 0-based batch, 1..100."""
    return F.greatest(F.floor((200 * (batch + 1) + batches) / (2 * batches)), F.lit(1)).cast("bigint")


def running_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics over all rows seen so far, at each percent of progress.

    ``rows`` carries one value column per metric and ``percent``.  Only partial sums
    (at most 100 per key) reach the cumulative window.
    """
    parts = rows.groupBy(*keys, "percent").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"`{m}`").alias(m) for m in metrics]
    )
    upto = W.partitionBy(*keys).orderBy("percent").rowsBetween(W.unboundedPreceding, W.currentRow)
    count = F.sum("n_rows").over(upto)
    return parts.select(
        *keys,
        "percent",
        count.alias("n_rows"),
        *[(F.sum(f"`{m}`").over(upto) / count).alias(m) for m in metrics],
    )
