"""Evaluation plans: predictions joined with truths, scored per task and template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import splits
from basketry.operators.metricspec import ERROR, LOSS, RANKING, Metric, check_compatible, metric
from basketry.operators.errors import error_metrics
from basketry.operators.predict import next_item_topn
from basketry.operators.ranking import ranking_metrics
from basketry.storage import pin

GROUP = ["task", "template_id"]


def next_item_predictions(interactions: DataFrame, n: int = 10, split: str = "test") -> DataFrame:
    """preds, truths and last input item of the next-item predictor per user of a split.

    ``interactions`` must carry ``next_item`` (see ``number_rows(lead=...)``).  The
    predictor learns only from pairs whose both ends lie in the split's input.  The
    split is read three times (pairs, popularity, last items), so it is pinned.
    """
    wanted = interactions.filter(splits.in_split(split))
    rows = pin(wanted.select("user_id", "pos", "n", "item_id", "next_item"), "followed")
    size = splits.split_size(split)
    learn = rows.withColumn(
        "next_item", F.when(F.col("pos") < size - 2, F.col("next_item"))
    ).filter(F.col("pos") < size - 1)
    last = rows.filter(F.col("pos") == size - 2).select(
        "user_id", "item_id", F.array("next_item").alias("truths")
    )
    out = next_item_topn(learn, last, n)
    return out.select("user_id", F.col("item_id").alias("last_item"), "preds", "truths")


def flagship(interactions: DataFrame, cutoffs=(5, 10)) -> DataFrame:
    """Hit, MRR, MAP and NDCG of the next-item predictor on the test split."""
    wanted = [metric(f"{name}@{k}") for k in cutoffs for name in ("Hit", "MAP", "MRR", "NDCG")]
    predictions = next_item_predictions(interactions, max(cutoffs)).withColumn(
        "task", F.lit("next_item")
    )
    return ranking_metrics(predictions, wanted, ["task"])


def metrics_long(wide: DataFrame, keys: list[str], metrics: list[Metric]) -> DataFrame:
    """Wide metric columns to (keys, metric, value) rows."""
    cells = F.array(
        *[F.struct(F.lit(str(m)).alias("metric"), F.col(f"`{m}`").alias("value")) for m in metrics]
    )
    return wide.select(*keys, F.explode(cells).alias("cell")).select(*keys, "cell.*")


def evaluate(
    predictions: DataFrame,
    tasks: dict[str, list[Metric]],
    families: dict[str, str],
    losses: DataFrame | None = None,
) -> DataFrame:
    """Score all tasks and templates at once: rows (task, template_id, metric, value).

    ``tasks`` maps a task to its metrics and ``families`` to ``ranking`` or ``error``;
    a mismatch fails before any job runs.  ``losses`` has one row per batch and is
    needed when a task asks for Loss.
    """
    for task, metrics in tasks.items():
        check_compatible(task, families[task], metrics)
    parts = []
    for family, run in ((RANKING, ranking_metrics), (ERROR, error_metrics)):
        # tasks with the same metric list share one pass
        by_list: dict[tuple, list[str]] = {}
        for task, metrics in tasks.items():
            mine = tuple(m for m in metrics if m.family == family)
            if mine:
                by_list.setdefault(mine, []).append(task)
        for mine, names in by_list.items():
            rows = predictions.filter(F.col("task").isin(names))
            parts.append(metrics_long(run(rows, list(mine), GROUP), GROUP, list(mine)))
    with_loss = [t for t, ms in tasks.items() if any(m.family == LOSS for m in ms)]
    if with_loss:
        if losses is None:
            raise ValueError("Loss needs the batch losses")
        mine = losses.filter(F.col("task").isin(with_loss))
        parts.append(
            mine.groupBy(*GROUP).agg(F.avg("loss").alias("value")).select(
                *GROUP, F.lit("Loss").alias("metric"), "value"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
