"""Whole runs: an evaluation from prompts to reports, and the rounds of a training.

The model itself is a pair of functions given by the caller: one answers a batch of texts, the other
trains on the batches of an epoch and gives their losses.  All data work in between is here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import summary
from basketry.operators.metricspec import ERROR, Metric
from basketry.operators.predict import predict_topn
from basketry.plans import evaluation, export
from basketry.plans import prompts as pr
from basketry.plans import templates as tpl
from basketry.sources import layout
from basketry.storage import pin

# load() -> answer(texts, n); see predict.predict_topn
Load = Callable[[], Callable[[list[str], int], list[list[str]]]]


@dataclass(frozen=True)
class Evaluation:
    """What an evaluation leaves.

    ``metrics`` has a row per (task, template, metric); ``reports`` names each task's CSV
    folder; ``rejects`` counts prompts without a ground truth (strict runs fail at them).
    """

    predictions: DataFrame
    metrics: DataFrame
    reports: dict[str, str]
    rejects: DataFrame


def predict(prompts: DataFrame, load: Load, n: int) -> DataFrame:
    """task, template_id, user_id, epoch, preds, truths: n answers for ranking tasks, one for rating tasks."""
    errors = [t for t, family in tpl.TASK_FAMILY.items() if family == ERROR]
    answered = predict_topn(prompts.select(*pr.COLUMNS), load, n)
    kept = F.when(F.col("task").isin(errors), F.slice("preds", 1, 1)).otherwise(F.col("preds"))
    return answered.select("task", "template_id", "user_id", "epoch", kept.alias("preds"), F.col("ground_truth").alias("truths"))


def score(predictions: DataFrame, tasks: dict[str, list[Metric]], losses: DataFrame | None = None) -> DataFrame:
    """Rows (task, template_id, template_no, metric, value) of all tasks and templates."""
    families = {t: tpl.TASK_FAMILY[t] for t in tasks}
    found = evaluation.evaluate(predictions, tasks, families, losses)
    numbers = tpl.template_table(predictions.sparkSession, list(tasks), "inference").select("task", "template_id", "template_no")
    return found.join(F.broadcast(numbers), ["task", "template_id"])  # as many rows as templates


def evaluate_run(
    prompts: DataFrame,
    load: Load,
    tasks: dict[str, list[Metric]],
    folder: str,
    exp_name: str,
    *,
    n: int = 10,
    strict: bool = True,
    losses: DataFrame | None = None,
) -> Evaluation:
    """Evaluation prompts (``whole_prompts``) to predictions, metrics, one CSV per task and the history.

    The reports go to ``folder``/reports/<task>, template rows first, then mean and best; the long
    rows go under ``exp_name`` to ``folder``/history, where a repeated run replaces itself.
    """
    tasks = {tpl.find_task(t): ms for t, ms in tasks.items()}
    asked = pr.join_pieces(prompts.filter(F.col("task").isin(*tasks)))
    able, rejects = pr.evaluable(asked)
    able = pr.check_evaluable(asked) if strict else able
    predictions = pin(predict(able, load, n), "predictions")  # the model answers once
    metrics = pin(score(predictions, tasks, losses), "scores")
    reports = {}
    for task, wanted in tasks.items():
        names = [str(m) for m in wanted]
        wide = summary.report_wide(metrics.filter(F.col("task") == task), names).drop("task")
        reports[task] = layout.write_report(wide, f"{folder}/reports", task)
    layout.append_history(metrics.drop("template_no"), f"{folder}/history", exp_name)
    return Evaluation(predictions, metrics, reports, rejects)


def read_reports(spark, reports: dict[str, str], tasks: dict[str, list[Metric]]) -> DataFrame:
    """The CSV reports as rows (task, Template ID, metric, value)."""
    out = None
    for task, path in reports.items():
        names = [str(m) for m in tasks[task]]
        schema = "`Template ID` string, " + ", ".join(f"`{n}` double" for n in names)
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])
        back = spark.read.schema(schema).option("header", True).csv(path)
        long = back.select(F.lit(task).alias("task"), "`Template ID`", F.inline(cells))
        out = long if out is None else out.unionByName(long)
    return out


@dataclass(frozen=True)
class Training:
    """``history`` has (epoch, metric, value) with train and validation values, ``running`` the
    loss so far after each batch; ``best`` is the epoch whose model to keep (None without validation)."""

    history: DataFrame
    running: DataFrame
    best: int | None


def train_run(
    interactions: DataFrame,
    users: DataFrame,
    tasks: list[str],
    fit: Callable[[int, DataFrame], DataFrame],
    folder: str,
    exp_name: str,
    *,
    seed: int,
    epochs: int,
    batch_size: int,
    max_len: int,
    load: Callable[[int], Load] | None = None,
    monitor: tuple[str, Metric] | None = None,
    n: int = 10,
    catalog=None,
    strategy: str = "all",
    strict: bool = True,
    size: int | None = None,
) -> Training:
    """The rounds of a training: fresh windows, batches, losses, validation, the best epoch.

    Each epoch samples its windows, builds the prompts of all ``tasks`` and exports padded batches;
    ``fit(epoch, batches)`` trains on them and returns (batch, loss).  ``monitor`` is the validation
    (task, metric): ``load(epoch)`` gives the model of that epoch.  Metrics go to ``folder``/history
    by run and epoch, so a round that is run again replaces its rows.
    """
    options = {} if size is None else {"size": size}
    every = pr.whole_prompts(interactions, users, tasks, seed=seed, epochs=epochs, strategy=strategy, catalog=catalog, strict=strict, **options)
    batches = pin(export.export_batches(every, seed=seed, batch_size=batch_size, max_len=max_len, **options), "batches")
    check = None
    if monitor is not None:
        task, wanted = tpl.find_task(monitor[0]), monitor[1]
        asked = pr.whole_prompts(interactions, users, [task], seed=seed, split="validation", catalog=catalog, strict=strict, **options)
        check = pin(pr.check_evaluable(pr.join_pieces(asked)), "validation")
    history, running = None, None
    for epoch in range(1, epochs + 1):
        losses = pin(fit(epoch, batches.filter(F.col("epoch") == epoch)).withColumn("epoch", F.lit(epoch).cast("bigint")), "losses")
        found = summary.batch_mean(losses, ["epoch"]).select("epoch", F.lit("train/loss").alias("metric"), F.col("Loss").alias("value"))
        if check is not None:
            scores = score(predict(check, load(epoch), n), {task: [wanted]})
            value = scores.groupBy("metric").agg(F.avg("value").alias("value"))  # mean over the templates
            found = found.unionByName(value.select(F.lit(epoch).cast("bigint").alias("epoch"), F.concat(F.lit("val/"), "metric").alias("metric"), "value"))
        found = pin(found, "epoch")
        layout.append_history(found, f"{folder}/history", exp_name)
        so_far = summary.running_mean(losses, ["epoch"], "batch", "loss", "running_loss")
        history = found if history is None else history.unionByName(found)
        running = so_far if running is None else running.unionByName(so_far)
    best = None
    if monitor is not None:
        mine = history.filter(F.col("metric") == f"val/{wanted}").withColumn("task", F.lit(task))
        row = summary.best_epoch(mine, wanted.larger_is_better, ["task"]).first()  # one row
        best = row and row.best_epoch
    return Training(history, running.drop("loss"), best)
