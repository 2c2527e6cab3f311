"""Ranking metrics from prediction and truth arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.operators.metricspec import RANKING, Metric, largest_cut

PAD = "<PAD>"  # reserved, may not occur in predictions or truths


def guard_reserved(values: Column) -> Column:
    """``values`` unchanged; the job fails when the reserved token occurs in it."""
    found = F.coalesce(F.array_contains(values, F.lit(PAD)), F.lit(False))
    return F.when(found, F.raise_error(F.lit(f"{PAD} is reserved"))).otherwise(values)


def relevance(preds: Column, truths: Column, k: int | None = None) -> Column:
    """ARRAY<BOOLEAN>: is the prediction one of the row's truths?  Cut to ``k`` first."""
    cut = preds if k is None else F.slice(preds, 1, k)
    return F.transform(cut, lambda p: F.coalesce(F.array_contains(truths, p), F.lit(False)))


def hit_ranks(rel: Column) -> Column:
    """1-based ranks of the relevant predictions, ascending."""
    ranks = F.transform(rel, lambda r, i: F.when(r, i + 1))
    return F.filter(ranks, lambda r: r.isNotNull())


def drop_repeats(rel: Column, preds: Column) -> Column:
    """Option: only the first copy of a repeated prediction stays relevant."""
    return F.transform(rel, lambda r, i: r & (F.array_position(preds, preds[i]) == i + 1))


def with_hit_ranks(df: DataFrame, metrics: list[Metric], dedupe: bool = False) -> DataFrame:
    """Adds ``hit_ranks`` at the largest cutoff any of the metrics needs."""
    preds, truths = guard_reserved(F.col("preds")), guard_reserved(F.col("truths"))
    rel = relevance(preds, truths, largest_cut(metrics))
    if dedupe:
        rel = drop_repeats(rel, F.col("preds"))
    return df.withColumn("hit_ranks", hit_ranks(rel))


def row_values(metrics: list[Metric]) -> list[Column]:
    """One DOUBLE column per metric, from the shared ``hit_ranks``."""
    cut = largest_cut(metrics)

    def ranks(m: Metric) -> Column:
        all_ranks = F.col("hit_ranks")
        return all_ranks if m.k == cut else F.filter(all_ranks, lambda r: r <= m.k)

    return [m.per_row(ranks(m), F.col("truths")).alias(str(m)) for m in metrics]


def ranking_metrics(
    predictions: DataFrame, metrics: list[Metric], keys: list[str], dedupe: bool = False
) -> DataFrame:
    """One row per ``keys`` with a column per metric and the row count ``n_rows``.

    Relevance is computed once per row; the only shuffle carries partial sums.
    """
    if any(m.family != RANKING for m in metrics):
        raise ValueError("ranking metrics only")
    rows = with_hit_ranks(predictions, metrics, dedupe).select(*keys, *row_values(metrics))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[m.combine(F.col(f"`{m}`")).alias(str(m)) for m in metrics],
    )


def ranked_rows(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per prediction with ``rank`` and ``relevant``."""
    rel = relevance(F.col("preds"), F.col("truths"))
    zipped = F.arrays_zip(F.col("preds").alias("pred"), rel.alias("relevant"))
    return predictions.select(*keys, F.posexplode(zipped).alias("rank", "cell")).select(
        *keys,
        (F.col("rank") + 1).cast("bigint").alias("rank"),
        F.col("cell.pred").alias("pred"),
        F.col("cell.relevant").alias("relevant"),
    )


def running_precision(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative hits and precision by rank (``keys`` identify one prediction list)."""
    upto = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = F.sum(F.col("relevant").cast("bigint")).over(upto)
    return ranked.withColumn("hits", hits).withColumn(
        "precision", F.col("hits").cast("double") / F.col("rank")
    )


def first_hit_rank(rel: Column) -> Column:
    """1-based rank of the first relevant prediction, NULL without one."""
    return F.nullif(F.array_position(rel, F.lit(True)), F.lit(0))


def ideal_order(rel: Column) -> Column:
    """The relevance vector sorted with the relevant ones first."""
    return F.sort_array(rel, asc=False)


def overlaps(preds: Column, truths: Column) -> Column:
    """Set form of Hit: do predictions and truths share an element?"""
    return F.coalesce(F.arrays_overlap(preds, truths), F.lit(False))
