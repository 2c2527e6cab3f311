"""Metric names, directions and the checks made before any job starts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKING, ERROR, LOSS = "ranking", "error", "loss"


@dataclass(frozen=True)
class Metric:
    """A metric: a per-row Column and the direction in which it improves.

    ``per_row(hit_ranks, truths)`` sees the ranks (1-based, ascending, already cut to
    ``k``) of the relevant predictions of one row.  Error metrics get the signed
    difference instead and define ``combine``.
    """

    name: str
    family: str
    k: int | None = None
    larger_is_better: bool = True
    per_row: Callable[..., Column] | None = field(default=None, compare=False)
    combine: Callable[[Column], Column] = field(default=F.avg, compare=False)

    def __str__(self) -> str:
        return self.name if self.k is None else f"{self.name}@{self.k}"


def safe_div(num: Column, den: Column) -> Column:
    """num / den, and 0 where den is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def _hit(ranks: Column, truths: Column) -> Column:
    return (F.size(ranks) > 0).cast("double")


def _reciprocal_rank(ranks: Column, truths: Column) -> Column:
    return F.when(F.size(ranks) > 0, F.lit(1.0) / F.get(ranks, F.lit(0))).otherwise(F.lit(0.0))


def average_precision(denominator: str = "retrieved"):
    """Mean precision at the relevant ranks.

    ``retrieved`` divides by the relevant predictions within k, ``truth`` by the
    number of truths.
    """

    def per_row(ranks: Column, truths: Column) -> Column:
        precisions = F.transform(ranks, lambda r, i: (i + 1).cast("double") / r)
        total = F.aggregate(precisions, F.lit(0.0), lambda acc, x: acc + x)
        count = F.size(ranks) if denominator == "retrieved" else F.size(truths)
        return safe_div(total, count.cast("double"))

    return per_row


def ndcg(discount: Callable[[Column], Column] = F.log2, ideal: str = "retrieved", k: int | None = None):
    """Discounted gain over the ideal order of the retrieved hits (or of the truths)."""

    def gain(ranks: Column) -> Column:
        return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + F.lit(1.0) / discount(r + 1))

    def per_row(ranks: Column, truths: Column) -> Column:
        best = F.size(ranks) if ideal == "retrieved" else F.size(truths)
        if ideal != "retrieved" and k is not None:
            best = F.least(best, F.lit(k))
        ideal_ranks = F.when(best > 0, F.sequence(F.lit(1), best)).otherwise(
            F.array().cast("array<int>")
        )
        return safe_div(gain(ranks), gain(ideal_ranks))

    return per_row


def _error(name: str, combine: Callable[[Column], Column]) -> Callable[..., Metric]:
    def build(k: int | None = None) -> Metric:
        if k is not None:
            raise KeyError(f"metric {name!r} takes no cutoff, got {k}")
        return Metric(name, ERROR, None, False, None, combine)

    return build


def _ranking(name: str, per_row) -> Callable[..., Metric]:
    return lambda k=None: Metric(name, RANKING, k, True, per_row)


def _loss(k: int | None = None) -> Metric:
    if k is not None:
        raise KeyError(f"the loss takes no cutoff, got {k}")
    return Metric("Loss", LOSS, None, False)


METRICS: dict[str, Callable[..., Metric]] = {
    "Hit": _ranking("Hit", _hit),
    "MAP": _ranking("MAP", average_precision()),
    "MRR": _ranking("MRR", _reciprocal_rank),
    "NDCG": _ranking("NDCG", ndcg()),
    "RMSE": _error("RMSE", lambda diff: F.sqrt(F.avg(diff * diff))),
    "MAE": _error("MAE", lambda diff: F.avg(F.abs(diff))),
    "Loss": _loss,
}


def metric_names() -> list[str]:
    return list(METRICS)


def find_metric(name: str) -> Callable[..., Metric]:
    """Builder by name, any letter case."""
    for known, build in METRICS.items():
        if known.lower() == name.lower():
            return build
    raise KeyError(f"no metric is registered as {name!r}")


def metric_exists(text: str) -> bool:
    """True for a known name (a cutoff is ignored); KeyError otherwise."""
    find_metric(text.split("@")[0])
    return True


def metric(text: str) -> Metric:
    """``ndcg@10`` -> Metric.  One ``@`` at most, digits after it, no cutoff on errors."""
    name, *cut = text.split("@")
    if len(cut) > 1 or (cut and not cut[0].isdigit()):
        raise KeyError(f"cannot read {text!r} as a metric")
    build = find_metric(name)
    return build(int(cut[0])) if cut else build()


def largest_cut(metrics: list[Metric]) -> int | None:
    """Largest cutoff of the ranking metrics, None when one of them has no cutoff."""
    cuts = [m.k for m in metrics if m.family == RANKING]
    return None if not cuts or None in cuts else max(cuts)


def check_compatible(task: str, family: str, metrics: list[Metric]) -> None:
    """Every metric must be of the task's family (loss fits all)."""
    for m in metrics:
        if m.family not in (family, LOSS):
            raise ValueError(f"Task {task} takes {family} metrics, {m} is not one")
