"""Error metrics over numeric answers given as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.operators.metricspec import ERROR, Metric
from basketry.storage import broadcast_if_small, pin

# The text forms taken as numbers.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"^\s*[+-]?(inf|infinity)\s*$"


def to_number(value: Column) -> Column:
    """Text to DOUBLE; NULL for anything that is not a plain number (NaN included)."""
    lowered = F.lower(F.trim(value))
    infinite = F.when(lowered.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(value.rlike(NUMBER), F.trim(value).try_cast("double")).when(
        lowered.rlike(INFINITE), infinite
    )


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def answer_pairs(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (prediction, truth); fails on unequal lengths or a non-numeric truth."""
    preds, truths = F.col("preds"), F.col("truths")
    paired = F.when(F.size(preds) == F.size(truths), F.arrays_zip("preds", "truths")).otherwise(
        F.raise_error(F.lit("predictions and truths must be 1:1"))
    )
    rows = predictions.select(*keys, F.explode(paired).alias("cell"))
    truth = to_number(F.col("cell.truths"))
    return rows.select(
        *keys,
        to_number(F.col("cell.preds")).alias("pred"),
        F.when(truth.isNull(), F.raise_error(F.lit("the truth must be a number")))
        .otherwise(truth)
        .alias("truth"),
    )


def answer_bounds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Range of the truths whose prediction parsed, with answered and ignored counts."""
    valid = F.col("pred").isNotNull()
    return pairs.groupBy(*keys).agg(
        F.min(F.when(valid, F.col("truth"))).alias("low"),
        F.max(F.when(valid, F.col("truth"))).alias("high"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~valid).alias("n_ignored"),
    )


def rating_diffs(pairs: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Signed difference of every parsed prediction, clipped to the truth range."""
    valid = pairs.filter(F.col("pred").isNotNull())
    joined = valid.join(bounds, keys)
    return joined.withColumn("clipped", clip(F.col("pred"), F.col("low"), F.col("high"))).withColumn(
        "diff", F.col("clipped") - F.col("truth")
    )


def pinned_bounds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds computed once; one row per key group, broadcast when that is few."""
    return broadcast_if_small(pin(answer_bounds(pairs, keys), "bounds"))


def error_metrics(predictions: DataFrame, metrics: list[Metric], keys: list[str]) -> DataFrame:
    """One row per ``keys`` with a column per metric, ``n_total`` and ``n_ignored``.

    A group without any parsed prediction keeps its row with NULL metrics.
    """
    if any(m.family != ERROR for m in metrics):
        raise ValueError("error metrics only")
    pairs = answer_pairs(predictions, keys)
    bounds = pinned_bounds(pairs, keys)
    values = (
        rating_diffs(pairs, bounds, keys)
        .groupBy(*keys)
        .agg(*[m.combine(F.col("diff")).alias(str(m)) for m in metrics])
    )
    return bounds.select(*keys, "n_total", "n_ignored").join(values, keys, "left")


# Sums that give the errors of answers that lie beyond the range of the truths: each counts as the
# range's end E, so its squared error is E*E - 2*E*truth + truth*truth.
_WAITING = {"n": F.lit, "t": lambda t: t, "tt": lambda t: t * t}


def _end_squares(end: Column, side: str) -> Column:
    return end * end * F.col(f"{side}_n") - end * F.col(f"{side}_t") * 2 + F.col(f"{side}_tt")


def running_error_metrics(answers: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE and MAE over all answers seen so far, at each percent of progress.

    ``answers`` has preds, truths and ``percent``.  Answers are cut to the range of the truths
    seen by then, which only widens.  An answer waits above or below the range until the
    percent that takes it in, and has its own error from then on: two events an answer, added
    up by (key, percent), whose running sums give every point.  A key has at most 100 of them.
    """
    point = [*keys, "percent"]
    pairs = answer_pairs(answers, point)
    upto = W.partitionBy(*keys).orderBy("percent").rowsBetween(W.unboundedPreceding, W.currentRow)
    over = {"low": F.min, "high": F.max, "n_total": F.sum, "n_ignored": F.sum}
    points = pin(answer_bounds(pairs, point).select(*point, *[f(c).over(upto).alias(c) for c, f in over.items()]), "points")
    # at most 100 steps a key; truths are counted from the first low end, which keeps the sums small
    steps = points.filter("low IS NOT NULL").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("percent", "low", "high"))).alias("steps"), F.min_by("low", "percent").alias("origin"))
    valid = pairs.filter("pred IS NOT NULL").join(broadcast_if_small(pin(steps, "steps")), keys)
    holds = F.filter("steps", lambda s: (s["percent"] >= F.col("percent")) & (s["low"] <= F.col("pred")) & (s["high"] >= F.col("pred")))
    own = F.filter("steps", lambda s: s["percent"] == F.col("percent"))
    placed = valid.select(
        *keys, "percent", (F.col("pred") - F.col("truth")).alias("diff"), (F.col("truth") - F.col("origin")).alias("t"),
        F.get(holds, F.lit(0))["percent"].alias("enters"), (F.col("pred") > F.get(own, F.lit(0))["high"]).alias("above"))
    arrives = F.struct(F.col("percent").alias("at"), F.lit(1).alias("sign"))
    leaves = F.struct(F.col("enters").alias("at"), F.lit(-1).alias("sign"))
    waits = F.coalesce(F.col("enters") > F.col("percent"), F.lit(True))
    events = placed.withColumn("waits", waits).withColumn(
        "event", F.explode(F.array_compact(F.array(arrives, F.when(F.col("waits") & F.col("enters").isNotNull(), leaves)))))
    events = events.select("*", "event.at", "event.sign")
    inside = (F.col("sign") == -1) | ~F.col("waits")
    cells = [F.sum(F.when(F.col("sign") == 1, 1)).alias("n"), F.sum(F.when(inside, F.col("diff") * F.col("diff"))).alias("squares"),
             F.sum(F.when(inside, F.abs("diff"))).alias("sizes")]
    for side, here in (("up", F.col("above")), ("down", ~F.col("above"))):
        cells += [F.sum(F.when(F.col("waits") & here, F.col("sign") * (F.lit(1) if c == "n" else f(F.col("t"))))).alias(f"{side}_{c}")
                  for c, f in _WAITING.items()]
    sums = events.groupBy(*keys, F.col("at").alias("percent")).agg(*cells)
    names = [c for c in sums.columns if c not in point]
    so_far = points.join(sums, point, "left").join(broadcast_if_small(steps.select(*keys, "origin")), keys, "left").select(
        *point, "n_total", "n_ignored", (F.col("low") - F.col("origin")).alias("low"), (F.col("high") - F.col("origin")).alias("high"),
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in names])
    return _from_sums(so_far, [*point, "n_total", "n_ignored"])


def _from_sums(rows: DataFrame, keep: list[str]) -> DataFrame:
    """RMSE and MAE from the sums inside the range and those waiting beyond its ends."""
    low, high, n = F.col("low"), F.col("high"), F.nullif(F.col("n"), F.lit(0))
    ends = F.when(F.col("up_n") > 0, _end_squares(high, "up")).otherwise(0) + F.when(F.col("down_n") > 0, _end_squares(low, "down")).otherwise(0)
    sizes = (F.when(F.col("up_n") > 0, high * F.col("up_n") - F.col("up_t")).otherwise(0)
             + F.when(F.col("down_n") > 0, F.col("down_t") - low * F.col("down_n")).otherwise(0))
    # rounding may leave a sum of squares a trifle below zero
    return rows.select(*keep, F.sqrt(F.greatest(F.col("squares") + ends, F.lit(0.0)) / n).alias("RMSE"), ((F.col("sizes") + sizes) / n).alias("MAE"))


def zone(pred: Column, scale: tuple[float, float, float]) -> Column:
    """Where an answer lies on a rating scale (low, high, step): 2k on the k-th mark, 2k+1 above it,
    -1 below the scale and one more than the last mark's number above it."""
    low, high, step = scale
    place = (pred - low) / step
    mark = F.floor(place)
    return (F.when(pred < low, -1).when(pred > high, 2 * round((high - low) / step) + 1)
            .when(pred.isNotNull(), mark * 2 + F.when(place == mark, 0).otherwise(1)).cast("int"))


def zone_sums(pairs: DataFrame, keys: list[str], scale: tuple[float, float, float]) -> DataFrame:
    """What is kept of the answers when all truths are marks of a scale: a row per (keys, zone).

    Whatever range the truths span later, the answers of a zone are inside it, above it or
    below it together, so these sums are enough, and there are as many rows as zones.
    """
    low, high, step = scale
    pred, truth = F.col("pred"), F.col("truth")
    off = (truth < low) | (truth > high) | (F.abs((truth - low) / step - F.round((truth - low) / step)) > 1e-9)
    said = F.raise_error(F.concat(F.lit("not a mark of the scale: "), truth.cast("string"))).cast("double")
    checked = pairs.withColumn("truth", F.when(off, said).otherwise(truth)).withColumn("zone", zone(pred, scale))
    diff, t = F.col("pred") - F.col("truth"), F.col("truth") - F.lit(float(low))
    return checked.groupBy(*keys, "zone").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(diff * diff).alias("squares"), F.sum(F.abs(diff)).alias("sizes"), F.sum(t).alias("t"),
        F.sum(t * t).alias("tt"), F.min(t).alias("low"), F.max(t).alias("high"))


def zone_errors(zones: DataFrame, keys: list[str], scale: tuple[float, float, float]) -> DataFrame:
    """RMSE, MAE, n_total and n_ignored from :func:`zone_sums`."""
    step = float(scale[2])
    valid = F.col("zone").isNotNull()
    bounds = zones.groupBy(*keys).agg(
        F.min(F.when(valid, F.col("low"))).alias("low"), F.max(F.when(valid, F.col("high"))).alias("high"), F.sum("rows").alias("n_total"),
        F.coalesce(F.sum(F.when(~valid, F.col("rows"))), F.lit(0)).alias("n_ignored"))
    rows = zones.drop("low", "high").join(bounds, keys)
    first, last = (F.round(F.col(c) / step) * 2 for c in ("low", "high"))
    up, down = F.col("zone") > last, F.col("zone") < first
    inside = ~up & ~down
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    cells = [zero(F.when(valid, F.col("rows"))).alias("n"), *[zero(F.when(inside, F.col(c))).alias(c) for c in ("squares", "sizes")]]
    for side, here in (("up", up), ("down", down)):
        cells += [zero(F.when(here, F.col(c))).alias(f"{side}_{name}") for name, c in (("n", "rows"), ("t", "t"), ("tt", "tt"))]
    keep = [*keys, "n_total", "n_ignored"]
    return _from_sums(rows.groupBy(*keep, "low", "high").agg(*cells), keep)


def counted_errors(counts: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE, MAE, n_total and n_ignored from answers counted by (keys, pred, truth)."""
    n, valid = F.col("n"), F.col("pred").isNotNull()
    bounds = counts.groupBy(*keys).agg(
        F.min(F.when(valid, F.col("truth"))).alias("low"), F.max(F.when(valid, F.col("truth"))).alias("high"),
        F.sum("n").alias("n_total"), F.coalesce(F.sum(F.when(~valid, n)), F.lit(0)).alias("n_ignored"))
    diff = F.when(valid, clip(F.col("pred"), F.col("low"), F.col("high")) - F.col("truth"))
    answered = F.sum(F.when(valid, n))
    return counts.join(bounds, keys).withColumn("diff", diff).groupBy(*keys, "n_total", "n_ignored").agg(
        F.sqrt(F.sum(n * F.col("diff") * F.col("diff")) / answered).alias("RMSE"), (F.sum(n * F.abs("diff")) / answered).alias("MAE"))
