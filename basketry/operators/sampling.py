"""Seeded sampling: training windows, targets, ratings, tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import draws
from basketry.functions.text import one_decimal, remove_at, sub_sequence
from basketry.operators import splits


def window_size(length: Column, seed: int, epoch: Column, user: Column) -> Column:
    """Input rows of a training window: uniform in least .. length-1.

    ``least`` is 1 for a history of two and 2 otherwise; one row is left as target.
    """
    least = F.when(length == 2, F.lit(1)).otherwise(F.lit(2))
    return least + draws.pick(length - least, seed, epoch, user, "window/size")


def window_start(length: Column, size: Column, seed: int, epoch: Column, user: Column) -> Column:
    """First row of the window: uniform among the places that leave a target."""
    return draws.pick(length - size, seed, epoch, user, "window/start")


def with_epochs(rows: DataFrame, epochs: int) -> DataFrame:
    """One copy of each row per epoch 1..epochs."""
    every = F.sequence(F.lit(1).cast("bigint"), F.lit(epochs).cast("bigint"))
    return rows.withColumn("epoch", F.explode(every))


def training_windows(interactions: DataFrame, epochs: int, seed: int, split: str = "train") -> DataFrame:
    """(user_id, epoch, size, start) for every user with two training rows or more.

    ``split`` is "train" or "train_validation", the merged one.  The user list is the rows at
    position 0, so no grouping is needed.
    """
    length = splits.split_size(split)
    users = interactions.filter((F.col("pos") == 0) & (length >= 2)).select("user_id", "n")
    return _with_window(with_epochs(users, epochs), length, seed).drop("n")


def _with_window(rows: DataFrame, length: Column, seed: int) -> DataFrame:
    who = (seed, F.col("epoch"), F.col("user_id"))
    sized = rows.withColumn("size", window_size(length, *who))
    return sized.withColumn("start", window_start(length, F.col("size"), *who))


def require_windows(interactions: DataFrame, split: str = "train") -> DataFrame:
    """The rows unchanged; the job fails at a user too short for a training window."""
    message = F.concat(F.lit("no training window fits the history of user "), F.col("user_id"))
    return interactions.filter(F.when(splits.split_size(split) < 2, F.raise_error(message).cast("boolean")).otherwise(True))


def too_short(interactions: DataFrame, split: str = "train") -> DataFrame:
    """Users with a training history that gives no window."""
    return interactions.filter((F.col("pos") == 0) & (splits.split_size(split) < 2)).select("user_id", "n")


def window_rows(
    interactions: DataFrame, windows: DataFrame, block: int = splits.SEGMENT
) -> DataFrame:
    """Row form of sampled windows: spot 0..input_len, the last one is the target.

    No per-user list: used for users of any length.  The join key holds the position
    block beside the user, so a very long user is spread over the tasks.
    """
    last = F.col("start") + F.col("size")
    spread = windows.withColumn(
        "block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size) div {block}")))
    )
    rows = interactions.withColumn("block", F.expr(f"pos div {block}"))
    inside = F.col("pos").between(F.col("start"), last)
    spot = F.col("pos") - F.col("start")
    return (
        rows.join(spread, ["user_id", "block"])
        .filter(inside)
        .withColumn("spot", spot)
        .withColumn("part", F.when(spot == F.col("size"), "target").otherwise("input"))
        .withColumnRenamed("size", "input_len")
        .drop("start", "block")
    )


def train_examples(
    interactions: DataFrame, fields: list[str], epochs: int, seed: int, size: int = splits.SEGMENT, split: str = "train"
) -> DataFrame:
    """user_id, epoch, input ARRAY<STRUCT>, target STRUCT for each sampled window.

    One grouping by user serves all epochs; each epoch is a slice of the same array.  A user of more
    than ``size`` rows fails the job; :func:`window_rows` is the form for any length.
    """
    rows = interactions.filter(splits.in_split(split) & (splits.split_size(split) >= 2))
    seqs = with_epochs(splits.sequences(rows, fields, size), epochs)
    return _with_window(seqs, splits.split_size(split), seed).select(
        "user_id",
        "epoch",
        sub_sequence(F.col("seq"), F.col("start"), F.col("size")).alias("input"),
        F.get("seq", (F.col("start") + F.col("size")).cast("int")).alias("target"),
    )


def resample_target(examples: DataFrame, seed: int, purpose: str, input: str = "input", target: str = "target") -> DataFrame:
    """Draw one position of input+target as the new target and take it out of the input.

    The results replace the two columns, or are added under the names given.
    """
    drawn = examples.withColumn("pool", F.array_append("input", F.col("target"))).withColumn(
        "at", draws.pick(F.size("pool"), seed, F.col("epoch"), F.col("user_id"), purpose)
    )
    return (
        drawn.withColumns({target: F.get("pool", F.col("at").cast("int")), input: remove_at(F.col("pool"), F.col("at"))})
        .drop("pool", "at")
    )


def resample_rows(rows: DataFrame, seed: int, purpose: str) -> DataFrame:
    """Row form of :func:`resample_target`: another spot becomes the target."""
    at = draws.pick(F.col("input_len") + 1, seed, F.col("epoch"), F.col("user_id"), purpose)
    return rows.withColumn("part", F.when(F.col("spot") == at, "target").otherwise("input"))


# Range of perturbed ratings around each star.
STAR_RANGES = {1: (1.0, 1.4), 2: (1.5, 2.4), 3: (2.5, 3.4), 4: (3.5, 4.4), 5: (4.5, 5.0)}


def perturbed_rating(rating: Column, *parts) -> Column:
    """Normal draw around the star (mid range, a quarter of it as deviation), one decimal."""

    def by_star(value) -> Column:
        chain = None
        for star, bounds in STAR_RANGES.items():
            cell = F.lit(value(*bounds))
            hit = rating == star
            chain = F.when(hit, cell) if chain is None else chain.when(hit, cell)
        return chain

    mean, std = by_star(lambda lo, hi: (lo + hi) / 2), by_star(lambda lo, hi: (hi - lo) / 4)
    return one_decimal(draws.gauss(mean, std, *parts))


def wrong_rating(rating: Column, *parts) -> Column:
    """Uniform over the other four ratings."""
    return (rating + draws.pick(4, *parts)) % 5 + 1


def pick_category(categories: Column, *parts) -> Column:
    """Uniform over the list, empty text for an empty one."""
    size = F.size(categories)
    at = draws.pick(F.greatest(size, F.lit(1)), *parts)
    return F.coalesce(F.get(categories, at.cast("int")), F.lit(""))


def pick_task(tasks: list[str], seed: int, epoch: Column, user: Column) -> Column:
    return draws.choose(tasks, seed, epoch, user, "task")
