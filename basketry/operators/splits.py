"""Leave-one-out splits over numbered history rows.

A numbered row carries its position ``pos`` and its user's length ``n``, so split
membership is a filter on two columns: no join, no copy, no per-user list.  The
list-valued form is built only where a list is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longest history that is held as one array value.  Longer users stay in row form.
SEGMENT = 4096

# rows of a user at the end of the history that the split does not see, and
# the shortest history that gives the split a non-empty input
_HIDDEN = {"train": 2, "validation": 1, "test": 0, "train_validation": 1}
_SHORTEST = {"train": 3, "validation": 3, "test": 2, "train_validation": 2}
_HAS_TARGET = {"validation", "test"}
SPLITS = ("train", "validation", "test")


def in_split(split: str, pos: str = "pos", n: str = "n") -> Column:
    """Is the row part of the split (as input or target)?"""
    return (F.col(n) >= _SHORTEST[split]) & (F.col(pos) < F.col(n) - _HIDDEN[split])


def split_size(split: str, n: str = "n") -> Column:
    """Number of a user's rows in the split."""
    return F.col(n) - _HIDDEN[split]


def split_rows(interactions: DataFrame, split: str) -> DataFrame:
    """Rows of one split with ``part`` = ``input`` or ``target``."""
    rows = interactions.filter(in_split(split))
    if split not in _HAS_TARGET:
        return rows.withColumn("part", F.lit("input"))
    is_target = F.col("pos") == split_size(split) - 1
    return rows.withColumn("part", F.when(is_target, "target").otherwise("input"))


def all_splits(interactions: DataFrame) -> DataFrame:
    """The published layout: every split's rows under a ``split`` label."""
    labelled = F.array(*[F.when(in_split(s), F.lit(s)) for s in SPLITS])
    rows = interactions.withColumn("split", F.explode(F.array_compact(labelled)))
    target = F.coalesce(
        *[
            F.when((F.col("split") == s) & (F.col("pos") == split_size(s) - 1), F.lit("target"))
            for s in sorted(_HAS_TARGET)
        ],
        F.lit("input"),
    )
    return rows.withColumn("part", target)


def split_by_join(interactions: DataFrame, split: str, size: int = SEGMENT) -> DataFrame:
    """The same examples as :func:`split_rows`, as input rows joined to their target.

    The key is the user and the block of ``size`` positions: a target is repeated once per
    block of its user, and a very long user is spread over the tasks.
    """
    rows = split_rows(interactions, split)
    keys = ["user_id", "block"]
    blocks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"pos div {int(size)}"))
    targets = rows.filter(F.col("part") == "target").select(
        "user_id", F.explode(blocks).alias("block"), F.col("item_id").alias("target_item"), F.col("rating").alias("target_rating")
    )
    inputs = rows.filter(F.col("part") == "input").drop("part").withColumn("block", F.expr(f"pos div {int(size)}"))
    return inputs.join(targets, keys).drop("block")


def segments(rows: DataFrame, fields: list[str], size: int = SEGMENT) -> DataFrame:
    """Ordered lists of at most ``size`` rows: one per (user, segment number).

    A user shorter than ``size`` has exactly one segment, which is the whole
    sequence.  The segment number is part of the grouping key, so a very long user
    is spread over many tasks and no list outgrows ``size``.
    """
    return (
        rows.withColumn("segment_no", F.expr(f"pos div {int(size)}"))
        .groupBy("user_id", "segment_no")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("seq"))
    )


def whole_texts(segs: DataFrame, keys: list[str], part: Column, separator: str, name: str) -> DataFrame:
    """One text per key from the texts of its segments, joined in order.

    Only the segments' texts meet, one per ``SEGMENT`` rows, and their sum is the value itself.
    """
    each = segs.select(*keys, "segment_no", part.alias("part"))
    packed = F.sort_array(F.collect_list(F.struct("segment_no", "part")))
    return each.groupBy(*keys).agg(F.array_join(packed["part"], separator).alias(name))


def short_users(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    return rows.filter(F.col("n") <= size)


def long_users(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    return rows.filter(F.col("n") > size)


def only_short(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``rows`` unchanged; the job fails at a user of more than ``size`` rows."""
    said = F.concat(F.lit(f"more than {size} rows; use the segment or row form for user "), F.col("user_id"))
    return rows.filter(F.when(F.col("n") <= size, True).otherwise(F.raise_error(said).cast("boolean")))


def sequences(rows: DataFrame, fields: list[str], size: int = SEGMENT) -> DataFrame:
    """One ordered array per user, for users of at most ``size`` rows; a longer one fails the job.

    Take :func:`short_users` and :func:`long_users` apart first, or use :func:`segments`.
    """
    return (
        only_short(rows, size)
        .groupBy("user_id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("seq"))
    )


def examples(
    interactions: DataFrame, split: str, fields: list[str], size: int = SEGMENT
) -> DataFrame:
    """user_id, epoch, input ARRAY<STRUCT>, target STRUCT for validation or test.

    For users of at most ``size`` rows, as :func:`sequences`; :func:`example_spots` is the row form.
    """
    rows = interactions.filter(in_split(split))
    seqs = sequences(rows, fields, size)
    return seqs.select(
        "user_id",
        F.lit(0).cast("bigint").alias("epoch"),
        F.slice(F.col("seq"), F.lit(1), F.size("seq") - 1).alias("input"),
        F.element_at("seq", -1).alias("target"),
    )


def targets(interactions: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """user_id, epoch, target STRUCT only: a filter, without any list."""
    last = interactions.filter(in_split(split) & (F.col("pos") == split_size(split) - 1))
    return last.select(
        "user_id", F.lit(0).cast("bigint").alias("epoch"), F.struct("pos", *fields).alias("target")
    )


def example_spots(interactions: DataFrame, split: str) -> DataFrame:
    """Row form of validation or test examples: epoch, spot 0..input_len, part."""
    return split_rows(interactions, split).withColumns(
        {
            "epoch": F.lit(0).cast("bigint"),
            "spot": F.col("pos"),
            "input_len": split_size(split) - 1,
        }
    )


def flat_columns(df: DataFrame, fields: list[str]) -> DataFrame:
    """``input`` / ``target`` structs as ``input_<field>_seq`` and one-element ``gt_<field>`` lists."""
    keep = [c for c in df.columns if c not in ("input", "target")]
    return df.select(
        *keep,
        *[F.col("input")[f].alias(f"input_{_short(f)}_seq") for f in fields],
        *[F.array(F.col("target")[f]).alias(f"gt_{_short(f)}") for f in fields],
    )


def _short(field: str) -> str:
    return field.removesuffix("_id")


def zip_columns(df: DataFrame, lists: list[str]) -> DataFrame:
    """Parallel list columns to one row per element."""
    keep = [c for c in df.columns if c not in lists]
    return df.select(*keep, F.inline(F.arrays_zip(*lists)))


def gather_columns(rows: DataFrame, keys: list[str], order: str, cols: list[str], size: int = SEGMENT) -> DataFrame:
    """One row per element back to parallel lists in the order of the 0-based place ``order``.

    A group may have ``size`` elements; a place beyond that fails the job before the group is gathered.
    """
    place = F.when(F.col(order) < size, F.col(order)).otherwise(
        F.raise_error(F.concat(F.lit(f"a list may hold {size} elements, there is one at place "), F.col(order).cast("string"))).cast("bigint")
    )
    packed = F.sort_array(F.collect_list(F.struct(place.alias(order), *cols)))
    grouped = rows.groupBy(*keys).agg(packed.alias("packed"))
    return grouped.select(*keys, *[F.col("packed")[c].alias(c) for c in cols])
