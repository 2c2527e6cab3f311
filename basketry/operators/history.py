"""Building the denormalised history: ids, ratings, names and item metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.numbering import HOT_ROWS, number_rows


def attach_ratings(
    history: DataFrame,
    ratings: DataFrame,
    *,
    at_most: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Ratings onto positions of the same (user, item), in order of occurrence.

    The first rating of a pair goes to its first occurrence, the second to the second
    and so on.  Ratings without an occurrence are ignored; positions without a rating
    get NULL.  Occurrence numbers are part of the join key, so a pair that repeats
    without end is still spread.
    """
    pair = ["user_id", "item_id"]
    bounds = {"total": None, "at_most": at_most, "hot_rows": hot_rows}
    left = number_rows(history, pair, ["pos"], pos="occurrence", **bounds)
    right = number_rows(ratings, pair, ["part", "ord"], pos="occurrence", **bounds)
    wanted = right.select(*pair, "occurrence", "rating")
    return left.join(wanted, [*pair, "occurrence"], "left").drop("occurrence")


def map_ids(rows: DataFrame, key: str, mapping: DataFrame, out: str, strict: bool = False) -> DataFrame:
    """Replace a string key by its mapped id; unmapped rows are dropped or fail.

    No hint is given: Spark broadcasts the map when it is under the size threshold and
    otherwise splits a hot key in the sort-merge join.
    """
    renamed = mapping.select(F.col("key").alias(key), F.col("id").alias(out))
    if not strict:
        return rows.join(renamed, key)
    joined = rows.join(renamed, key, "left")
    return joined.withColumn(out, required(F.col(out), f"{key} without an id"))


def required(value: Column, message: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(message))).otherwise(value)


def unmapped(rows: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """The rows whose key the map does not know."""
    return rows.join(mapping.select(F.col("key").alias(key)), key, "left_anti")


def known_items(items: DataFrame, mapping: DataFrame, key: str = "item_key") -> DataFrame:
    """Metadata of mapped items only."""
    return items.join(mapping.select(F.col("key").alias(key)), key, "left_semi")


def add_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    """user_name and user_key by id, empty text when unknown."""
    known = users.select("user_id", "user_name", "user_key")
    return rows.join(known, "user_id", "left").withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("user_name", "user_key")}
    )


def add_items(rows: DataFrame, items: DataFrame, fields: list[str], strict: bool = False) -> DataFrame:
    """Item fields by id; an item without metadata gets empty fields or fails."""
    marked = items.select("item_id", *fields, F.lit(True).alias("has_meta"))
    joined = rows.join(marked, "item_id", "left")
    if strict:
        joined = joined.filter(required(F.col("has_meta"), "item without metadata"))
    kinds = dict(joined.dtypes)
    for f in fields:
        empty = F.array().cast(kinds[f]) if kinds[f].startswith("array") else F.lit("")
        joined = joined.withColumn(f, F.coalesce(F.col(f), empty))
    return joined.drop("has_meta")


def shift_ids(item_id: Column, by: int = 1000) -> Column:
    """Numeric text id moved up, as text."""
    return (item_id.cast("bigint") + by).cast("string")


def prefixed(user_id: Column, item_id: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("user_"), user_id), F.concat(F.lit("item_"), item_id)


def display_ids(rows: DataFrame, prefix: bool = True, start_1001: bool = False) -> DataFrame:
    """Display forms of the ids; the raw ids stay as user_raw and item_raw."""
    out = rows.withColumn("user_raw", F.col("user_id")).withColumn("item_raw", F.col("item_id"))
    if start_1001:
        out = out.withColumn("item_id", shift_ids(F.col("item_id")))
    if prefix:
        user, item = prefixed(F.col("user_id"), F.col("item_id"))
        out = out.withColumn("user_id", user).withColumn("item_id", item)
    return out


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Distinct ids with the smallest order key they occur at."""
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first_at"))


def history_quality(rows: DataFrame, wanted: int = 2) -> DataFrame:
    """Counts of users too short for sampling and of positions without a rating."""
    per_user = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating").isNull()).alias("unrated")
    )
    return per_user.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if(F.col("n") < wanted).alias("n_short"),
        F.coalesce(F.sum("unrated"), F.lit(0)).alias("n_unrated"),
    )
