"""Purchase history from an order/line star schema (orders, lineitem, part, customer)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.numbering import HOT_ROWS, number_rows

LINE_ORDER = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


# Fixed schemas, so that building a plan reads no footers.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per purchased line with numeric item keys, not numbered yet."""
    bought = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return bought.join(orders, bought.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        (F.lit(1) + (F.col("l_quantity").cast("bigint") - 1) % 5).alias("rating"),
        *LINE_ORDER,
    )


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`lines` with the text item id."""
    return lines(spark, folder).withColumn("item_id", F.col("l_partkey").cast("string"))


def row_bound(spark: SparkSession, folder: str, keyed: DataFrame | None = None) -> int:
    """Upper bound of any user's history rows, also after a join with ``keyed`` (by l_partkey).

    All purchase rows, read from the Parquet footers, where these are few; else the most orders of a user
    times the most lines of an order times the most rows of an item.  Each is counted over its key alone,
    so the joined rows are not formed for it.
    """
    bought = table(spark, folder, "lineitem")
    rows = bought.count()
    if rows <= HOT_ROWS:
        return rows
    counted = [(table(spark, folder, "orders"), "o_custkey"), (bought, "l_orderkey")]
    counted += [(keyed, "l_partkey")] if keyed is not None else []
    most = [df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0 for df, key in counted]
    return math.prod(most)


def interactions(
    spark: SparkSession,
    folder: str,
    items: DataFrame | None = None,
    lead: dict[str, str] | None = None,
) -> DataFrame:
    """Numbered history rows: user_id, pos, n, item_id, rating and ``items`` columns.

    ``items`` (keyed by item_id) is joined before the numbering, so the shuffle by
    user also serves the later grouping by user.  Item ids cross the shuffle as the
    numbers they are sorted by and become text after it.
    """
    rows, keyed = lines(spark, folder), None
    if items is not None:
        keyed = items.withColumn("l_partkey", F.col("item_id").cast("bigint")).drop("item_id")
        rows = rows.join(keyed, "l_partkey")
    lead = {new: "l_partkey" if src == "item_id" else src for new, src in (lead or {}).items()}
    out = number_rows(rows, ["user_id"], LINE_ORDER, lead=lead, at_most=row_bound(spark, folder, keyed))
    out = out.withColumn("item_id", F.col("l_partkey").cast("string"))
    out = out.withColumns({new: F.col(new).cast("string") for new, src in lead.items() if src == "l_partkey"})
    return out.drop(*LINE_ORDER)


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Item metadata with text fields, missing title as empty text."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_partkey").alias("item_no"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit("")).otherwise(F.col("p_name")).alias("title"),
        F.col("p_type").alias("description"),
        F.array(
            F.col("p_brand"),
            F.col("p_type"),
            F.concat(F.lit("SIZE_"), F.col("p_size").cast("string")),
        ).alias("categories"),
        F.col("p_retailprice").alias("price"),
        F.lit("").alias("imurl"),
        F.col("p_brand").alias("brand"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """User names (empty for every seventh) and keys."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_name")).alias("user_name"),
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("user_key"),
    )
