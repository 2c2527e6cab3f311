"""Histories from the star schema, on rows of their own."""

import datetime

from conftest import rows
from pyspark.sql import functions as F

from basketry.sources import retail

DAY = datetime.datetime(2020, 1, 1)


def write(spark, folder, lines, orders):
    """``lines`` (order, part) and ``orders`` (order, customer) as tables."""
    numbered = [(o, p, 1, i, 3.0, 1.0, 0.0, 0.0, "N", "O", DAY) for i, (o, p) in enumerate(lines)]
    spark.createDataFrame(numbered, retail.SCHEMAS["lineitem"]).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(o, c, "O", 1.0, DAY, "1") for o, c in orders], retail.SCHEMAS["orders"]).write.parquet(f"{folder}/orders.parquet")


def test_the_row_bound_is_that_of_one_user(spark, tmp_path, monkeypatch):
    """Many users with few rows each have a small bound; repeated and null keys are counted in."""
    lines = [(o, o % 7) for o in range(60) for _ in range(2)] + [(None, 1), (5, 1)]
    orders = [(o, o // 2) for o in range(60)] + [(6, 3), (None, 3), (61, None)]
    write(spark, tmp_path, lines, orders)
    items = spark.createDataFrame([(None if p is None else str(p), p) for p in [0, 1, 1, 2, 3, 4, 5, 6, None]], "item_id string, item_idx long")
    before = rows(retail.interactions(spark, str(tmp_path), items), "user_id", "pos", "n", "item_id")
    monkeypatch.setattr(retail, "HOT_ROWS", 10)
    assert retail.row_bound(spark, str(tmp_path)) == 4 * 3
    keyed = items.select(F.col("item_id").cast("bigint").alias("l_partkey"))
    assert retail.row_bound(spark, str(tmp_path), keyed) == 4 * 3 * 2
    after = retail.interactions(spark, str(tmp_path), items)
    assert after.agg(F.max("n")).first()[0] <= 24 and rows(after, "user_id", "pos", "n", "item_id") == before
