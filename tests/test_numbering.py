"""Numbering: the hot-key way, dense and shuffled indexes, running sums."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from basketry.functions import draws
from basketry.operators import numbering as nb


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 == 0 else f"u{i % 17}", i, rng.random()) for i in range(600)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "user string, ts long, value double")


def test_hot_keys_are_numbered_alike(spark, events):
    plain = nb.number_rows(events, ["user"], ["ts"], lead={"following": "ts"}, at_most=600)
    hot = nb.number_rows(events, ["user"], ["ts"], lead={"following": "ts"}, hot_rows=50)
    cols = ["user", "ts", "pos", "n", "following"]
    assert rows(plain, *cols) == rows(hot, *cols)
    assert rows(nb.hot_keys(events, ["user"], 50)) == [("hot",)]


def test_sketch_finds_the_keys_that_counting_finds(spark, events, monkeypatch):
    two = events.withColumn("odd", F.col("ts") % 2)
    for keys, limit in ((["user"], 20), (["user", "odd"], 50), (["user", "odd"], 150), (["odd"], 0)):
        counted = two.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
        assert rows(nb.hot_keys(two, keys, limit)) == rows(counted)
        assert rows(nb.hot_keys(two, keys, limit, tracked=16)) == rows(counted)  # too few for the sketch: all are counted
    pinned = []
    monkeypatch.setattr(nb, "pin", lambda df, label: pinned.append((label, df.columns)) or df)
    nb.number_rows(events, ["user"], ["ts"], hot_rows=50).collect()
    assert dict(pinned)["hot-keys"] == ["user"] and "to-number" not in dict(pinned)


def test_all_keys_hot(events):
    hot = nb.number_rows(events, ["user"], ["ts"], hot_rows=1)
    assert rows(hot, "user", "ts", "pos", "n") == rows(
        nb.number_rows(events, ["user"], ["ts"], at_most=1), "user", "ts", "pos", "n"
    )


@pytest.mark.parametrize("limit", [10, 10_000])
def test_dense_index(events, limit):
    out = nb.dense_index(events, ["ts"], "idx", one_task_rows=limit)
    assert [r.idx for r in out.orderBy("ts").collect()] == list(range(600))


def test_shuffled_index(events):
    drawn = events.withColumn("draw", draws.draw(1, F.col("ts")))
    whole = nb.shuffled_index(drawn, "draw", ["ts"], "idx", 600)
    blocks = nb.shuffled_index(drawn, "draw", ["ts"], "idx", 600, block_rows=20)
    assert rows(whole, "ts", "idx") == rows(blocks, "ts", "idx")
    assert sorted(r.idx for r in blocks.collect()) == list(range(600))
    order = [r.ts for r in blocks.orderBy("idx").collect()]
    assert order == [r.ts for r in drawn.orderBy("draw", "ts").collect()] != sorted(order)


def test_running_sums_cross_blocks(events):
    out = nb.running_sums(events, ["user"], "ts", {"so_far": "value"}, block=32)
    got = {r.ts: r.so_far for r in out.collect()}
    sums: dict[str, float] = {}
    for r in sorted(events.collect(), key=lambda r: r.ts):
        sums[r.user] = sums.get(r.user, 0) + r.value
        assert got[r.ts] == pytest.approx(sums[r.user])


@pytest.mark.parametrize("block", [2, 4, 25, 600, 4096])
def test_running_sums_of_many_levels(events, block):
    out = nb.running_sums(events.withColumn("one", F.lit(1)), ["user"], "ts", {"so_far": "value", "rows": "one"}, block=block)
    got = {r.ts: (r.so_far, r.rows) for r in out.collect()}
    sums: dict[str, tuple] = {}
    for r in sorted(events.collect(), key=lambda r: r.ts):
        total, count = sums.get(r.user, (0.0, 0))
        sums[r.user] = (total + r.value, count + 1)
        assert got[r.ts] == (pytest.approx(sums[r.user][0]), sums[r.user][1])


def test_partition_count_does_not_matter(spark, events):
    got = []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(nb.number_rows(events, ["user"], ["ts"], hot_rows=50), "user", "ts", "pos"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]
