"""Splits, rating attachment, id handling, raw readers."""

import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from basketry.operators import history, sampling, splits
from basketry.operators.numbering import number_rows
from basketry.sources import layout, raw


@pytest.fixture(scope="module")
def short(spark):
    """Users a..d with 1..4 rows."""
    data = [(u, i, f"{u}{i}", 1 + i % 5) for n, u in enumerate("abcd", 1) for i in range(n)]
    df = spark.createDataFrame(data, "user_id string, ts long, item_id string, rating long")
    return number_rows(df, ["user_id"], ["ts"], at_most=10).drop("ts")


def test_short_histories(short):
    def users(df):
        return sorted({r.user_id for r in df.collect()})

    assert users(splits.split_rows(short, "train")) == ["c", "d"]
    assert users(splits.split_rows(short, "validation")) == ["c", "d"]
    assert users(splits.split_rows(short, "test")) == ["b", "c", "d"]
    assert users(splits.split_rows(short, "train_validation")) == ["b", "c", "d"]
    assert users(sampling.train_examples(short, ["item_id"], 3, 1)) == ["d"]
    assert rows(sampling.too_short(short), "user_id") == [("a",), ("b",), ("c",)]
    d = sampling.train_examples(short, ["item_id"], 5, 1).collect()
    assert all([x.item_id for x in r.input] == ["d0"] and r.target.item_id == "d1" for r in d)


def test_strict_mode_names_the_short_user(short):
    with pytest.raises(Exception, match="no training window"):
        sampling.require_windows(short).collect()
    assert sampling.require_windows(short.filter("user_id = 'd'")).count() == 4


def test_split_partitions_the_history(short):
    parts = {s: splits.split_rows(short, s) for s in splits.SPLITS}
    train = rows(parts["train"].filter("user_id = 'd'"), "pos")
    val = rows(parts["validation"].filter("user_id = 'd' AND part = 'target'"), "pos")
    test = rows(parts["test"].filter("user_id = 'd' AND part = 'target'"), "pos")
    assert train + val + test == [(0,), (1,), (2,), (3,)]


def test_split_forms_agree(short):
    ex = splits.examples(short, "test", ["item_id"])
    flat = ex.select("user_id", F.explode("input.item_id").alias("item_id"), F.col("target.item_id").alias("t"))
    joined = splits.split_by_join(short, "test").select("user_id", "item_id", F.col("target_item").alias("t"))
    assert rows(flat) == rows(joined)
    ends = splits.targets(short, "test", ["item_id"])
    assert rows(ends, "user_id", "target.item_id") == rows(ex, "user_id", "target.item_id")


def test_segments_are_bounded_and_whole(short):
    seqs = splits.segments(short, ["item_id"], size=2)
    assert max(len(r.seq) for r in seqs.collect()) == 2
    assert rows(seqs.select("user_id", F.explode("seq.item_id"))) == rows(short, "user_id", "item_id")


def test_published_layout(spark, short, tmp_path):
    layout.save_splits(short, str(tmp_path / "s"))
    back = layout.load_split(spark, str(tmp_path / "s"), "validation")
    assert rows(back, "user_id", "pos", "part") == rows(
        splits.split_rows(short, "validation"), "user_id", "pos", "part"
    )
    merged = layout.named_splits(short, merge_train_val=True)
    assert sorted(merged) == ["test", "train"] and merged["train"].count() == 6
    assert rows(layout.first_rows(short, ["user_id", "pos"], 2), "user_id") == [("a",), ("b",)]


def test_ratings_go_to_occurrences_in_order(spark):
    hist = spark.createDataFrame(
        [("u", 0, "x"), ("u", 1, "y"), ("u", 2, "x"), ("u", 3, "z")], "user_id string, pos long, item_id string"
    )
    ratings = spark.createDataFrame(
        [("u", "x", 5, 0, 1), ("u", "x", 2, 1, 0), ("u", "w", 1, 0, 0), ("u", "y", 3, 2, 0), ("u", "x", 4, 2, 1)],
        "user_id string, item_id string, rating long, part long, ord long",
    )
    want = [("u", 0, 5), ("u", 1, 3), ("u", 2, 2), ("u", 3, None)]
    for hot in (1_000_000, 1):
        got = history.attach_ratings(hist, ratings, hot_rows=hot)
        assert rows(got, "user_id", "pos", "rating") == want
    quality = history.history_quality(history.attach_ratings(hist, ratings)).first()
    assert (quality.n_users, quality.n_short, quality.n_unrated) == (1, 0, 1)


def test_id_maps_strict_and_lenient(spark):
    data = spark.createDataFrame([("A",), ("B",)], "k string")
    mapping = spark.createDataFrame([("A", "1")], "key string, id string")
    assert rows(history.map_ids(data, "k", mapping, "i")) == [("A", "1")]
    assert rows(history.unmapped(data, "k", mapping)) == [("B",)]
    with pytest.raises(Exception, match="without an id"):
        history.map_ids(data, "k", mapping, "i", strict=True).collect()


def test_items_without_metadata(spark):
    data = spark.createDataFrame([("1",), ("2",)], "item_id string")
    items = spark.createDataFrame([("1", "t", [])], "item_id string, title string, categories array<string>")
    assert rows(history.add_items(data, items, ["title", "categories"])) == [("1", "t", []), ("2", "", [])]
    with pytest.raises(Exception, match="without metadata"):
        history.add_items(data, items, ["title"], strict=True).collect()


def test_display_ids(spark):
    data = spark.createDataFrame([("7", "5")], "user_id string, item_id string")
    row = history.display_ids(data, prefix=True, start_1001=True).first()
    assert (row.user_id, row.item_id, row.user_raw, row.item_raw) == ("user_7", "item_1005", "7", "5")


def test_sequence_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("1 10 11 10\n\n2\t7   8\n3\n")
    got = raw.read_sequence_log(spark, str(path))
    assert rows(got, "user_id", "pos", "n", "item_id") == [
        ("1", 0, 3, "10"), ("1", 1, 3, "11"), ("1", 2, 3, "10"), ("2", 0, 2, "7"), ("2", 1, 2, "8"),
    ]


def test_metadata_lines(spark, tmp_path):
    path = tmp_path / "meta.gz"
    lines = [
        "{'asin': 'A', 'title': u'it\\'s', 'categories': [['Toys', 'Games'], ['x']], 'price': 3.5}",
        "{'asin': 'B', 'title': None, 'new': True}",
        "{'asin': 'C', 'categories': []}",
        "__import__('os').getcwd()",
        "{'title': 'no id'}",
    ]
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines))
    parsed = raw.read_item_metadata(spark, str(path), tasks=2)
    assert parsed.filter("bad_line IS NOT NULL").count() == 2
    assert rows(raw.clean_items(parsed), "item_key", "title", "categories", "price", "brand") == [
        ("A", "it's", ["Toys", "Games"], "3.5", ""), ("B", "", [], "", ""), ("C", "", [], "", ""),
    ]


def test_id_map_and_rating_files(spark, tmp_path):
    (tmp_path / "maps.json").write_text('{\n"user2id": {"U1": "1"},\n"item2id": {"I1": "1", "I2": "2"}}')
    maps = raw.read_id_maps(spark, str(tmp_path / "maps.json"))
    assert rows(maps["item2id"]) == [("I1", "1"), ("I2", "2")] and maps["id2item"].count() == 0
    for i in range(2):
        (tmp_path / f"r{i}.json").write_text(
            f'{{"ord": 0, "reviewerID": "U{i}", "asin": "I1", "overall": 4.0}}\n'
        )
    got = raw.read_ratings(spark, [str(tmp_path / f"r{i}.json") for i in range(2)], "json")
    assert rows(got, "user_key", "rating", "part") == [("U0", 4, 0), ("U1", 4, 1)]
    (tmp_path / "names.json").write_text('{"user_id": "1", "user_name": "Ada"}\n')
    assert rows(raw.read_user_names(spark, str(tmp_path / "names.json"), "json")) == [("1", "Ada")]


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_one_large_json_object(spark, tmp_path, split):
    """Commas, quotes, braces and backslashes in keys and values; splits of a few bytes to all of it."""
    odd = ["a,b", 'q"u,o"te', "{x},{y}", "back\\", "\\,\\", "ü,漢", "", ",", '",', "tail}"]
    whole = {
        "user2id": {f"U{i}" + odd[i % len(odd)]: odd[i % 7] + str(i) for i in range(60)},
        "item2id": {},
        "other": {"user2id": "not a section"},
        "id2user": {str(i): f"U{i}" for i in range(40)},
        "id2item": {"1": "I,1"},
    }
    for indent in (None, 2):
        path = tmp_path / f"maps{indent}.json"
        path.write_text(json.dumps(whole, indent=indent, ensure_ascii=indent is None))
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            maps = raw.read_id_maps(spark, str(path))
            got = {m: dict(map(tuple, maps[m].collect())) for m in raw.ID_MAPS}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == {m: whole.get(m, {}) for m in raw.ID_MAPS}


def test_a_member_that_is_no_pair_fails(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"user2id": {"a": "1", b: 2}}')
    with pytest.raises(Exception, match="not a member"):
        raw.read_id_maps(spark, str(tmp_path / "m.json"))["user2id"].collect()


def test_long_users_are_never_dropped_unseen(short):
    assert splits.sequences(short, ["item_id"], 4).count() == 4
    with pytest.raises(Exception, match="more than 3 rows.*d"):
        splits.sequences(short, ["item_id"], 3).collect()
    with pytest.raises(Exception, match="more than 3 rows"):
        sampling.train_examples(short, ["item_id"], 1, 1, size=3).collect()
    apart = splits.sequences(splits.short_users(short, 3), ["item_id"], 3).count() + splits.long_users(short, 3).select("user_id").distinct().count()
    assert apart == 4


@pytest.mark.parametrize("size", [1, 2, 4096])
def test_split_by_join_spreads_users(short, size):
    cols = ["user_id", "pos", "item_id", "target_item", "target_rating"]
    got = rows(splits.split_by_join(short, "test", size), *cols)
    assert got == rows(splits.split_by_join(short, "test"), *cols) and len(got) == 1 + 2 + 3


def test_gathered_lists_are_bounded(short):
    got = rows(splits.gather_columns(short, ["user_id"], "pos", ["item_id"]), "user_id", "item_id")
    assert got == [(u, [f"{u}{i}" for i in range(n)]) for n, u in enumerate("abcd", 1)]
    with pytest.raises(Exception, match="a list may hold 3"):
        splits.gather_columns(short, ["user_id"], "pos", ["item_id"], size=3).collect()


def test_a_run_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "history")
    one = spark.createDataFrame([("t", "m", 1.0, 1), ("t", "m", 2.0, 2)], "task string, metric string, value double, epoch long")
    layout.append_history(one, path, "first")
    layout.append_history(one.filter("epoch = 2").withColumn("value", F.lit(5.0)), path, "first")
    layout.append_history(one.filter("epoch = 1"), path, "second")
    got = sorted(map(tuple, spark.read.parquet(path).select("exp_name", "epoch", "value").collect()))
    assert got == [("first", 1, 1.0), ("first", 2, 5.0), ("second", 1, 1.0)]
