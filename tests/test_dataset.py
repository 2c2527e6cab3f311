"""From raw files to a saved dataset."""

import gzip
import json

import pytest
from conftest import rows

from basketry.operators.predict import answer_texts
from basketry.plans import dataset


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sequential_data.txt").write_text("1 1 2 1\n2 2 3\n")
    maps = {"user2id": {"UA": "1", "UB": "2"}, "item2id": {"IA": "1", "IB": "2", "IC": "3"}}
    maps |= {"id2user": {"1": "UA"}, "id2item": {"1": "IA", "2": "IB", "3": "IC"}}
    (tmp_path / "datamaps.json").write_text(json.dumps(maps, indent=1))
    (tmp_path / "user_names").write_text('{"user_id": "2", "user_name": "Bo"}\n')
    (tmp_path / "ratings").mkdir()
    given = {"train": [("UA", "IA", 5), ("UB", "IB", 3)], "val": [("UA", "IA", 2)], "test": [("UA", "IC", 1)]}
    for part, records in given.items():
        lines = [
            json.dumps({"ord": i, "reviewerID": u, "asin": a, "overall": float(o)}) for i, (u, a, o) in enumerate(records)
        ]
        (tmp_path / "ratings" / part).write_text("\n".join(lines))
    meta = ["{'asin': 'IA', 'title': 'a', 'categories': [['c', 'd']]}", "{'asin': 'IB'}", "{'asin': 'IX'}", "{'asin': 'IC'}"]
    with gzip.open(tmp_path / "meta.json.gz", "wt") as f:
        f.write("\n".join(meta))
    return str(tmp_path)


def test_files_to_dataset(spark, folder, tmp_path):
    ds = dataset.find_dataset("FILES")(spark, folder, prefix=True, start_1001=True)
    got = ds.denormalised(strict=True)
    assert rows(got, "user_id", "pos", "item_id", "rating", "title", "user_name", "user_key") == [
        ("user_1", 0, "item_1001", 5, "a", "", "UA"),
        ("user_1", 1, "item_1002", None, "", "", "UA"),
        ("user_1", 2, "item_1001", 2, "a", "", "UA"),
        ("user_2", 0, "item_1002", 3, "", "Bo", ""),
        ("user_2", 1, "item_1003", None, "", "Bo", ""),
    ]
    assert rows(ds.all_users()) == [("user_1", 0), ("user_2", 1)]
    assert ds.all_items().count() == 3 and ds.items.count() == 3
    assert sorted(ds.splits()) == ["test", "train", "validation"]
    ds.save(f"{folder}/saved")
    back = dataset.load(spark, f"{folder}/saved")
    assert rows(back.interactions, "user_id", "pos") == rows(ds.interactions, "user_id", "pos")
    assert ds.sample(2, 1).count() == 0  # histories too short for a training window
    with pytest.raises(KeyError):
        dataset.find_dataset("other")


def test_ratings_in_line_order(spark, folder):
    from pathlib import Path

    for part in ("train", "val", "test"):
        path = Path(folder) / "ratings" / part
        plain = [{k: v for k, v in json.loads(x).items() if k != "ord"} for x in path.read_text().splitlines()]
        if part == "train":
            plain.append({"reviewerID": "UA", "asin": "IA", "overall": 4.0})
        path.write_text("\n".join(map(json.dumps, plain)))
    ds = dataset.from_files(spark, folder, prefix=False, ratings_order=None)
    assert rows(ds.interactions, "user_id", "pos", "rating") == [("1", 0, 5), ("1", 1, None), ("1", 2, 4), ("2", 0, 3), ("2", 1, None)]
    with pytest.raises(Exception, match="no place in its list"):
        dataset.from_files(spark, folder).interactions.collect()


def test_plain_ids(spark, folder):
    ds = dataset.from_files(spark, folder, prefix=False)
    assert rows(ds.interactions, "user_id", "item_id")[0] == ("1", "1")


def test_typed_texts(spark):
    def load():
        return lambda texts, n: [[t.upper()] * n for t in texts]

    assert answer_texts(spark, ["b", "a"], load, 2) == [["B", "B"], ["A", "A"]]
