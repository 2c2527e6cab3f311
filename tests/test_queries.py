"""Registered queries against DuckDB on the smallest tables.

A part of them by default, all with BASKETRY_ALL=1 (or ``python -m checks.compare``).
"""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")

PART = [
    "next_item_metrics", "rating_attach_occurrence", "item_meta_denorm", "loo_split_test", "split_roundtrip",
    "dict_literal_items", "dense_user_index", "negatives_99", "prompt_rating", "prompt_direct_qa",
    "prompt_p5_seq_qa", "pieces_sequential_train", "token_budget", "pad_batches", "error_metrics", "report_rows",
    "metrics_csv", "running_metrics", "stream_running_metrics", "predict_topn_pandas",
]


def names():
    from checks import registry

    return sorted(registry.QUERIES) if os.environ.get("BASKETRY_ALL") else PART


@pytest.fixture(scope="module")
def con():
    from checks.compare import oracle

    return oracle(FOLDER)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    import __spark_entry__ as entry
    from checks.compare import compare

    ok, note = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_every_query_has_sql():
    from checks import registry

    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
