"""Ranking metrics on hand-computed cases."""

from math import log2

import pytest
from pyspark.sql import functions as F

from basketry.operators import ranking
from basketry.operators.metricspec import (
    average_precision,
    check_compatible,
    largest_cut,
    metric,
    metric_exists,
    metric_names,
    ndcg,
    safe_div,
)

# Five readers with four recommended books each.  Relevant places, by hand:
# ann 2 and 4, bob 1, cleo none, dan 1 2 3, eve 4.
SHOWN = [["atlas", "novel", "comic", "guide"], ["poems", "atlas", "diary", "novel"], ["comic", "poems", "guide", "diary"],
         ["diary", "guide", "poems", "atlas"], ["novel", "comic", "atlas", "poems"]]
READ = [["guide", "novel"], ["poems", "comic", "essay"], ["essay"], ["guide", "poems", "diary"], ["poems"]]
# The same with a single book each: places 2, 1, none, 3, 4.
READ_ONE = [["novel"], ["poems"], ["essay"], ["poems"], ["poems"]]


def predictions(spark, preds, truths):
    data = [("t", p, t) for p, t in zip(preds, truths)]
    return spark.createDataFrame(data, "task string, preds array<string>, truths array<string>")


def score(spark, preds, truths, *names):
    metrics = [n if not isinstance(n, str) else metric(n) for n in names]
    row = ranking.ranking_metrics(predictions(spark, preds, truths), metrics, ["task"]).first()
    return [row[str(m)] for m in metrics]


def gain(*places):
    return sum(1 / log2(p + 1) for p in places)


def test_single_relevant_item(spark):
    hit, ap, rr, ndcg_ = score(spark, SHOWN, READ_ONE, "hit", "map", "mrr", "ndcg")
    assert hit == pytest.approx(4 / 5)
    assert ap == rr == pytest.approx((1 / 2 + 1 + 0 + 1 / 3 + 1 / 4) / 5)
    assert ndcg_ == pytest.approx((gain(2) + 1 + 0 + gain(3) + gain(4)) / 5)


def test_sets_of_relevant_items(spark):
    hit, ap, rr, ndcg_ = score(spark, SHOWN, READ, "hit", "map", "mrr", "ndcg")
    assert hit == pytest.approx(4 / 5)
    assert ap == pytest.approx(((1 / 2 + 2 / 4) / 2 + 1 + 0 + 1 + 1 / 4) / 5)
    assert rr == pytest.approx((1 / 2 + 1 + 0 + 1 + 1 / 4) / 5)
    assert ndcg_ == pytest.approx((gain(2, 4) / gain(1, 2) + 1 + 0 + 1 + gain(4)) / 5)


@pytest.mark.parametrize("k, hit, ap, rr", [
    (1, 2 / 5, (0 + 1 + 0 + 1 + 0) / 5, 2 / 5),
    (2, 3 / 5, (1 / 2 + 1 + 0 + 1 + 0) / 5, (1 / 2 + 1 + 1) / 5),
    (3, 3 / 5, (1 / 2 + 1 + 0 + 1 + 0) / 5, (1 / 2 + 1 + 1) / 5),
    (4, 4 / 5, (1 / 2 + 1 + 0 + 1 + 1 / 4) / 5, (1 / 2 + 1 + 1 + 1 / 4) / 5),
    (9, 4 / 5, (1 / 2 + 1 + 0 + 1 + 1 / 4) / 5, (1 / 2 + 1 + 1 + 1 / 4) / 5),
])
def test_every_cutoff(spark, k, hit, ap, rr):
    assert score(spark, SHOWN, READ, f"hit@{k}", f"map@{k}", f"mrr@{k}") == pytest.approx([hit, ap, rr])


def test_gain_within_a_cutoff(spark):
    assert score(spark, SHOWN, READ, "ndcg@3") == pytest.approx([(gain(2) / gain(1) + 1 + 0 + 1 + 0) / 5])


def test_different_cutoffs_in_one_pass(spark):
    alone = [score(spark, SHOWN, READ, n)[0] for n in ("hit@1", "mrr@3", "map", "ndcg@2")]
    assert score(spark, SHOWN, READ, "hit@1", "mrr@3", "map", "ndcg@2") == pytest.approx(alone)


def test_no_hit_and_repeats(spark):
    assert score(spark, [["a", "b"]], [["z"]], "hit", "map", "mrr", "ndcg") == [0, 0, 0, 0]
    repeated = predictions(spark, [["a", "a"]], [["a"]])
    out = repeated.select(
        ranking.hit_ranks(ranking.relevance(F.col("preds"), F.col("truths"))).alias("r"),
        ranking.hit_ranks(
            ranking.drop_repeats(ranking.relevance(F.col("preds"), F.col("truths")), F.col("preds"))
        ).alias("d"),
    ).first()
    assert out.r == [1, 2] and out.d == [1]


def test_truth_based_options(spark):
    from dataclasses import replace

    by_truth = replace(metric("map"), per_row=average_precision("truth"))
    assert score(spark, [["a", "x"]], [["a", "b"]], by_truth) == [pytest.approx(0.5)]
    full = replace(metric("ndcg@2"), per_row=ndcg(ideal="truth", k=2))
    assert score(spark, [["a", "x"]], [["a", "b"]], full) == [pytest.approx(1 / (1 + 1 / log2(3)))]
    natural = replace(metric("ndcg"), per_row=ndcg(discount=F.log))
    assert score(spark, [["x", "a"]], [["a"]], natural) == [pytest.approx(log2(2) / log2(3))]


def test_null_in_truths_is_no_match(spark):
    assert score(spark, [["a", "b"]], [["b", None]], "mrr") == [pytest.approx(0.5)]


def test_reserved_token_fails(spark):
    with pytest.raises(Exception, match="reserved"):
        score(spark, [["<PAD>", "b"]], [["b"]], "hit")
    with pytest.raises(Exception, match="reserved"):
        score(spark, [["a", "b"]], [["<PAD>"]], "hit")


def test_division_by_zero_is_zero(spark):
    df = spark.createDataFrame([(9.0, 6.0, 1.5), (-7.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 8.0, 0.0)], "a double, b double, want double")
    assert all(r[0] == r[1] for r in df.select(safe_div(F.col("a"), F.col("b")), "want").collect())


def test_names():
    for spelled, name, k in (("Ndcg@25", "NDCG@25", 25), ("MAP", "MAP", None), ("mRr@1", "MRR@1", 1), ("LOSS", "Loss", None), ("mae", "MAE", None)):
        found = metric(spelled)
        assert str(found) == name and found.k == k
    assert metric("ndcg@7") == metric("NDCG@7") and metric("ndcg@7") != metric("ndcg@70")
    assert not metric("mae").larger_is_better and metric("mrr").larger_is_better
    for bad in ("mae@2", "loss@1", "map@", "map@k", "map@2@3", "recall", ""):
        with pytest.raises(KeyError):
            metric(bad)
    assert metric_exists("ndcg@4") and set(metric_names()) >= {"Hit", "RMSE"}
    with pytest.raises(KeyError):
        metric_exists("recall@4")


def test_largest_cut_and_families():
    assert largest_cut([metric("hit@1"), metric("map@7")]) == 7
    assert largest_cut([metric("hit@1"), metric("map")]) is None
    check_compatible("t", "ranking", [metric("hit"), metric("loss")])
    with pytest.raises(ValueError):
        check_compatible("t", "ranking", [metric("rmse")])


def test_metrics_stay_in_range_and_grow_with_k(spark):
    import random

    rng = random.Random(3)
    items = [str(i) for i in range(12)]
    preds = [rng.sample(items, 8) for _ in range(40)]
    truths = [rng.sample(items, rng.randint(1, 4)) for _ in range(40)]
    names = [f"{m}@{k}" for m in ("hit", "mrr", "map", "ndcg") for k in (1, 3, 8)]
    got = score(spark, preds, truths, *names)
    assert all(0 <= v <= 1 for v in got)
    assert got[0] <= got[1] <= got[2] and got[3] <= got[4] <= got[5]


def test_array_and_row_forms_agree(spark):
    df = predictions(spark, SHOWN, READ).withColumn("u", F.monotonically_increasing_id())
    ranked = ranking.running_precision(ranking.ranked_rows(df, ["u"]), ["u"])
    ap = ranked.groupBy("u").agg(
        F.sum(F.when(F.col("relevant"), F.col("precision"))).alias("s"), F.count_if("relevant").alias("n")
    )
    value = ap.agg(F.avg(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0))).first()[0]
    assert value == pytest.approx(score(spark, SHOWN, READ, "map")[0])
