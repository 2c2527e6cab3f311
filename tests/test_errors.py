"""Error metrics: parsing, clipping, guards."""

import random
from math import sqrt

import pytest
from pyspark.sql import functions as F

from basketry.operators import errors
from basketry.operators.metricspec import metric

# Four users with two answers each; distances by hand.
TRUTHS = [["5", "2"], ["1", "1"], ["4", "3"], ["2", "5"]]
PREDS = [["4.5", "2"], ["1.25", "3"], ["4", "2.5"], ["2.75", "1"]]
DIFFS = [0.5, 0, -0.25, -2, 0, 0.5, -0.75, 4]


def table(spark, preds, truths):
    data = [("t", p, t) for p, t in zip(preds, truths)]
    return spark.createDataFrame(data, "task string, preds array<string>, truths array<string>")


def diffs(spark, preds, truths):
    pairs = errors.answer_pairs(table(spark, preds, truths), ["task"])
    bounds = errors.answer_bounds(pairs, ["task"])
    return sorted(r["diff"] for r in errors.rating_diffs(pairs, bounds, ["task"]).collect())


def score(spark, preds, truths):
    wanted = [metric("rmse"), metric("mae")]
    return errors.error_metrics(table(spark, preds, truths), wanted, ["task"]).first()


def test_known_distances(spark):
    assert sorted(map(abs, diffs(spark, PREDS, TRUTHS))) == pytest.approx(sorted(map(abs, DIFFS)))
    row = score(spark, PREDS, TRUTHS)
    assert row["MAE"] == pytest.approx(8 / 8)
    assert row["RMSE"] == pytest.approx(sqrt((0.25 + 0.0625 + 4 + 0.25 + 0.5625 + 16) / 8))
    assert row["n_total"] == 8 and row["n_ignored"] == 0


@pytest.mark.parametrize("answer, used", [("7.5", 5), ("5.0001", 5), ("0", 1), ("-3e4", 1), ("1", 1), ("4.75", 4.75)])
def test_answers_are_cut_to_the_range_of_the_truths(spark, answer, used):
    """The other user's truths span 1 to 5; the one truth in question is 3."""
    got = diffs(spark, [["1", "5"], [answer]], [["1", "5"], ["3"]])
    assert sorted(map(abs, got)) == pytest.approx(sorted([0, 0, abs(3 - used)]))


def test_answers_and_truths_pair_up(spark):
    for preds, truths in (([["4"], ["2", "2"]], [["4"], ["2"]]), ([["4"], ["2"]], [["4"], ["2", "1"]]), ([[]], [["4"]])):
        with pytest.raises(Exception, match="1:1"):
            diffs(spark, preds, truths)


def test_a_truth_must_be_a_number(spark):
    with pytest.raises(Exception, match="number"):
        diffs(spark, [["4"], ["2"]], [["4"], ["two"]])


def test_answers_without_a_number_are_left_out_and_counted(spark):
    preds = [["4.5", "about 2"], ["", "3"], ["4", "2.5"], ["2.75", "?"]]
    assert sorted(map(abs, diffs(spark, preds, TRUTHS))) == pytest.approx([0, 0.5, 0.5, 0.75, 2])
    row = score(spark, preds, TRUTHS)
    assert (row["n_total"], row["n_ignored"]) == (8, 3) and row["MAE"] == pytest.approx(3.75 / 5)


def test_all_unparsable(spark):
    row = score(spark, [["a", "b", "c"]], [["1", "2", "3"]])
    assert row["RMSE"] is None and row["MAE"] is None and row["n_ignored"] == 3


def test_number_texts(spark):
    texts = ["3", " 3.5 ", "-.5", "1e2", "1d", "1f", "NaN", "inf", "-Infinity", "", "4 stars", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(errors.to_number(F.col("t"))).collect()]
    inf = float("inf")
    assert got == [3.0, 3.5, -0.5, 100.0, None, None, None, inf, -inf, None, None, None]


def plain_running(answers, percents):
    """(percent, n_total, n_ignored, RMSE, MAE) over all answers up to each percent."""
    out = []
    for p in sorted(set(percents)):
        seen = [(a, t) for q, a, t in answers if q <= p]
        valid = [(a, t) for a, t in seen if a is not None]
        low, high = (f([t for _, t in valid], default=None) for f in (min, max))
        diffs_ = [min(max(a, low), high) - t for a, t in valid]
        rmse = sqrt(sum(d * d for d in diffs_) / len(diffs_)) if diffs_ else None
        out.append((p, len(seen), len(seen) - len(valid), rmse, sum(map(abs, diffs_)) / len(diffs_) if diffs_ else None))
    return out


@pytest.mark.parametrize("seed, shift", [(1, 0), (2, 1000), (3, -4)])
def test_running_errors_match_sums_from_the_start(spark, seed, shift):
    rng = random.Random(seed)
    answers = []
    for q in range(1, 60):
        span = 0.2 + q / 15  # the truths spread out, so answers enter the range one after the other
        for _ in range(rng.randrange(0, 6)):
            truth = round(shift + rng.uniform(-span, span), 3)
            pred = rng.choice([None, shift + rng.uniform(-8, 8), shift + rng.gauss(0, 1), truth, float("inf"), float("-inf")])
            answers.append((q, pred, truth))
    answers += [(70, None, shift + 50.0), (80, shift + 2.0, shift + 90.0)]
    shown = [("t", q, ["word" if a is None else str(a)], [str(t)]) for q, a, t in answers]
    out = errors.running_error_metrics(spark.createDataFrame(shown, "task string, percent int, preds array<string>, truths array<string>"), ["task"])
    got = sorted((r.percent, r.n_total, r.n_ignored, r.RMSE, r.MAE) for r in out.collect())
    want = plain_running(answers, [q for q, _, _ in answers])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3:] == (None, None) if w[3] is None else g[3:] == pytest.approx(w[3:], abs=1e-6)


def test_zones_keep_what_any_range_needs(spark):
    rng = random.Random(7)
    scale = (1, 5, 0.5)
    marks = [1 + 0.5 * i for i in range(9)]
    rows_ = []
    for task, truths in (("all", marks), ("middle", [2.5, 3.0, 4.0]), ("one", [3.5]), ("none", [2.0])):
        for _ in range(200):
            pred = "?" if task == "none" else str(rng.choice([rng.uniform(-2, 8), rng.choice(marks), 1e9, "inf", "-inf", "no"]))
            rows_.append((task, [pred], [str(rng.choice(truths))]))
    frame = spark.createDataFrame(rows_, "task string, preds array<string>, truths array<string>")
    pairs = errors.answer_pairs(frame, ["task"])
    zones = errors.zone_sums(pairs, ["task"], scale)
    assert zones.count() <= 4 * 20
    got = {r.task: r for r in errors.zone_errors(zones, ["task"], scale).collect()}
    want = errors.error_metrics(frame, [metric("rmse"), metric("mae")], ["task"]).collect()
    assert len(got) == len(want) == 4
    for w in want:
        g = got[w.task]
        assert (g.n_total, g.n_ignored) == (w.n_total, w.n_ignored)
        assert (g.RMSE, g.MAE) == ((None, None) if w.RMSE is None else pytest.approx((w.RMSE, w.MAE)))
    with pytest.raises(Exception, match="mark of the scale"):
        errors.zone_sums(pairs, ["task"], (1, 5, 1)).collect()
