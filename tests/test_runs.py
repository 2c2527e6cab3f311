"""Whole runs: evaluation to reports, training rounds to the best epoch; tokenizers that cut early."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from basketry.operators import tokens
from basketry.operators.metricspec import metric
from basketry.operators.numbering import number_rows
from basketry.plans import prompts as pr
from basketry.plans import runs
from basketry.plans import templates as tpl

SEED = 5


@pytest.fixture(scope="module")
def hist(spark):
    data = [(f"u{u}", i, str((u * 7 + i * 3) % 20), 1 + (u + i) % 5) for u in range(8) for i in range(5 + u)]
    df = spark.createDataFrame(data, "user_id string, ts long, item_id string, rating long")
    return number_rows(df, ["user_id"], ["ts"], at_most=100).drop("ts")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(f"u{u}", f"name {u}", f"KEY{u}") for u in range(8)], "user_id string, user_name string, user_key string")


def guesses(number):
    """A model that answers the item ``number`` first, and that many stars."""

    def load():
        return lambda texts, n: [[str(number)] + [f"x{i}" for i in range(n - 1)] for _ in texts]

    return load


def test_evaluation_from_prompts_to_reports(spark, hist, users, tmp_path):
    tasks = {"RATING_prediction": [metric("mae")], tpl.P5_SEQUENTIAL_EVAL: [metric("hit@1"), metric("mrr@5")]}
    texts = pr.whole_prompts(hist, users, [tpl.RATING, tpl.P5_SEQUENTIAL_EVAL], seed=SEED, size=6)
    for _ in range(2):  # a repeated run replaces itself
        run = runs.evaluate_run(texts, guesses(3), tasks, str(tmp_path), "first", n=5)
    last = {r.user_id: r for r in hist.filter("pos = n - 1").collect()}
    truths = [r.rating for r in last.values()]
    low, high = min(truths), max(truths)
    mae = sum(abs(min(max(3, low), high) - t) for t in truths) / len(truths)
    hit = sum(r.item_id == "3" for r in last.values()) / len(last)
    known = {tpl.find_task(t): ms for t, ms in tasks.items()}
    got = {(r.task, r["Template ID"], r.metric): r.value for r in runs.read_reports(spark, run.reports, known).collect()}
    assert len(got) == 7 * 1 + 4 * 2
    assert all(v == pytest.approx(mae if m == "MAE" else hit, abs=1e-9) for (_, _, m), v in got.items())
    assert {k for k in got if k[1] in ("mean", "best")} == {(t, label, str(m)) for t, ms in known.items() for m in ms for label in ("mean", "best")}
    assert spark.read.parquet(f"{tmp_path}/history").count() == run.metrics.count() == 5 + 2 * 2
    sizes = run.predictions.groupBy("task").agg(F.min(F.size("preds")).alias("n")).collect()
    assert {r.task: r.n for r in sizes} == {tpl.RATING: 1, tpl.P5_SEQUENTIAL_EVAL: 5} and run.rejects.count() == 0


def test_prompts_without_truth_fail_or_are_counted(hist, users, tmp_path):
    texts = pr.whole_prompts(hist, users, [tpl.P5_SEQUENTIAL_EVAL], seed=SEED)
    some = texts.withColumn("ground_truth", F.when(F.col("user_id") > "u2", F.col("ground_truth")))
    tasks = {tpl.P5_SEQUENTIAL_EVAL: [metric("hit@1")]}
    with pytest.raises(Exception, match="ground truth"):
        runs.evaluate_run(some, guesses(3), tasks, str(tmp_path), "first")
    run = runs.evaluate_run(some, guesses(3), tasks, str(tmp_path), "first", strict=False)
    assert {r.template_id: r.n for r in run.rejects.collect()} == {"2-3": 3, "2-13": 3} and run.predictions.count() == 5 * 2


def test_training_rounds(spark, hist, users, tmp_path):
    seen = []

    def fit(epoch, batches):
        seen.append((epoch, batches.count()))
        return batches.groupBy("batch").agg((F.sum("place") / 10 + epoch).alias("loss"))

    options = {"seed": SEED, "epochs": 3, "batch_size": 4, "max_len": 12, "size": 6}
    done = runs.train_run(hist, users, [tpl.RATING], fit, str(tmp_path), "r", load=lambda epoch: guesses({1: 9, 2: 3, 3: 3}[epoch]),
                          monitor=(tpl.RATING, metric("mae")), n=1, **options)
    assert [e for e, _ in seen] == [1, 2, 3] and len({n for _, n in seen}) == 1 and seen[0][1] == 8
    history = {(r.epoch, r.metric): r.value for r in done.history.collect()}
    assert history[1, "train/loss"] == pytest.approx(1 + (6 + 22) / 10 / 2) and history[3, "train/loss"] == pytest.approx(history[1, "train/loss"] + 2)
    before_last = [r.rating for r in hist.filter("pos = n - 2").collect()]
    for epoch, guess in ((1, 9), (2, 3), (3, 3)):
        cut = min(max(guess, min(before_last)), max(before_last))
        assert history[epoch, "val/MAE"] == pytest.approx(sum(abs(cut - t) for t in before_last) / len(before_last))
    assert done.best == 2
    running = rows(done.running.filter("epoch = 1"), "batch", "running_loss")
    assert running == [(0, pytest.approx(1.6)), (1, pytest.approx(2.4))]
    assert spark.read.parquet(f"{tmp_path}/history").count() == 6
    alone = runs.train_run(hist, users, [tpl.RATING], fit, str(tmp_path), "s", **options)
    assert alone.best is None and {r.metric for r in alone.history.collect()} == {"train/loss"}


# tokenizers


def plain_encode(text, limit):
    import re

    return [(w, t) for w, word in enumerate(text.split()) for t in re.findall(r"\w+|[^\w\s]", word)][:limit]


@pytest.mark.parametrize("limit", [1, 2, 5, 100])
def test_encoding_stops_at_the_limit(spark, limit):
    texts = ["", " ", "one", "a-b c,d  e", "x " * 50, "!!! ...", "w1 , w2 ; w3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = tokens.Tokenizer().encode(F.col("t"))
    for tok in (tokens.Tokenizer(), tokens.Tokenizer(word_has_token=False)):
        got = df.select("t", tok.encode(F.col("t"), limit).alias("e"), F.slice(whole, 1, limit).alias("w")).collect()
        assert all(r.e == r.w and [x.word for x in r.e] == [w for w, _ in plain_encode(r.t, limit)] for r in got)


def test_words_without_tokens(spark):
    """Only every 40th word has a token, so the first words are not enough."""
    tok = tokens.Tokenizer(pieces=lambda w: F.when(w.startswith("k"), F.array(w)).otherwise(F.array().cast("array<string>")), word_has_token=False)
    text = " ".join("k" if i % 40 == 39 else "x" for i in range(400))
    got = spark.createDataFrame([(text,)], "t string").select(tok.encode(F.col("t"), 4).alias("e")).first().e
    assert [x.word for x in got] == [39, 79, 119, 159]


def test_batch_tokenizer(spark):
    calls = []

    def load():
        def encode(texts, limit):
            return [[(100 + len(w), i) for i, w in enumerate(t.split())] for t in texts]

        calls.append(1)
        return encode

    tok = tokens.BatchTokenizer(load)
    texts = [f"a bb {'ccc ' * i}".strip() for i in range(30)]
    df = spark.createDataFrame([(t, "dd e") for t in texts], "input_text string, target_text string").coalesce(1)
    got = tokens.encoder_rows(df, 4, tok).select("input_ids", "whole_word_ids", "labels").collect()
    assert got[0].input_ids == [101, 102, 1] and got[5].input_ids == [101, 102, 103, 1] and got[5].whole_word_ids == [1, 2, 3, 0]
    assert all(r.labels == [102, 101, 1] for r in got)
    both = tokens.decoder_rows(df, 9, tok).select("total_ids").collect()
    assert all(len(r.total_ids) <= 9 for r in both)
