"""Tokens, batches, summaries, predictors, streaming and sinks."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from basketry.operators import predict, summary, tokens
from basketry.operators.metricspec import metric
from basketry.operators.ranking import ranking_metrics
from basketry.plans import evaluation as ev
from basketry.plans import export
from basketry.sources import layout
from basketry.streaming import running

SUITE = [
    ("t", "0", 0, "Hit@5", 0.2), ("t", "1", 1, "Hit@5", 0.4), ("t", "2", 2, "Hit@5", 0.4),
    ("t", "0", 0, "MAE", 0.9), ("t", "1", 1, "MAE", 0.5), ("t", "2", 2, "MAE", 0.7),
]
NAMES = ["Hit@5", "MAE"]


@pytest.fixture(scope="module")
def suite(spark):
    return spark.createDataFrame(SUITE, "task string, template_id string, template_no long, metric string, value double")


def test_summary_and_ties(suite):
    got = {r.metric: (r.mean, r.best) for r in summary.template_summary(suite, NAMES).collect()}
    assert got["Hit@5"] == (pytest.approx(1 / 3), 0.4) and got["MAE"] == (pytest.approx(0.7), 0.5)
    best = rows(summary.best_template(suite, NAMES), "metric", "template_id")
    assert best == [("Hit@5", "1"), ("MAE", "1")]


def test_report(suite, spark, tmp_path):
    lines = [r.line for r in summary.report_rows(suite, NAMES).orderBy("row_no").collect()]
    assert lines[0] == r"0 & 0.2000 & 0.9000 \\"
    assert lines[1] == r"1 & \textbf{0.4000} & \textbf{0.5000} \\"
    assert lines[3:] == [r"mean & 0.3333 & 0.7000 \\", r"best & 0.4000 & 0.5000 \\"]
    path = layout.write_report(summary.report_wide(suite, NAMES).drop("task"), str(tmp_path), "t")
    text = [r.value for r in spark.read.text(path).collect()]
    assert text[0] == "Template ID,Hit@5,MAE" and text[1] == "0,0.2,0.9" and text[-1].startswith("best,0.4,0.5")


def test_best_epoch_prefers_the_earliest(spark):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.3), ("r", 3, 0.3)], "run string, epoch long, value double")
    assert rows(summary.best_epoch(df, False, ["run"])) == [("r", 2, 0.3)]
    assert rows(summary.best_epoch(df, True, ["run"])) == [("r", 1, 0.5)]


def test_batch_mean_ignores_batch_size(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "batch long, loss double")
    assert summary.batch_mean(df.withColumn("e", F.lit(1)), ["e"]).first()["Loss"] == 3.0


def test_progress_points(spark):
    got = spark.range(7).select(summary.progress_point(F.col("id"), F.lit(7))).collect()
    assert [r[0] for r in got] == [14, 29, 43, 57, 71, 86, 100]


def brute_words(text):
    import re

    return [(i, t) for i, w in enumerate(text.split()) for t in re.findall(r"\w+|[^\w\s]", w)]


def test_encoder_rows(spark):
    df = spark.createDataFrame([("Hello, big  world!", "x-1")], "input_text string, target_text string")
    row = tokens.encoder_rows(df, 64).first()
    words = brute_words("Hello, big  world!")
    assert row.whole_word_ids == [i + 1 for i, _ in words] + [0]
    assert len(row.input_ids) == len(words) + 1 == sum(row.attention_mask) and row.input_ids[-1] == tokens.END_ID
    assert len(row.labels) == 4
    cut = tokens.encoder_rows(df, 3).first()
    assert cut.input_ids == [*row.input_ids[:2], tokens.END_ID] and cut.whole_word_ids == [1, 1, 0]


def test_decoder_keeps_the_target(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(text, "the answer")], "input_text string, target_text string")
    row = tokens.decoder_rows(df, 20).first()
    whole = tokens.decoder_rows(df, 1000).first()
    assert len(row.total_ids) == 20 and row.total_ids[-3:] == whole.total_ids[-3:]
    assert row.total_ids[: len(row.prompt_ids)] == row.prompt_ids
    assert row.total_word_ids[-1] == 0 and len(row.total_word_ids) == 20
    body = row.total_word_ids[:-1]
    assert body[0] == 1 and all(b - a in (0, 1) for a, b in zip(body, body[1:]))


def test_dialog_text(spark):
    row = spark.range(1).select(tokens.dialog_text(F.lit("q")), tokens.dialog_text(F.lit("q"), F.lit("a"))).first()
    assert tuple(row) == ("Input: q \nTarget: ", "Input: q \nTarget: a")


def test_padding(spark):
    df = spark.createDataFrame([(0, [5, 0]), (0, [7]), (1, [9])], "batch long, ids array<int>")
    right = rows(tokens.pad_batches(df, {"ids": 0}))
    left = rows(tokens.pad_batches(df, {"ids": 0}, left=True))
    assert right == [(0, [5, 0]), (0, [7, 0]), (1, [9])] and left == [(0, [0, 7]), (0, [5, 0]), (1, [9])]


@pytest.mark.parametrize("decoder", [False, True])
def test_export(spark, decoder):
    data = [(f"u{u}", e, "t", "inference", "0", "word " * (u + 1), f"i{u}") for e in (1, 2) for u in range(23)]
    names = "user_id string, epoch long, task string, role string, template_id string, input_text string, target_text string"
    prompts = spark.createDataFrame(data, names)
    options = {"seed": 1, "batch_size": 5, "max_len": 16, "decoder": decoder}
    out = export.export_batches(prompts, **options)
    got = out.collect()
    assert rows(out) == rows(export.export_batches(prompts.repartition(3), **options, hot_rows=4))
    column = "total_ids" if decoder else "input_ids"
    orders = {}
    for epoch in (1, 2):
        mine = sorted((r for r in got if r.epoch == epoch), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(23)) and max(r.batch for r in mine) == 4
        for b in range(5):
            lengths = {len(r[column]) for r in mine if r.batch == b}
            assert len(lengths) == 1 and lengths.pop() <= 16
        orders[epoch] = [r.user_id for r in mine]
    assert orders[1] != orders[2]


def test_own_tokenizer(spark):
    tok = tokens.Tokenizer(pieces=lambda w: F.array(w), ids=lambda t: F.length(t))
    row = spark.range(1).select(tok.encode(F.lit("a bcd")).alias("e")).first()
    assert [(x.id, x.word) for x in row.e] == [(1, 0), (3, 1)]


def test_predictor_contract(spark):
    prompts = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "id long, input_text string")

    def load():
        return lambda texts, n: [[f"{t}/{k}" for k in range(n)] for t in texts]

    out = predict.predict_topn(prompts, load, 2)
    assert out.filter("id = 3").first().preds == ["text 3/0", "text 3/1"]
    with pytest.raises(Exception, match="n answers"):
        predict.predict_topn(prompts, lambda: (lambda texts, n: [["x"]] * len(texts)), 2).collect()


def test_next_item_predictor(spark):
    from basketry.operators.numbering import number_rows

    data = [(u, i, x) for u, seq in {"a": "xyzq", "b": "xyq", "c": "zxyz", "d": "ab"}.items() for i, x in enumerate(seq)]
    df = spark.createDataFrame(data, "user_id string, ts long, item_id string")
    hist = number_rows(df, ["user_id"], ["ts"], lead={"next_item": "item_id"}, at_most=20)
    got = {r.user_id: r for r in ev.next_item_predictions(hist, 3).collect()}
    # pairs seen in the inputs: xy 3, yz 1, zx 1; popularity x 3, y 3, z 2, a 1
    assert got["a"].preds == ["x", "y", "z"] and got["a"].truths == ["q"] and got["a"].last_item == "z"
    assert got["b"].preds == ["z", "x", "y"] and got["d"].preds == ["x", "y", "z"]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(
        [("t", str(i % 2), [str(i % 3), str(i % 5)], [str(i % 4)]) for i in range(60)],
        "task string, template_id string, preds array<string>, truths array<string>",
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(4).write.parquet(source)
    wanted, keys = [metric("hit@2"), metric("mrr")], ["task", "template_id"]
    stream = running.prediction_stream(spark, source, df.schema, files_per_trigger=2)
    running.run_metrics(stream, wanted, keys, out, str(tmp_path / "state"))
    want = rows(ranking_metrics(df, wanted, keys))
    got = rows(running.latest(spark, out))
    assert len(list((tmp_path / "out").iterdir())) >= 2
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:])


def test_suite_with_loss(spark):
    preds = spark.createDataFrame(
        [("rank", "0", ["a"], ["a"]), ("rate", "0", ["3"], ["4"]), ("rate", "1", ["x"], ["4"])],
        "task string, template_id string, preds array<string>, truths array<string>",
    )
    losses = spark.createDataFrame([("rank", "0", 1.0), ("rank", "0", 2.0)], "task string, template_id string, loss double")
    tasks = {"rank": [metric("hit"), metric("loss")], "rate": [metric("mae")]}
    families = {"rank": "ranking", "rate": "error"}
    got = rows(ev.evaluate(preds, tasks, families, losses))
    # the only answered rating is clipped to its truth
    assert got == [
        ("rank", "0", "Hit", 1.0), ("rank", "0", "Loss", 1.5), ("rate", "0", "MAE", 0.0), ("rate", "1", "MAE", None),
    ]
    with pytest.raises(ValueError):
        ev.evaluate(preds, {"rank": [metric("mae")]}, families)
    with pytest.raises(ValueError):
        ev.evaluate(preds, {"rank": [metric("loss")]}, families)
