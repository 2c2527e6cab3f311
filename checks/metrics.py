"""Metrics, summaries, running values, predictors and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import draws
from basketry.operators import errors, ranking, splits, summary
from basketry.operators.metricspec import metric, safe_div
from basketry.operators.numbering import dense_index
from basketry.operators.predict import popularity_topn as popular_items
from basketry.operators.predict import predict_topn, top_answers
from basketry.operators.tokens import batch_no
from basketry.plans import evaluation as ev
from basketry.plans import prompts as pr
from basketry.plans import runs
from basketry.plans import templates as tpl
from basketry.sources import layout, retail
from basketry.storage import fresh_path, pin
from basketry.streaming import running
from checks.base import (
    HISTORY,
    SEED,
    draw_sql,
    followed,
    history,
    next_item_ctes,
    query,
    rounded,
    with_ctes,
)
from checks.prompts import PIECE, base, whole

VARIANTS = ("a", "b", "c")
GROUP = ["task", "template_id"]
USER = [*GROUP, "user_id"]


# ---- predictions with a known hit pattern -----------------------------------


def scored_predictions(spark, folder):
    """Next-item answers of three variants; each puts the truth at a drawn place.

    Truths are the target and the last input item.  Places 10..13 leave the truth out.
    """
    rows = ev.next_item_predictions(followed(spark, folder)).withColumn(
        "template_id", F.explode(F.array(*[F.lit(v) for v in VARIANTS]))
    )
    place = draws.pick(14, SEED, F.col("template_id"), F.col("user_id"), "place").cast("int")
    preds = F.col("preds")
    moved = F.concat(F.slice(preds, F.lit(1), F.col("place")), "truths", F.slice(preds, F.col("place") + 1, F.lit(10)))
    out = rows.withColumn("place", place).select(
        F.lit("next_item").alias("task"),
        "template_id",
        "user_id",
        F.slice(moved, 1, 10).alias("preds"),
        F.array_append("truths", F.col("last_item")).alias("truths"),
    )
    return pin(out, "scored")


SCORED = [
    *next_item_ctes(),
    f"""moved AS (
  SELECT user_id, template_id, answer, truth, item_id AS last_item,
    CASE WHEN rank <= place THEN rank ELSE rank + 1 END AS rank FROM (
    SELECT r.*, l.truth, l.item_id, t.template_id,
      {draw_sql(SEED, "t.template_id", "r.user_id", "'place'")} % 14 AS place
    FROM ranked r JOIN last_bought l USING (user_id), (VALUES ('a'), ('b'), ('c')) t(template_id))
  UNION ALL
  SELECT user_id, template_id, truth, truth, item_id,
    {draw_sql(SEED, "t.template_id", "user_id", "'place'")} % 14 + 1
  FROM last_bought, (VALUES ('a'), ('b'), ('c')) t(template_id))""",
    """answers AS (
  SELECT 'next_item' AS task, template_id, user_id, rank, answer, answer IN (truth, last_item) AS relevant
  FROM moved WHERE rank <= 10)""",
    """hits AS (
  SELECT *, row_number() OVER (PARTITION BY template_id, user_id ORDER BY rank) AS hit_no
  FROM answers WHERE relevant)""",
    """lists AS (
  SELECT 'next_item' AS task, template_id, user_id, truth, item_id AS last_item
  FROM last_bought, (VALUES ('a'), ('b'), ('c')) t(template_id))""",
]


def per_row_sql(k: int) -> str:
    return f"""rows{k} AS (
  SELECT l.task, l.template_id, l.user_id,
    CASE WHEN count(h.rank) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit,
    CASE WHEN count(h.rank) > 0 THEN sum(hit_no::DOUBLE / h.rank) / count(h.rank) ELSE 0 END AS ap,
    coalesce(1.0::DOUBLE / min(h.rank), 0) AS rr,
    CASE WHEN count(h.rank) > 0 THEN sum(1.0 / log2(h.rank + 1)) / sum(1.0 / log2(hit_no + 1)) ELSE 0 END AS ndcg
  FROM lists l LEFT JOIN hits h ON h.template_id = l.template_id AND h.user_id = l.user_id AND h.rank <= {k}
  GROUP BY l.task, l.template_id, l.user_id)"""


def group_sql(k: int, suffix: str) -> str:
    return f"""group{k} AS (
  SELECT task, template_id, count(*) AS n_rows, avg(hit) AS "Hit{suffix}", avg(ap) AS "MAP{suffix}",
    avg(rr) AS "MRR{suffix}", avg(ndcg) AS "NDCG{suffix}" FROM rows{k} GROUP BY task, template_id)"""


AT_K = [f"{m}@{k}" for k in (1, 5, 10) for m in ("Hit", "MAP", "MRR", "NDCG")]
AT_ALL = ["Hit", "MAP", "MRR", "NDCG"]


@query(
    rounded(
        with_ctes(
            *SCORED,
            *[per_row_sql(k) for k in (1, 5, 10)],
            *[group_sql(k, f"@{k}") for k in (1, 5, 10)],
            "SELECT * FROM group1 JOIN group5 USING (task, template_id, n_rows) JOIN group10 USING (task, template_id, n_rows)",
        ),
        AT_K,
    )
)
def rank_metrics_at_k(spark, folder):
    out = ranking.ranking_metrics(scored_predictions(spark, folder), [metric(m) for m in AT_K], GROUP)
    return rounded(out)


@query(
    rounded(with_ctes(*SCORED, per_row_sql(10), group_sql(10, ""), "SELECT * FROM group10"), AT_ALL)
)
def rank_metrics_no_k(spark, folder):
    out = ranking.ranking_metrics(scored_predictions(spark, folder), [metric(m) for m in AT_ALL], GROUP)
    return rounded(out)


@query(with_ctes(*SCORED, "SELECT template_id, user_id, rank, answer AS pred, relevant FROM answers"))
def relevance_matrix(spark, folder):
    ranked = ranking.ranked_rows(scored_predictions(spark, folder), USER)
    return ranked.select("template_id", "user_id", "rank", "pred", "relevant")


@query(
    with_ctes(
        *SCORED,
        "SELECT template_id, user_id, bool_or(relevant) AS overlap FROM answers GROUP BY template_id, user_id",
    )
)
def relevance_overlap(spark, folder):
    overlap = ranking.overlaps(F.col("preds"), F.col("truths"))
    return scored_predictions(spark, folder).select("template_id", "user_id", overlap.alias("overlap"))


@query(
    rounded(
        with_ctes(
            *SCORED,
            """SELECT template_id, user_id, rank, sum(relevant::INT) OVER w::BIGINT AS hits,
          sum(relevant::INT) OVER w / rank::DOUBLE AS precision FROM answers
        WINDOW w AS (PARTITION BY template_id, user_id ORDER BY rank)""",
        ),
        ["precision"],
    )
)
def running_precision(spark, folder):
    ranked = ranking.ranked_rows(scored_predictions(spark, folder), USER)
    out = ranking.running_precision(ranked, USER)
    return rounded(out.select("template_id", "user_id", "rank", "hits", "precision"))


@query(
    with_ctes(
        *SCORED,
        """SELECT template_id, user_id, min(rank) FILTER (relevant) AS first_hit FROM answers
        GROUP BY template_id, user_id""",
    )
)
def first_hit_rank(spark, folder):
    rel = ranking.relevance(F.col("preds"), F.col("truths"))
    return scored_predictions(spark, folder).select(
        "template_id", "user_id", ranking.first_hit_rank(rel).cast("bigint").alias("first_hit")
    )


@query(
    with_ctes(
        *SCORED,
        """SELECT template_id, user_id, string_agg(relevant::INT::VARCHAR, '' ORDER BY relevant DESC) AS ideal
        FROM answers GROUP BY template_id, user_id""",
    )
)
def ideal_ranking(spark, folder):
    rel = ranking.relevance(F.col("preds"), F.col("truths"))
    digits = ranking.ideal_order(rel).cast("array<int>").cast("array<string>")
    return scored_predictions(spark, folder).select(
        "template_id", "user_id", F.array_join(digits, "").alias("ideal")
    )


# ---- options beyond the defaults --------------------------------------------


@query(
    rounded(
        with_ctes(
            *SCORED,
            """firsts AS (SELECT *, row_number() OVER (PARTITION BY template_id, user_id ORDER BY rank) AS new_no
          FROM (SELECT * FROM answers WHERE relevant
            QUALIFY row_number() OVER (PARTITION BY template_id, user_id, answer ORDER BY rank) = 1))""",
            """SELECT l.template_id, avg(coalesce(v, 0)) AS "MAP" FROM lists l LEFT JOIN (
            SELECT template_id, user_id, sum(new_no::DOUBLE / rank) / 2 AS v FROM firsts GROUP BY 1, 2) f
            USING (template_id, user_id) GROUP BY l.template_id""",
        ),
        ["MAP"],
    )
)
def map_by_truths(spark, folder):
    """MAP over the number of truths, repeated predictions counted once."""
    from dataclasses import replace

    from basketry.operators.metricspec import average_precision

    by_truth = replace(metric("map"), per_row=average_precision("truth"))
    out = ranking.ranking_metrics(
        scored_predictions(spark, folder), [by_truth], ["template_id"], dedupe=True
    )
    return rounded(out.drop("n_rows"))


# ---- rating answers ---------------------------------------------------------


def rating_answers(spark, folder):
    """Test-target ratings with shifted, unparsable and out-of-range answers."""
    last = splits.split_rows(history(spark, folder), "test").filter(F.col("part") == "target")
    rows = last.withColumn("template_id", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))
    user = F.col("user_id").cast("bigint")
    shift = (draws.pick(5, SEED, F.col("template_id"), F.col("user_id"), "shift") - 2) * 0.5
    answer = (
        F.when(user % 17 == 0, "not a number")
        .when(user % 19 == 0, "100")
        .when(user % 23 == 0, "nan")
        .when(user % 29 == 0, "4d")
        .otherwise((F.col("rating") + shift).cast("string"))
    )
    out = rows.select(
        F.lit("rating").alias("task"),
        "template_id",
        "user_id",
        F.array(answer).alias("preds"),
        F.array(F.col("rating").cast("string")).alias("truths"),
    )
    return pin(out, "rated")


SHIFT = draw_sql(SEED, "template_id", "user_id", "'shift'")
RATED = [
    HISTORY,
    f"""given AS (
  SELECT 'rating' AS task, template_id, user_id, rating::DOUBLE AS truth,
    CASE WHEN u % 17 = 0 THEN NULL WHEN u % 19 = 0 THEN 100 WHEN u % 23 = 0 THEN NULL
      WHEN u % 29 = 0 THEN NULL ELSE rating + ({SHIFT} % 5 - 2) * 0.5 END::DOUBLE AS pred
  FROM (SELECT *, CAST(user_id AS BIGINT) AS u FROM hist WHERE n >= 2 AND pos = n - 1),
    (VALUES ('a'), ('b'), ('c')) t(template_id))""",
    """bounds AS (
  SELECT template_id, min(truth) AS low, max(truth) AS high FROM given WHERE pred IS NOT NULL GROUP BY template_id)""",
    """diffs AS (
  SELECT task, template_id, user_id, least(greatest(pred, low), high) AS clipped,
    least(greatest(pred, low), high) - truth AS diff
  FROM given JOIN bounds USING (template_id) WHERE pred IS NOT NULL)""",
]


@query(
    rounded(
        with_ctes(
            *RATED,
            """SELECT task, template_id, n_total, n_ignored, "RMSE", "MAE" FROM
        (SELECT task, template_id, count(*) AS n_total, count(*) FILTER (pred IS NULL) AS n_ignored
          FROM given GROUP BY 1, 2) JOIN
        (SELECT template_id, sqrt(avg(diff * diff)) AS "RMSE", avg(abs(diff)) AS "MAE" FROM diffs GROUP BY 1)
        USING (template_id)""",
        ),
        ["RMSE", "MAE"],
    )
)
def error_metrics(spark, folder):
    out = errors.error_metrics(rating_answers(spark, folder), [metric("rmse"), metric("mae")], GROUP)
    return rounded(out)


@query(
    with_ctes(
        *RATED,
        "SELECT template_id, count(*) FILTER (pred IS NULL) AS n_ignored FROM given GROUP BY template_id",
    )
)
def invalid_prediction_count(spark, folder):
    pairs = errors.answer_pairs(rating_answers(spark, folder), ["template_id"])
    return errors.answer_bounds(pairs, ["template_id"]).select("template_id", "n_ignored")


@query(with_ctes(*RATED, "SELECT template_id, user_id, clipped, diff FROM diffs"))
def rating_diffs(spark, folder):
    keys = [*GROUP, "user_id"]
    pairs = errors.answer_pairs(rating_answers(spark, folder), keys)
    bounds = errors.pinned_bounds(pairs, GROUP)
    return errors.rating_diffs(pairs, bounds, GROUP).select("template_id", "user_id", "clipped", "diff")


@query(
    rounded(
        """SELECT l_orderkey AS order_no, l_linenumber::BIGINT AS line_no, l_partkey AS part_no, l_suppkey AS supplier,
      CASE WHEN l_tax <> 0 THEN l_discount / l_tax ELSE 0 END AS ratio, 1.0 / log2(l_quantity + 1) AS discount,
      abs(l_discount - l_tax) AS gap FROM lineitem""",
        ["ratio", "discount", "gap"],
    )
)
def ndcg_discounts(spark, folder):
    lines = retail.table(spark, folder, "lineitem")
    return rounded(
        lines.select(
            F.col("l_orderkey").alias("order_no"),
            F.col("l_linenumber").cast("bigint").alias("line_no"),
            F.col("l_partkey").alias("part_no"),
            F.col("l_suppkey").alias("supplier"),
            safe_div(F.col("l_discount"), F.col("l_tax")).alias("ratio"),
            (F.lit(1.0) / F.log2(F.col("l_quantity") + 1)).alias("discount"),
            F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        )
    )


# ---- losses -----------------------------------------------------------------


def batch_losses(spark, folder):
    """Batches of 16 orders in key order; the loss of a batch is its mean price / 100,000."""
    orders = retail.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    epoch = F.expr("o_orderkey div 16 % 5 + 1")
    rows = batch_no(orders, "o_orderkey", 80).withColumn("epoch", epoch)
    return rows.groupBy("epoch", "batch").agg((F.avg("o_totalprice") / 100_000).alias("loss"))


LOSSES = """losses AS (
  SELECT o_orderkey // 16 % 5 + 1 AS epoch, o_orderkey // 80 AS batch, avg(o_totalprice) / 100000 AS loss
  FROM orders GROUP BY 1, 2)"""


@query(
    rounded(with_ctes(LOSSES, """SELECT epoch, avg(loss) AS "Loss" FROM losses GROUP BY epoch"""), ["Loss"])
)
def batch_loss(spark, folder):
    return rounded(summary.batch_mean(batch_losses(spark, folder), ["epoch"]))


@query(
    rounded(
        with_ctes(
            LOSSES,
            "SELECT epoch, batch, avg(loss) OVER (PARTITION BY epoch ORDER BY batch) AS running_loss FROM losses",
        ),
        ["running_loss"],
    )
)
def running_loss(spark, folder):
    out = summary.running_mean(batch_losses(spark, folder), ["epoch"], "batch", "loss", "running_loss")
    return rounded(out.drop("loss"))


@query(
    rounded(
        """WITH e AS (SELECT o_orderpriority AS task, year(o_orderdate)::BIGINT AS epoch,
      floor(avg(o_totalprice) / 10000)::DOUBLE AS value FROM orders GROUP BY 1, 2)
    SELECT task, epoch AS best_epoch, value FROM e
    QUALIFY row_number() OVER (PARTITION BY task ORDER BY value, epoch) = 1""",
        ["value"],
    )
)
def best_epoch(spark, folder):
    """Years stand for epochs; the coarse values give ties."""
    orders = retail.table(spark, folder, "orders")
    epochs = orders.groupBy(
        F.col("o_orderpriority").alias("task"), F.year("o_orderdate").cast("bigint").alias("epoch")
    ).agg(F.floor(F.avg("o_totalprice") / 10_000).cast("double").alias("value"))
    return rounded(summary.best_epoch(epochs, False, ["task"]))


# ---- summaries and sinks ----------------------------------------------------

SUITE = {"next_item": ["Hit@5", "NDCG@10"], "rating": ["RMSE", "MAE"]}
NAMES = [m for names in SUITE.values() for m in names]


def suite_metrics(spark, folder):
    """Long metric rows of two tasks with three templates each."""
    predictions = scored_predictions(spark, folder).unionByName(rating_answers(spark, folder))
    out = ev.evaluate(
        predictions,
        {task: [metric(m) for m in names] for task, names in SUITE.items()},
        {"next_item": "ranking", "rating": "error"},
    )
    number = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("template_id")) - 1
    return pin(out.withColumn("template_no", number), "suite")


SUITE_CTES = [
    *SCORED,
    per_row_sql(5),
    per_row_sql(10),
    *RATED[1:],
    """suite AS (
  SELECT task, template_id, 'Hit@5' AS metric, avg(hit) AS value FROM rows5 GROUP BY 1, 2
  UNION ALL SELECT task, template_id, 'NDCG@10', avg(ndcg) FROM rows10 GROUP BY 1, 2
  UNION ALL SELECT task, template_id, 'RMSE', sqrt(avg(diff * diff)) FROM diffs GROUP BY 1, 2
  UNION ALL SELECT task, template_id, 'MAE', avg(abs(diff)) FROM diffs GROUP BY 1, 2)""",
]


@query(rounded(with_ctes(*SUITE_CTES, "SELECT * FROM suite"), ["value"]))
def evaluation_suite(spark, folder):
    return rounded(suite_metrics(spark, folder).drop("template_no"))


SUMMARY = """SELECT task, metric, avg(value) AS mean,
  CASE WHEN metric IN ('RMSE', 'MAE') THEN min(value) ELSE max(value) END AS best FROM suite GROUP BY task, metric"""


@query(rounded(with_ctes(*SUITE_CTES, SUMMARY), ["mean", "best"]))
def template_summary(spark, folder):
    return rounded(summary.template_summary(suite_metrics(spark, folder), NAMES))


BEST = """best AS (
  SELECT task, metric, template_id, value FROM suite QUALIFY row_number() OVER (PARTITION BY task, metric
    ORDER BY CASE WHEN metric IN ('RMSE', 'MAE') THEN value ELSE -value END, template_id) = 1)"""


@query(rounded(with_ctes(*SUITE_CTES, BEST, "SELECT * FROM best"), ["value"]))
def best_template(spark, folder):
    return rounded(summary.best_template(suite_metrics(spark, folder), NAMES))


REPORT = [
    *SUITE_CTES,
    BEST,
    f"summary AS ({SUMMARY})",
    """report AS (
  SELECT task, template_id AS label, metric, value, ascii(template_id) - 97 AS row_no FROM suite
  UNION ALL SELECT task, 'mean', metric, mean, 2147483648 FROM summary
  UNION ALL SELECT task, 'best', metric, best, 2147483649 FROM summary)""",
]
CELLS = " || ' & ' || ".join(f"""coalesce(max(cell) FILTER (metric = '{m}'), '-')""" for m in NAMES)


@query(
    with_ctes(
        *REPORT,
        f"""SELECT task, row_no::BIGINT AS row_no, label || ' & ' || {CELLS} || ' \\\\' AS line FROM (
          SELECT r.*, CASE WHEN b.task IS NULL THEN printf('%.4f', r.value)
            ELSE '\\textbf{{' || printf('%.4f', r.value) || '}}' END AS cell
          FROM report r LEFT JOIN best b ON r.task = b.task AND r.metric = b.metric AND r.label = b.template_id)
        GROUP BY task, row_no, label""",
    )
)
def report_rows(spark, folder):
    return summary.report_rows(suite_metrics(spark, folder), NAMES)


@query(
    rounded(
        with_ctes(*REPORT, """SELECT task, label AS "Template ID", metric, value FROM report"""),
        ["value"],
    )
)
def metrics_csv(spark, folder):
    """One CSV report per task, read back."""
    scores, target = pin(suite_metrics(spark, folder), "scores"), fresh_path(spark, "reports")
    out = None
    for task, names in SUITE.items():
        report = summary.report_wide(scores.filter(F.col("task") == task), names).drop("task")
        path = layout.write_report(report, target, task)
        schema = "`Template ID` string, " + ", ".join(f"`{n}` double" for n in names)
        back = spark.read.schema(schema).option("header", True).csv(path)
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])
        long = back.select(F.lit(task).alias("task"), "`Template ID`", F.inline(cells))
        out = long if out is None else out.unionByName(long)
    return rounded(out)


@query(
    rounded(
        with_ctes(
            *SUITE_CTES,
            """SELECT 'first' AS exp_name, task, metric, template_id, value FROM suite
        UNION ALL SELECT 'second', task, metric, template_id, value FROM suite WHERE task = 'rating'""",
        ),
        ["value"],
    )
)
def metric_history(spark, folder):
    """Two runs in the history table, one of them written twice, read back."""
    rows = suite_metrics(spark, folder).drop("template_no")
    path = fresh_path(spark, "metric-history")
    layout.append_history(rows, path, "first")
    layout.append_history(rows, path, "first")
    layout.append_history(rows.filter(F.col("task") == "rating"), path, "second")
    return rounded(spark.read.parquet(path))


# ---- running values ---------------------------------------------------------


@query(
    rounded(
        with_ctes(
            *SCORED,
            per_row_sql(10),
            """placed AS (
          SELECT *, (row_number() OVER (PARTITION BY template_id ORDER BY user_id) - 1) // 16 AS batch,
            (count(*) OVER (PARTITION BY template_id) + 15) // 16 AS batches FROM rows10)""",
            """parts AS (
          SELECT template_id, greatest((200 * (batch + 1) + batches) // (2 * batches), 1)::BIGINT AS percent,
            count(*) AS n, sum(hit) AS hit, sum(rr) AS rr FROM placed GROUP BY 1, 2)""",
            """SELECT template_id, percent, sum(n) OVER w::BIGINT AS n_rows,
          sum(hit) OVER w / sum(n) OVER w AS "Hit@10", sum(rr) OVER w / sum(n) OVER w AS "MRR@10"
        FROM parts WINDOW w AS (PARTITION BY template_id ORDER BY percent)""",
        ),
        ["Hit@10", "MRR@10"],
    )
)
def running_metrics(spark, folder):
    """Metrics so far at every percent of the batches of 16 users."""
    rows = scored_predictions(spark, folder)
    users = dense_index(rows.select("user_id").distinct(), ["user_id"], "user_idx")
    batches = (users.count() + 15) // 16
    wanted = [metric("hit@10"), metric("mrr@10")]
    scored = ranking.with_hit_ranks(rows, wanted).select(
        "template_id", "user_id", *ranking.row_values(wanted)
    )
    placed = batch_no(scored.join(users, "user_id"), "user_idx", 16)
    seen = placed.withColumn("percent", summary.progress_point(F.col("batch"), F.lit(batches)))
    return rounded(summary.running_metrics(seen, ["template_id"], [str(m) for m in wanted]))


@query(
    rounded(
        with_ctes(*SCORED, per_row_sql(10), group_sql(10, "@10"), "SELECT * FROM group10"),
        ["Hit@10", "MAP@10", "MRR@10", "NDCG@10"],
    )
)
def stream_running_metrics(spark, folder):
    """Prediction files consumed by a stream; the last update equals the batch result."""
    rows = scored_predictions(spark, folder).repartition(6)
    source, out, state = (fresh_path(spark, f"stream-{p}") for p in ("in", "out", "state"))
    rows.write.parquet(source)
    stream = running.prediction_stream(spark, source, rows.schema, files_per_trigger=3)
    running.run_metrics(stream, [metric(f"{m}@10") for m in AT_ALL], GROUP, out, state)
    return rounded(running.latest(spark, out))


@query(
    rounded(
        with_ctes(
            *RATED[:2],
            """placed AS (SELECT *, greatest((200 * batch + 200 + batches) // (2 * batches), 1)::BIGINT AS percent FROM (
          SELECT *, (dense_rank() OVER (ORDER BY user_id) - 1) // 16 AS batch,
            ((SELECT count(DISTINCT user_id) FROM given) + 15) // 16 AS batches FROM given))""",
            """points AS (SELECT DISTINCT task, template_id, percent FROM placed)""",
            """so_far AS (SELECT p.task, p.template_id, p.percent, g.pred, g.truth,
            min(CASE WHEN g.pred IS NOT NULL THEN g.truth END) OVER w AS low,
            max(CASE WHEN g.pred IS NOT NULL THEN g.truth END) OVER w AS high
          FROM points p JOIN placed g ON g.template_id = p.template_id AND g.percent <= p.percent
          WINDOW w AS (PARTITION BY p.template_id, p.percent))""",
            """SELECT task, template_id, percent, count(*) AS n_total, count(*) FILTER (pred IS NULL) AS n_ignored,
          sqrt(avg(power(least(greatest(pred, low), high) - truth, 2)) FILTER (pred IS NOT NULL)) AS "RMSE",
          avg(abs(least(greatest(pred, low), high) - truth)) FILTER (pred IS NOT NULL) AS "MAE"
        FROM so_far GROUP BY 1, 2, 3""",
        ),
        ["RMSE", "MAE"],
    )
)
def running_error_metrics(spark, folder):
    """RMSE and MAE so far at every percent of the batches of 16 users."""
    rows = rating_answers(spark, folder)
    users = dense_index(rows.select("user_id").distinct(), ["user_id"], "user_idx")
    batches = (users.count() + 15) // 16
    placed = batch_no(rows.join(users, "user_id"), "user_idx", 16)
    seen = placed.withColumn("percent", summary.progress_point(F.col("batch"), F.lit(batches)))
    return rounded(errors.running_error_metrics(seen, GROUP))


@query(
    rounded(
        with_ctes(
            *RATED,
            """SELECT task, template_id, n_total, n_ignored, "RMSE", "MAE" FROM
        (SELECT task, template_id, count(*) AS n_total, count(*) FILTER (pred IS NULL) AS n_ignored
          FROM given GROUP BY 1, 2) JOIN
        (SELECT template_id, sqrt(avg(diff * diff)) AS "RMSE", avg(abs(diff)) AS "MAE" FROM diffs GROUP BY 1)
        USING (template_id)""",
        ),
        ["RMSE", "MAE"],
    )
)
def stream_running_errors(spark, folder):
    """Rating answers consumed by a stream; the last update equals the batch result.

    The truths are whole stars from 1 to 5, so the state is a few sums per zone of that scale.
    """
    rows = rating_answers(spark, folder).repartition(6)
    source, out, state = (fresh_path(spark, f"stream-{p}") for p in ("in", "out", "state"))
    rows.write.parquet(source)
    stream = running.prediction_stream(spark, source, rows.schema, files_per_trigger=3)
    running.run_errors(stream, GROUP, out, state, scale=(1, 5, 1))
    return rounded(running.latest(spark, out))


# ---- predictors -------------------------------------------------------------


@query(
    with_ctes(
        HISTORY,
        """SELECT item_id, count(*) AS n_bought, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank
        FROM hist GROUP BY item_id QUALIFY rank <= 20""",
    )
)
def popularity_topn(spark, folder):
    return popular_items(retail.purchases(spark, folder), 20)


@query(
    with_ctes(
        *base(False),
        """SELECT user_id, template_id, array_to_string(list_resize(list_slice(list_reverse(items), 1, 10), 10, 'none'), ' ') AS preds,
          target_item AS truth FROM packed, (VALUES ('2-3'), ('2-13')) t(template_id)""",
    )
)
def predict_topn_pandas(spark, folder):
    prompts = pr.check_evaluable(whole(spark, folder, [tpl.P5_SEQUENTIAL_EVAL]))

    def load():
        import re

        def answer(texts, n):
            out = []
            for t in texts:
                history = re.search("^With (.*) on the account,|: (.*); the shop", t)
                items = re.split(" , | -> ", history[1] or history[2])[::-1][:n]
                out.append(items + ["none"] * (n - len(items)))
            return out

        return answer

    out = predict_topn(prompts, load, 10)
    return out.select(
        "user_id", "template_id", F.array_join("preds", " ").alias("preds"), F.get("ground_truth", F.lit(0)).alias("truth")
    )


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, item_id, rank FROM (
          SELECT user_id, item_id, CAST(user_id AS BIGINT) % 2 = 0 AS ranking,
            row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, pos) AS rank FROM hist)
        WHERE rank <= CASE WHEN ranking THEN 10 ELSE 1 END""",
    )
)
def answers_per_prompt(spark, folder):
    """Ten answers for even users (ranking), one for odd users (rating)."""
    rows = history(spark, folder).select(
        "user_id",
        "item_id",
        F.col("rating").alias("score"),
        F.col("pos").alias("answer_no"),
        (F.col("user_id").cast("bigint") % 2 == 0).alias("is_ranking"),
    )
    return top_answers(rows, ["user_id"], "score", 10).select("user_id", "item_id", "rank")


# ---- whole runs ---------------------------------------------------------------


def text_answers():
    """A predictor that reads the prompt: the average of a rating prompt, the last items of a sequence."""
    import re

    def answer(texts, n):
        out = []
        for t in texts:
            average = re.search(r"[0-9]\.[0-9][0-9]", t)
            history = re.search("^With (.*) on the account,|: (.*); the shop", t)
            items = [average[0]] if average else re.split(" , | -> ", history[1] or history[2])[::-1][:n]
            out.append(items + ["none"] * (n - len(items)))
        return out

    return answer


RUN_TASKS = {tpl.RATING: ["RMSE", "MAE"], tpl.P5_SEQUENTIAL_EVAL: ["Hit@5", "NDCG@10"]}


@query(
    rounded(
        with_ctes(
            *base(False),
            """guesses AS (
          SELECT target_rating AS truth, CAST(printf('%.2f', CAST(list_sum(ratings) AS DOUBLE) / len(ratings)) AS DOUBLE) AS pred FROM packed)""",
            """cut AS (
          SELECT least(greatest(pred, (SELECT min(truth) FROM guesses)), (SELECT max(truth) FROM guesses)) - truth AS diff FROM guesses)""",
            """places AS (SELECT list_position(list_slice(list_reverse(items), 1, 10), target_item) AS first,
            list_filter(list_transform(list_slice(list_reverse(items), 1, 10), lambda x, i: CASE WHEN x = target_item THEN i END),
              lambda x: x IS NOT NULL) AS hits FROM packed)""",
            """scores AS (
          SELECT 'rating_prediction' AS task, unnest(['0', '1', '2', '3', '4']) AS id, 'RMSE' AS metric, sqrt(avg(diff * diff)) AS value FROM cut GROUP BY 2
          UNION ALL SELECT 'rating_prediction', unnest(['0', '1', '2', '3', '4']), 'MAE', avg(abs(diff)) FROM cut GROUP BY 2
          UNION ALL SELECT 'p5_sequential_eval', unnest(['2-3', '2-13']), 'Hit@5', avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END) FROM places GROUP BY 2
          UNION ALL SELECT 'p5_sequential_eval', unnest(['2-3', '2-13']), 'NDCG@10', avg(CASE WHEN len(hits) = 0 THEN 0.0 ELSE
            list_sum(list_transform(hits, lambda r: 1 / log2(r + 1))) / list_sum(list_transform(range(1, len(hits) + 1), lambda r: 1 / log2(r + 1))) END)
          FROM places GROUP BY 2)""",
            """SELECT task, id AS "Template ID", metric, value FROM scores
          UNION ALL SELECT task, 'mean', metric, avg(value) FROM scores GROUP BY task, metric
          UNION ALL SELECT task, 'best', metric, CASE WHEN metric IN ('RMSE', 'MAE') THEN min(value) ELSE max(value) END FROM scores GROUP BY task, metric""",
        ),
        ["value"],
    )
)
def evaluation_run(spark, folder):
    """Prompts of two tasks to answers, metrics, CSV reports and history; the reports read back."""
    wanted = {t: [metric(m) for m in names] for t, names in RUN_TASKS.items()}
    prompts = whole(spark, folder, list(wanted), size=PIECE)
    run = runs.evaluate_run(prompts, text_answers, wanted, fresh_path(spark, "run"), "first")
    return rounded(runs.read_reports(spark, run.reports, wanted))
