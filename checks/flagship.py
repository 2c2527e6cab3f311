from __future__ import annotations

from checks.base import followed, next_item_ctes, query, rounded, with_ctes
from basketry.plans.evaluation import flagship, next_item_predictions
from pyspark.sql import functions as F


def metric_sql(k: int) -> list[str]:
    """Aggregates over ``hit(user_id, rank)`` joined to all users of ``last_bought``."""
    return [
        f"""per{k} AS (
  SELECT l.user_id,
    count(h.rank) AS hits,
    coalesce(sum(h.hit_no / CAST(h.rank AS DOUBLE)), 0) AS precisions,
    min(h.rank) AS first_rank,
    coalesce(sum(1.0 / log2(h.rank + 1)), 0) AS dcg,
    coalesce(sum(1.0 / log2(h.hit_no + 1)), 0) AS ideal
  FROM last_bought l LEFT JOIN hits h ON h.user_id = l.user_id AND h.rank <= {k}
  GROUP BY l.user_id)""",
    ]


def metric_columns(k: int) -> str:
    return f"""
  (SELECT avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) FROM per{k}) AS "Hit@{k}",
  (SELECT avg(CASE WHEN hits > 0 THEN precisions / hits ELSE 0 END) FROM per{k}) AS "MAP@{k}",
  (SELECT avg(coalesce(1.0 / first_rank, 0)) FROM per{k}) AS "MRR@{k}",
  (SELECT avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END) FROM per{k}) AS "NDCG@{k}\""""


HITS = """hits AS (
  SELECT user_id, rank, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS hit_no
  FROM ranked JOIN last_bought USING (user_id) WHERE answer = truth)"""


@query(
    rounded(
        with_ctes(
            *next_item_ctes(),
            HITS,
            *metric_sql(5),
            *metric_sql(10),
            f"""SELECT 'next_item' AS task, (SELECT count(*) FROM last_bought) AS n_rows,
            {metric_columns(5)}, {metric_columns(10)}""",
        ),
        [f"{m}@{k}" for k in (5, 10) for m in ("Hit", "MAP", "MRR", "NDCG")],
    )
)
def next_item_metrics(spark, folder):
    return rounded(flagship(followed(spark, folder)))


@query(
    with_ctes(
        *next_item_ctes(),
        """SELECT user_id, string_agg(answer, ' ' ORDER BY rank) AS preds, any_value(truth) AS truth
        FROM ranked JOIN last_bought USING (user_id) GROUP BY user_id""",
    )
)
def next_item_topn(spark, folder):
    out = next_item_predictions(followed(spark, folder))
    return out.select("user_id", F.array_join("preds", " ").alias("preds"), F.col("truths")[0].alias("truth"))
