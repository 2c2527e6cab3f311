"""Predictors: pluggable Python ones and two that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def item_popularity(interactions: DataFrame) -> DataFrame:
    """Occurrences of each item over all histories."""
    return interactions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_bought"))


def popularity_topn(interactions: DataFrame, n: int) -> DataFrame:
    """The ``n`` most bought items with their rank, item id breaks ties."""
    top = item_popularity(interactions).orderBy(F.desc("n_bought"), "item_id").limit(n)
    ranked = W.partitionBy(F.lit(0)).orderBy(F.desc("n_bought"), "item_id")  # n rows
    return top.withColumn("rank", F.row_number().over(ranked).cast("bigint"))


def transition_counts(pairs: DataFrame) -> DataFrame:
    """How often ``next_item`` followed ``item_id``."""
    return (
        pairs.filter(F.col("next_item").isNotNull())
        .groupBy("item_id", "next_item")
        .agg(F.count(F.lit(1)).alias("n_seen"))
    )


def transition_topn(pairs: DataFrame, n: int) -> DataFrame:
    """Per item its ``n`` most frequent followers as an ordered array.

    The row_number filter is pushed below the shuffle as a per-partition limit, so a
    hot item sends at most n rows per task.
    """
    ranked = W.partitionBy("item_id").orderBy(F.desc("n_seen"), "next_item")
    top = transition_counts(pairs).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)
    packed = F.sort_array(F.collect_list(F.struct("rank", "next_item")))
    return top.groupBy("item_id").agg(packed["next_item"].alias("followers"))


def next_item_topn(pairs: DataFrame, last_items: DataFrame, n: int) -> DataFrame:
    """Top-n next items for each row of ``last_items`` (item_id = the last bought one).

    Followers of the last item first, then the most bought items not among them, so
    every row gets the same number of answers when the catalog allows it.
    """
    packed = F.sort_array(F.collect_list(F.struct("rank", "item_id")))
    popular = popularity_topn(pairs, 2 * n).agg(packed["item_id"].alias("popular"))
    followers = F.coalesce("followers", F.array().cast("array<string>"))
    # a scalar subquery: one array of 2n ids, computed once
    filled = F.concat(followers, F.array_except(popular.scalar(), followers))
    rows = last_items.join(transition_topn(pairs, n), "item_id", "left")
    return rows.withColumn("preds", F.slice(filled, 1, n)).drop("followers")


def top_answers(answers: DataFrame, keys: list[str], score: str, n_ranking: int) -> DataFrame:
    """Keep ``n_ranking`` answers per prompt for ranking tasks and one for rating tasks.

    ``answers`` has a BOOLEAN ``is_ranking`` and an ``answer_no``.
    """
    best = W.partitionBy(*keys).orderBy(F.desc(score), "answer_no")
    wanted = F.when(F.col("is_ranking"), F.lit(n_ranking)).otherwise(F.lit(1))
    return (
        answers.withColumn("rank", F.row_number().over(best).cast("bigint"))
        .filter(F.col("rank") <= n_ranking)
        .filter(F.col("rank") <= wanted)
    )


def predict_topn(
    prompts: DataFrame,
    load: Callable[[], Callable[[list[str], int], list[list[str]]]],
    n: int,
    text_col: str = "input_text",
) -> DataFrame:
    """Run a Python predictor over prompts, adding ``preds`` ARRAY<STRING>.

    ``load()`` runs once per partition and returns ``answer(texts, n)``, which gives
    n answers per text.  Rows arrive in Arrow batches.
    """

    def run(batches: Iterator):
        answer = load()
        for batch in batches:
            texts = batch[text_col].tolist()
            answers = answer(texts, n)
            if len(answers) != len(texts) or any(len(a) != n for a in answers):
                raise ValueError("the predictor must return n answers for every text")
            batch["preds"] = answers
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{fields}, preds array<string>")


def answer_texts(spark, texts: list[str], load, n: int) -> list[list[str]]:
    """Answers for a few texts typed in by hand, in their order."""
    asked = spark.createDataFrame(list(enumerate(texts)), "place long, input_text string")
    return [r.preds for r in predict_topn(asked, load, n).orderBy("place").collect()]
