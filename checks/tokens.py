"""Token-array export."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import draws
from basketry.operators import tokens
from basketry.operators.numbering import shuffled_index
from basketry.storage import pin
from checks.base import HISTORY, SEED, draw_sql, history_examples, query, with_ctes

MAX_LEN = 96


def texts(spark, folder):
    """A line per history, its last item as the answer."""
    ex = history_examples(spark, folder, lambda x: F.concat(x["item_id"], F.lit("->"), x["rating"].cast("string")), " , ")
    return ex.select(
        "user_id",
        F.concat(F.lit("What follows? "), "input").alias("input_text"),
        F.concat(F.lit("item "), F.col("target.item_id"), F.lit("!")).alias("target_text"),
    )


TEXTS = """texts AS (
  SELECT user_id, 'What follows? ' || string_agg(item_id || '->' || rating, ' , ' ORDER BY pos)
      FILTER (pos < n - 1) AS input_text,
    'item ' || any_value(item_id) FILTER (pos = n - 1) || '!' AS target_text
  FROM hist WHERE n > 1 GROUP BY user_id)"""


def encode_sql(text: str) -> str:
    """List of {id, word} structs of a text expression."""
    words = f"list_filter(string_split_regex(trim({text}), '\\s+'), lambda w: w <> '')"
    pieces = "regexp_extract_all(w, '\\w+|[^\\w\\s]')"
    return f"""flatten(list_transform({words}, lambda w, i: list_transform({pieces}, lambda t:
      struct_pack(id := CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 32000 + 10, word := i - 1))))"""


def ids_text(col: str) -> str:
    return f"array_to_string(list_transform({col}, lambda z: z.id), ' ')"


@query(
    with_ctes(
        HISTORY,
        TEXTS,
        f"""enc AS (SELECT user_id, list_slice({encode_sql("input_text")}, 1, {MAX_LEN - 1}) AS e,
          {encode_sql("target_text")} AS t FROM texts)""",
        f"""SELECT user_id, {ids_text("e")} || ' 1' AS input_ids, {ids_text("t")} || ' 1' AS labels,
          array_to_string(list_transform(e, lambda x: x.word + 1), ' ') || ' 0' AS whole_word_ids,
          len(e) + 1 AS mask_sum FROM enc""",
    )
)
def whole_word_ids(spark, folder):
    out = tokens.encoder_rows(texts(spark, folder), MAX_LEN)
    return out.select(
        "user_id",
        joined("input_ids"),
        joined("labels"),
        joined("whole_word_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("mask_sum"),
    )


def joined(col: str):
    return F.array_join(F.col(col).cast("array<string>"), " ").alias(col)


BUDGET = [
    HISTORY,
    TEXTS,
    f"""enc AS (SELECT user_id, {encode_sql("'Input: ' || input_text || ' '")} AS full_e,
      {encode_sql("'Target: '")} AS p, {encode_sql("target_text")} AS t FROM texts)""",
    f"""cut AS (SELECT *, list_slice(full_e, 1, {MAX_LEN} - (len(p) + len(t) + 2)) AS e FROM enc)""",
    """offs AS (SELECT *, e[-1].word + 1 AS newline_word, e[-1].word + 2 AS prefix_from,
      e[-1].word + 2 + p[-1].word + 1 AS target_from FROM cut)""",
]


@query(
    with_ctes(
        *BUDGET,
        f"""SELECT user_id, {ids_text("e")} || ' 2 ' || {ids_text("p")} AS prompt_ids,
          {ids_text("e")} || ' 2 ' || {ids_text("p")} || ' ' || {ids_text("t")} || ' 1' AS total_ids,
          array_to_string(list_concat(list_concat(list_transform(e, lambda x: x.word + 1), [newline_word + 1]),
            list_concat(list_transform(p, lambda x: x.word + prefix_from + 1),
              list_transform(t, lambda x: x.word + target_from + 1))), ' ') || ' 0' AS total_word_ids,
          len(e) + 1 + len(p) AS n_prompt, len(e) + 1 + len(p) + len(t) + 1 AS n_total FROM offs""",
    )
)
def token_budget(spark, folder):
    out = tokens.decoder_rows(texts(spark, folder), MAX_LEN)
    return out.select(
        "user_id",
        joined("prompt_ids"),
        joined("total_ids"),
        joined("total_word_ids"),
        F.size("prompt_mask").cast("bigint").alias("n_prompt"),
        F.size("total_mask").cast("bigint").alias("n_total"),
    )


@query(
    with_ctes(
        HISTORY,
        TEXTS,
        """SELECT user_id, 'Input: ' || input_text || ' ' || chr(10) || 'Target: ' AS asked,
          'Input: ' || input_text || ' ' || chr(10) || 'Target: ' || target_text AS answered FROM texts""",
    )
)
def dialog_text(spark, folder):
    rows = texts(spark, folder)
    asked = tokens.dialog_text(F.col("input_text"))
    answered = tokens.dialog_text(F.col("input_text"), F.col("target_text"))
    return rows.select("user_id", asked.alias("asked"), answered.alias("answered"))


def padded(spark, folder, left: bool):
    """Encoder rows in seeded random order, batches of 16, padded to the batch maximum."""
    rows = tokens.encoder_rows(texts(spark, folder), MAX_LEN)
    rows = pin(rows.withColumn("draw", draws.draw(SEED, F.col("user_id"), "order")), "encoded")
    placed = shuffled_index(rows, "draw", ["user_id"], "place", rows.count())
    batches = tokens.batch_no(placed, "place", 16)
    pads = {
        "input_ids": tokens.PAD_ID,
        "attention_mask": tokens.MASK_PAD,
        "whole_word_ids": tokens.PAD_ID,
        "labels": tokens.LABEL_PAD,
    }
    out = tokens.pad_batches(batches, pads, left=left)
    return out.select("user_id", "batch", *[joined(c) for c in pads])


def padded_sql(left: bool) -> str:
    def pad(col: str, value: int) -> str:
        fill = f"list_resize([]::BIGINT[], (max(len({col})) OVER (PARTITION BY batch) - len({col}))::BIGINT, {value})"
        both = f"list_concat({fill}, {col})" if left else f"list_concat({col}, {fill})"
        return f"array_to_string({both}, ' ') AS {col}"

    return with_ctes(
        HISTORY,
        TEXTS,
        f"""enc AS (SELECT user_id, list_slice({encode_sql("input_text")}, 1, {MAX_LEN - 1}) AS e,
          {encode_sql("target_text")} AS t FROM texts)""",
        f"""cols AS (SELECT user_id, list_append(list_transform(e, lambda x: x.id), 1) AS input_ids,
          list_transform(list_append(e, e[1]), lambda x: 1::BIGINT) AS attention_mask,
          list_append(list_transform(e, lambda x: x.word + 1), 0) AS whole_word_ids,
          list_append(list_transform(t, lambda x: x.id), 1) AS labels,
          (row_number() OVER (ORDER BY {draw_sql(SEED, "user_id", "'order'")}, user_id) - 1) // 16 AS batch FROM enc)""",
        f"""SELECT user_id, batch, {pad("input_ids", 0)}, {pad("attention_mask", 0)}, {pad("whole_word_ids", 0)},
          {pad("labels", -100)} FROM cols""",
    )


@query(padded_sql(False))
def pad_batches(spark, folder):
    return padded(spark, folder, left=False)


@query(padded_sql(True))
def pad_batches_left(spark, folder):
    return padded(spark, folder, left=True)
