"""Training-set export: prompts to shuffled, padded batches of token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import draws
from basketry.operators import splits, tokens
from basketry.operators.numbering import HOT_ROWS, number_rows
from basketry.plans.prompts import WHOLE
from basketry.storage import pin

TEXT_COLUMNS = ["user_id", "epoch", "task", "role", "template_id", "input_text", "target_text"]
ENCODER_PADS = {
    "input_ids": tokens.PAD_ID,
    "attention_mask": tokens.MASK_PAD,
    "whole_word_ids": tokens.PAD_ID,
    "labels": tokens.LABEL_PAD,
}
DECODER_PADS = {
    "prompt_ids": tokens.PAD_ID,
    "prompt_mask": tokens.MASK_PAD,
    "prompt_word_ids": tokens.PAD_ID,
    "total_ids": tokens.PAD_ID,
    "total_mask": tokens.MASK_PAD,
    "total_word_ids": tokens.PAD_ID,
    "total_labels": tokens.LABEL_PAD,
}


def cut_texts(prompts: DataFrame, max_len: int, size: int = splits.SEGMENT, tok: tokens.Tokenizer | tokens.BatchTokenizer = tokens.DEFAULT) -> DataFrame:
    """One text per prompt that has the same first ``max_len`` tokens as the whole one.

    Whole texts stay.  Of a prompt in pieces as many segments are joined as the cut can reach: a
    segment's list of ``size`` items holds at least ``size`` tokens if every word has one.  For a
    tokenizer that does not promise this all pieces are joined.
    """
    whole = prompts.filter(F.col("part_no") == WHOLE).select(*TEXT_COLUMNS)
    pieces = prompts.filter(F.col("part_no") != WHOLE)
    if tok.word_has_token:
        pieces = pieces.filter(F.col("segment_no") < -(-max_len // size))
    parts = F.sort_array(F.collect_list(F.struct("part_no", "segment_no", "input_text")))  # the text itself
    keys = [c for c in TEXT_COLUMNS if c != "input_text"]
    joined = pieces.groupBy(*keys).agg(F.array_join(parts["input_text"], "").alias("input_text"))
    return whole.unionByName(joined)


def epoch_batches(rows: DataFrame, seed: int, size: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``place`` and ``batch``: each epoch in its own seeded random order.

    An epoch is one key of the numbering, so a big one is numbered in ranges.
    """
    who = ["user_id", "task", "role", "template_id"]
    order = draws.draw(seed, F.col("epoch"), *[F.col(c) for c in who], "order")
    drawn = rows.withColumn("draw", order)
    placed = number_rows(
        drawn, ["epoch"], ["draw", *who], pos="place", total=None, hot_rows=hot_rows
    )
    return tokens.batch_no(placed, "place", size).drop("draw")


def export_batches(
    prompts: DataFrame,
    *,
    seed: int,
    batch_size: int,
    max_len: int,
    decoder: bool = False,
    tok: tokens.Tokenizer | tokens.BatchTokenizer = tokens.DEFAULT,
    hot_rows: int = HOT_ROWS,
    size: int = splits.SEGMENT,
) -> DataFrame:
    """One row per prompt: epoch, batch, place and list columns padded within the batch.

    ``prompts`` may hold pieces (see ``whole_prompts``).  Only the text is shuffled for
    the order; the arrays are made after it.
    """
    in_pieces = "part_no" in prompts.columns
    texts = cut_texts(prompts, max_len, size, tok) if in_pieces else prompts.select(*TEXT_COLUMNS)
    placed = pin(epoch_batches(texts, seed, batch_size, hot_rows), "placed")
    if decoder:
        rows = tokens.decoder_rows(placed, max_len, tok).withColumn("total_labels", F.col("total_ids"))
        pads = DECODER_PADS
    else:
        rows, pads = tokens.encoder_rows(placed, max_len, tok), ENCODER_PADS
    out = tokens.pad_batches(rows.drop("input_text", "target_text"), pads, ["epoch", "batch"])
    return out.select("epoch", "batch", "place", "user_id", "task", "role", "template_id", *pads)
