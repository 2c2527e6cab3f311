"""Token-array export: truncation with a protected target, word ids, padded batches.

The tokenizer is a set of column functions, or a Python function over Arrow batches.  The default
splits on white space and then into word characters and single marks, and hashes tokens to ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions.text import let as text_let

PAD_ID, END_ID, NEWLINE_ID, FIRST_ID = 0, 1, 2, 10  # reserved ids below FIRST_ID
MASK_PAD, LABEL_PAD = 0, -100  # fixed values of the export format
VOCABULARY = 32_000
TOKEN = r"\w+|[^\w\s]"
INPUT_PREFIX, TARGET_PREFIX = "Input: ", "Target: "


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_tokens(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(TOKEN), 0)


def hashed_id(token: Column) -> Column:
    head = F.conv(F.substring(F.md5(token.cast("binary")), 1, 6), 16, 10).cast("int")
    return head % VOCABULARY + FIRST_ID


@dataclass(frozen=True)
class Tokenizer:
    """``words`` text -> ARRAY<STRING>, ``pieces`` word -> ARRAY<STRING>, ``ids`` token -> INT.

    ``word_has_token`` says that every word has a token at least, so that the first n words of a
    text hold its first n tokens.
    """

    words: Callable[[Column], Column] = word_list
    pieces: Callable[[Column], Column] = word_tokens
    ids: Callable[[Column], Column] = hashed_id
    word_has_token: bool = True

    def encode(self, text: Column, limit: int | None = None) -> Column:
        """ARRAY<STRUCT<id, word>>: token ids with the 0-based number of their word.

        With ``limit`` the first ``limit`` tokens: words are cut into tokens in runs of ``limit`` until
        there are enough of them, and only these get ids.
        """
        if limit is None:
            tokens = text_let(self.words(text), lambda words: self._tokens(words, F.lit(0)))
        else:
            tokens = text_let(self.words(text), lambda words: self._first(words, limit))
        return F.transform(tokens, lambda t: F.struct(self.ids(t["token"]).alias("id"), t["word"].alias("word")))

    def _tokens(self, words: Column, before: Column) -> Column:
        """ARRAY<STRUCT<token, word>>; ``before`` words come in front of these."""
        return F.flatten(F.transform(
            words, lambda w, i: F.transform(self.pieces(w), lambda t: F.struct(t.alias("token"), (before + i).cast("int").alias("word")))))

    def _first(self, words: Column, limit: int) -> Column:
        if self.word_has_token:
            return F.slice(self._tokens(F.slice(words, 1, limit), F.lit(0)), 1, limit)
        empty = F.array().cast("array<struct<token:string,word:int>>")
        runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / limit).cast("int") - 1, F.lit(0)))
        found = F.aggregate(runs, empty, lambda had, i: F.when(F.size(had) >= limit, had).otherwise(
            F.concat(had, self._tokens(F.slice(words, i * limit + 1, limit), i * limit))))
        return F.slice(found, 1, limit)


@dataclass(frozen=True)
class BatchTokenizer:
    """A tokenizer in Python that gets texts in Arrow batches.

    ``load()`` runs once per task and returns ``encode(texts, limit)``, which gives each text's (id, word
    number) pairs, all of them or the first ``limit``.
    """

    load: Callable[[], Callable[[list[str], int | None], list[list[tuple[int, int]]]]]
    word_has_token: bool = False

    def encode(self, text: Column, limit: int | None = None) -> Column:
        load = self.load

        @F.pandas_udf("array<struct<id:int,word:int>>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            answer = load()
            for texts in batches:
                found = answer(texts.tolist(), limit)
                yield pd.Series([[{"id": i, "word": w} for i, w in (f if limit is None else f[:limit])] for f in found])

        return run(text)


DEFAULT = Tokenizer()


def ones(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.lit(1))


def encoder_rows(
    prompts: DataFrame, max_len: int, tok: Tokenizer = DEFAULT, text: str = "input_text", target: str = "target_text"
) -> DataFrame:
    """input_ids, attention_mask, whole_word_ids and labels, each closed by the end token.

    Words count from 1; the end token has word 0.
    """
    rows = prompts.withColumn("enc", tok.encode(F.col(text), max_len - 1)).withColumn(
        "tgt", tok.encode(F.col(target), max_len - 1)
    )
    end = F.lit(END_ID)
    out = rows.withColumn("input_ids", F.array_append("enc.id", end)).withColumn(
        "labels", F.array_append("tgt.id", end)
    )
    words = F.transform("enc", lambda e: e["word"] + 1)
    return (
        out.withColumn("attention_mask", ones(F.col("input_ids")))
        .withColumn("whole_word_ids", F.array_append(words, F.lit(0)))
        .drop("enc", "tgt")
    )


def decoder_rows(
    prompts: DataFrame, max_len: int, tok: Tokenizer = DEFAULT, text: str = "input_text", target: str = "target_text"
) -> DataFrame:
    """Prompt and total ids where only the prompt text may be cut, never the target.

    total = cut(input prefix + text) + newline + target prefix + target + end.  Word
    ids run on over the parts, start at 1, and the end token has word 0.
    """
    encoded = prompts.select(
        "*",
        # the cut below leaves fewer
        tok.encode(F.concat(F.lit(INPUT_PREFIX), F.col(text), F.lit(" ")), max_len).alias("enc"),
        tok.encode(F.lit(TARGET_PREFIX)).alias("pre"),
        tok.encode(F.col(target)).alias("tgt"),
    )
    reserved = F.size("pre") + F.size("tgt") + 2  # newline and end
    cut = encoded.withColumn("enc", F.slice("enc", F.lit(1), F.greatest(F.lit(max_len) - reserved, F.lit(0))))

    def last_word(col: str) -> Column:
        return F.coalesce(F.try_element_at(F.col(col), F.lit(-1)), F.lit(-1))

    def shifted(col: str, by: Column) -> Column:
        return F.transform(col, lambda e: e["word"] + by)

    parts = cut.select(
        "*",
        F.concat("enc.id", F.array(F.lit(NEWLINE_ID)), "pre.id").alias("prompt_ids"),
        F.array_append("enc.word", last_word("enc.word") + 1).alias("w1"),
    )
    parts = parts.withColumn("w2", F.concat("w1", shifted("pre", last_word("w1") + 1)))
    parts = parts.withColumn("w3", F.concat("w2", shifted("tgt", last_word("w2") + 1)))
    return (
        parts.withColumn("total_ids", F.concat("prompt_ids", "tgt.id", F.array(F.lit(END_ID))))
        .withColumn("prompt_word_ids", F.transform("w2", lambda w: w + 1))
        .withColumn("total_word_ids", F.array_append(F.transform("w3", lambda w: w + 1), F.lit(0)))
        .withColumn("prompt_mask", ones(F.col("prompt_ids")))
        .withColumn("total_mask", ones(F.col("total_ids")))
        .drop("enc", "pre", "tgt", "w1", "w2", "w3")
    )


def dialog_text(text: Column, target: Column | None = None) -> Column:
    """Text form of a decoder prompt, with or without its answer."""
    head = F.concat(F.lit(INPUT_PREFIX), text, F.lit(" \n" + TARGET_PREFIX))
    return head if target is None else F.concat(head, target)


def batch_no(rows: DataFrame, index: str, size: int, out: str = "batch") -> DataFrame:
    """Number of the batch of a dense 0-based index; the last one may be smaller."""
    return rows.withColumn(out, F.expr(f"{index} div {int(size)}"))


def pad_right(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids)))


def pad_left(ids: Column, length: Column, pad: int) -> Column:
    """Padding by length, so an id equal to ``pad`` inside the row stays where it is."""
    return F.concat(F.array_repeat(F.lit(pad), length - F.size(ids)), ids)


def pad_batches(
    rows: DataFrame, pads: dict[str, int], batch: str | list[str] = "batch", left: bool = False
) -> DataFrame:
    """Pad each list column to its longest row of the batch (a group of batch size)."""
    in_batch = W.partitionBy(*([batch] if isinstance(batch, str) else batch))
    pad = pad_left if left else pad_right
    longest = rows.select(
        "*", *[F.max(F.size(c)).over(in_batch).alias(f"{c}_len") for c in pads]
    )
    keep = [c for c in rows.columns if c not in pads]
    return longest.select(
        *keep, *[pad(F.col(c), F.col(f"{c}_len"), p).alias(c) for c, p in pads.items()]
    )
