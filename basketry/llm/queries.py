"""The registered queries of this package and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import chaining, cuckoo_dedup, fill_middle, fingerprints, hard_negatives, host_rules, html_extract, mixing, packing, perplexity, pii, simhash_dedup, suffix_dedup
from basketry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_simhash_pivots(spark, folder):
    return simhash_dedup.dedup(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query()
def op2_kneser_ney_quality(spark, folder):
    found = perplexity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", "kept")


@query()
def op3_differencing_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query()
def op4_suffix_repeats(spark, folder):
    return suffix_dedup.dedup(table(spark, folder, "documents"), keep="none")


@query()
def op5_chained_passages(spark, folder):
    return chaining.passages(table(spark, folder, "documents"))


@query(host_rules.SQL)
def op6_host_rules(spark, folder):
    return host_rules.apply_rules(table(spark, folder, "documents"))


@query()
def op7_personal_data(spark, folder):
    return pii.find(table(spark, folder, "documents"))


@query()
def op8_main_text(spark, folder):
    return html_extract.extract(table(spark, folder, "pages"))


@query()
def op9_simhash_blocks(spark, folder):
    return fingerprints.edited_report(table(spark, folder, "documents"))


@query()
def op10_temperature_mixing(spark, folder):
    chosen = mixing.mix(table(spark, folder, "documents"))
    return chosen.select("doc_id", "source", F.col("rows").cast("bigint").alias("rows"), "tokens", "epoch", "position")


@query(fill_middle.SQL)
def op11_fill_middle(spark, folder):
    return fill_middle.report(table(spark, folder, "documents"))


@query(cuckoo_dedup.SQL)
def op12_cuckoo_dedup(spark, folder):
    return cuckoo_dedup.dedup(table(spark, folder, "documents"))


@query(hard_negatives.SQL)
def op13_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label=label)
