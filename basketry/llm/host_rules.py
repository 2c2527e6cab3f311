"""Host-level quality rules, with DataFrame functions only.

Every document is measured and judged by rules; failures are counted by host, each host's
failure rate is shrunk towards the rate of all hosts with an empirical beta prior, and the
verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry import storage
from basketry.llm.common import SPACES, Scratch, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PER_WORD = 0.5
MAX_WORD_LENGTH = 25
HOST_LIMIT = 0.5
PRIOR_WEIGHT = (1.0, 1e6)  # bounds of the prior's weight in documents


def measures(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per row.

    Repeat words are those inside a 5-word window that occurs twice or more in the text.
    Windows are compared by a 64-bit hash.  Texts without a repeated window, most of them,
    stop after one pass; in the others the windows are sorted by hash, those with an equal
    neighbour are put back in text order, and each adds the words not covered before it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), t.alias("t"))
    rows = rows.select(
        "doc_id", "host", words(F.col("t")).alias("w"),
        F.char_length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
    w = F.col("w")
    windows = F.when(F.size(w) > WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + j] for j in range(WINDOW)))))
    rows = rows.withColumns({"n_words": F.size(w).cast("long"), "h": windows}).drop("w")
    # Only texts with a repeated window go on; array functions of the others stay unevaluated.
    some = F.col("h").isNotNull() & (F.size(F.array_distinct("h")) < F.size("h"))
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(some, placed)).drop("h")
    s = F.col("s")
    n = F.size(s)
    twice = F.filter(s, lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]))
                     | ((k < n - 1) & (s[F.least(k + 1, n - 1)]["h"] == x["h"])))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    rows = rows.withColumn("p", starts).drop("s")
    p = F.col("p")
    covered = F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
                          lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x + WINDOW - a["end"])).alias("n"), (x + WINDOW).alias("end")),
                          lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def judged(rows: DataFrame) -> DataFrame:
    """``base_failed`` and ``rule_failed``: the base rules, and any rule at all."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = ((F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"))
            | (F.col("word_chars") > MAX_WORD_LENGTH * F.col("n_words")))
    return rows.withColumn("base_failed", base).withColumn("rule_failed", F.col("base_failed") | more)


def verdicts(rows: DataFrame) -> DataFrame:
    """host, host_docs, host_rate, host_kept from rows with ``rule_failed``.

    The prior beta(m s, (1 - m) s) has the mean m of all documents and the weight s that
    explains the spread of the hosts' rates (method of moments, by documents).
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("k"))
    total = hosts.agg(F.sum("k"), F.sum("n"), F.sum(F.col("k") * F.col("k") / F.col("n"))).first()
    k, n, squares = (float(x or 0) for x in total)
    mean = k / n if n else 0.0
    spread = max(squares / n - mean * mean, 0.0) if n else 0.0
    weight = min(max(mean * (1 - mean) / spread - 1 if spread > 1e-12 else PRIOR_WEIGHT[1], PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    rate = (F.col("k") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("host", F.col("n").alias("host_docs"), rate.alias("host_rate"), (rate <= HOST_LIMIT).alias("host_kept"))


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures, verdicts and ``kept`` per input row.

    A null text has no words and fails the base rules; rows without a host form one host of
    their own; repeated rows count each time; other columns are not read; an empty table
    gives an empty result.  The host column is never shuffled with texts: rows are narrow by
    then, and the host table is broadcast only after its rows were counted.
    """
    rows, _ = Scratch(docs.sparkSession, "host-rules").pin(judged(measures(docs, doc_id, text, host)))
    hosts = storage.broadcast_if_small(verdicts(rows).withColumnRenamed("host", "__host"))
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host", "host_docs",
                         F.round("host_rate", 6).alias("host_rate"))


SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT r, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) > 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS j) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.r, doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR n_symbols > 0.5 * n_words OR word_chars > 25 * n_words AS failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS k FROM f GROUP BY host),
s AS (SELECT CAST(sum(k) AS DOUBLE) / sum(n) AS mean, sum(k * k / CAST(n AS DOUBLE)) / sum(n) AS sq FROM h),
p AS (SELECT mean, CASE WHEN sq - mean * mean > 1e-12
    THEN least(greatest(mean * (1 - mean) / (sq - mean * mean) - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM s),
v AS (SELECT host, n, (k + mean * weight) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept, f.host, CAST(v.n AS BIGINT) AS host_docs, round(rate, 6) AS host_rate
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host"""
