"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised.  The exponent
is the largest one whose weights reach a target entropy, raised again where a source would be
repeated more often than allowed.  It is found by bisection on a grid: each round evaluates
all grid points in one aggregate over the sources, so the number of sources is not bounded
by the driver.

A source then gets its weight's part of the token budget.  Its rows are dealt into blocks;
every epoch has its own permutation of the blocks and of the rows in a block, and the last
epoch ends where the budget does.  Only block totals are summed across a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import Scratch, words

ENTROPY = 0.95  # of the largest possible entropy
REPEATS = 4.0
SEED = 17
BLOCK_ROWS = 2_000
GRID = 32
ROUNDS = 5


def _log_weights(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """For each exponent: log of the sum of powers, entropy, sources, largest weight over share."""
    logp = F.ln("share")
    columns = []
    for e in exponents:
        power = F.exp(F.lit(e) * logp)
        columns += [F.sum(power), F.sum(power * logp), F.max(F.exp(F.lit(e - 1) * logp))]
    row = shares.agg(F.count(F.lit(1)), *columns).first()
    out = []
    for i, e in enumerate(exponents):
        z, weighted, ratio = row[1 + 3 * i : 4 + 3 * i]
        out.append((math.log(z), math.log(z) - e * weighted / z, row[0], ratio / z))
    return out


def exponent(shares: DataFrame, target: float = ENTROPY, repeats: float = REPEATS, budget: float = 1.0) -> float:
    """Exponent in [0, 1] for ``shares`` (source, share); ``budget`` in units of all tokens.

    With a smaller exponent the weights are more even (more entropy) and small sources are
    repeated more; the repetition limit wins.
    """
    def search(good) -> tuple[float, float]:
        """Neighbours on the finest grid: ``good`` holds at the first and not at the second."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
            held = [good(x) for x in _log_weights(shares, grid)]
            if all(held):
                return hi, hi
            k = held.index(False)
            if k == 0:
                return lo, lo
            lo, hi = grid[k - 1], grid[k]
        return lo, hi

    even, _ = search(lambda x: x[1] >= target * math.log(x[2]) - 1e-12)
    _, least = search(lambda x: budget * x[3] > repeats + 1e-12)
    return max(even, least)


def plan(items: DataFrame, target: float, repeats: float, budget: float) -> DataFrame:
    """source, source_tokens, weight, epochs (tokens wanted over tokens there), blocks.

    Sources without words have no weight and one epoch, unless no source has any.
    """
    sums = items.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("rows"))
    total = items.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.filter("source_tokens > 0").withColumn("share", F.col("source_tokens") / F.lit(float(total or 1)))
    if not total:
        return shares.select("source", "source_tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("epochs"), F.lit(1).alias("blocks"))
    e = exponent(shares, target, repeats, budget)
    z = math.exp(_log_weights(shares, [e])[0][0])
    weight = F.pow("share", F.lit(e)) / F.lit(z)
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")
    wordless = sums.filter("source_tokens = 0").select("source", "source_tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"), blocks)
    return shares.select("source", "source_tokens", weight.alias("weight"),
                         (weight * F.lit(budget) / F.col("share")).alias("epochs"), blocks).unionByName(wordless)


def _draw(*parts: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        target: float = ENTROPY, repeats: float = REPEATS, budget: float = 1.0) -> DataFrame:
    """(doc_id, h, source, rows, tokens, epoch, position), a row per chosen copy.

    Tokens are words.  ``budget`` is in units of all tokens there.  Rows equal in id, text and
    source are one item of ``rows`` rows, chosen together; rows without a source are a source
    of their own; texts without words (null, empty) weigh nothing and go with every epoch, those of a
    source without any words once, at position 0; a table without any words gives an empty result.
    ``position`` in [0, 1) is how far the source's budget is used up: sorting by it gives
    the mixed order.  Other columns are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(source).alias("source"),
                       F.size(words(F.col(text))).cast("long").alias("size"))
    items, _ = scratch.pin(rows.groupBy("doc_id", "h", "source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("tokens")))
    sources, _ = scratch.pin(plan(items, target, repeats, budget).withColumnRenamed("source", "__s"))
    wanted = items.join(sources, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    copies = wanted.withColumn("block", F.pmod(_draw("doc_id", "h"), F.col("blocks"))).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs").cast("int"), F.lit(1)) - 1)))
    of_block = ["source", "epoch", "block"]
    blocks = copies.groupBy(*of_block).agg(F.sum("tokens").alias("block_tokens"))
    turn = Window.partitionBy("source", "epoch").orderBy(_draw("epoch", "block"), "block")
    before = blocks.withColumn("before", F.sum("block_tokens").over(turn) - F.col("block_tokens"))
    before = before.select(*(F.col(c).alias(f"__{c}") for c in of_block), "before")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in of_block]
    inside = Window.partitionBy(*of_block).orderBy(_draw("epoch", "doc_id", "h"), "doc_id", "h")
    placed = copies.withColumn("within", F.sum("tokens").over(inside) - F.col("tokens")).join(before, same)
    start = F.col("epoch") + (F.col("before") + F.col("within")) / F.greatest("source_tokens", F.lit(1))
    return placed.withColumn("position", start / F.col("epochs")).filter(start < F.col("epochs")).select(
        "doc_id", "h", "source", "rows", "tokens", F.col("epoch").cast("long").alias("epoch"), "position")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **limits) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` chose it, all columns as they are."""
    chosen = mix(docs, doc_id, text, source, **limits).groupBy("doc_id", "h", "source").agg(F.count(F.lit(1)).alias("__n"))
    chosen = chosen.withColumnsRenamed({"doc_id": "__i", "h": "__x", "source": "__s"})
    marked = docs.withColumn("__h", F.xxhash64(text))
    joined = marked.join(chosen, F.col(doc_id).eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__x"))
                         & F.col(source).eqNullSafe(F.col("__s")))
    return joined.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)
