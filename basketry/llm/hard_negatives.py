"""Hard negatives by a secondary sort of scored pairs.

Rows and anchors are packed into blocks.  Every block of anchors meets every block of rows in
some task, one anchor block at a time beside the row block, and the products of the two are
one matrix product, exact on integers.  A task passes on what can still be chosen: an anchor's
best pairs of its own label, or, once the positives are known, the best pairs in each positive's
window.  The best of a whole are among the best of its parts, so nothing is lost.

The pairs are packed into byte keys (anchor, descending score, kind, id) and go through
``repartitionAndSortWithinPartitions``.  An iterator reads a partition in this order: the first
rows of a label are the positives; each positive opens a window, each later negative is given to
the open windows that it fits.  What is held is the open windows of one anchor.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Scratch

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # a negative scores at least so many and at most so many hundredths of its positive
ROW_BLOCK = 8192
ANCHOR_BLOCK = 512
_EXACT = 1 << 53
_BIAS = 1 << 63
_KEY = struct.Struct(">QQBQ")
_POSITIVE, _NEGATIVE = 0, 1


def usable(rows: DataFrame, vec_id: str, vector: str, label: Column | str) -> DataFrame:
    """(vec_id, label, vector): rows with an id, a label and finite components; one row per id."""
    v, x = F.col(vector), F.col(label) if isinstance(label, str) else label
    whole = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), x.cast("bigint").alias("label"), v.cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = whole.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return one.select("vec_id", "r.label", "r.vector")


def _narrow(q: np.ndarray) -> tuple[str, bytes]:
    top = int(np.abs(q).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind, q.astype(kind).tobytes()


def _integers(vectors: list, dim: int) -> np.ndarray:
    x = np.floor(SCALE * np.array(vectors, np.float64).reshape(len(vectors), dim))
    if len(x) and np.abs(x).max(initial=0) >= float(1 << 62):
        raise OverflowError("a component does not fit 64-bit integers")
    return x.astype(np.int64)


PACKED = "side int, block bigint, part bigint, dim int, kind string, ids binary, labels binary, data binary, wanted array<array<bigint>>"


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` rows of one length, ids ascending in each; ``rows`` (block, vec_id, label, vector[, wanted])."""
    more = "wanted" in rows.columns

    def work(batches):
        held: list[tuple] = []

        def closed():
            block, dim = held[0][:2]
            kind, data = _narrow(_integers([r[4] for r in held], dim))
            cells = [1, block, 0, dim, kind, np.array([r[2] for r in held], "<i8").tobytes(), np.array([r[3] for r in held], "<i8").tobytes(), data,
                     [r[5] for r in held] if more else None]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * 3, pa.list_(pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)],
                                              ["side", "block", "part", "dim", "kind", "ids", "labels", "data", "wanted"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[:2] != held[0][:2] or len(held) >= size):
                    yield closed()
                    held = []
                held.append(row)
        if held:
            yield closed()

    dealt = rows.withColumn("dim", F.size("vector")).repartition("block").sortWithinPartitions("block", "dim", "vec_id")
    return dealt.select("block", "dim", "vec_id", "label", "vector", *["wanted"] * more).mapInArrow(work, PACKED)


def _dealt(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``rows`` with a block number below the returned count, some ``size`` rows a block."""
    blocks = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(blocks))), blocks


class Block:
    """One unpacked block; rows are in order of their ids."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.data = np.frombuffer(row["data"], row["kind"]).reshape(len(self.ids), self.dim).astype(np.float64 if row["kind"] != "<i8" else np.int64)
        self.top = int(np.abs(self.data).max(initial=0))
        self.wanted = row["wanted"]


def products(a: Block, b: Block) -> np.ndarray:
    """Integer inner products of all rows of two blocks."""
    bound = a.top * b.top * max(a.dim, 1)
    if bound < _EXACT:
        return (a.data.astype(np.float64) @ b.data.T.astype(np.float64)).astype(np.int64)
    if bound >= _BIAS:
        raise OverflowError("a product does not fit 64-bit integers")
    return a.data.astype(np.int64) @ b.data.astype(np.int64).T


def first(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` (ascending), the ``k`` of the highest scores, ties by place."""
    if len(at) > k:
        found = scores[at]
        least = np.partition(found, len(found) - k)[len(found) - k]
        above, level = at[found > least], at[found == least]
        at = np.concatenate([above, level[: k - len(above)]])
    return at


def _positive_pairs(a: Block, i: int, scores: np.ndarray, b: Block) -> Iterator[tuple]:
    at = np.flatnonzero((b.labels == a.labels[i]) & (b.ids != a.ids[i]))
    for j in first(scores, at, POSITIVES):
        yield int(a.ids[i]), int(scores[j]), _POSITIVE, int(b.ids[j])


def _negative_pairs(a: Block, i: int, scores: np.ndarray, b: Block) -> Iterator[tuple]:
    chosen: set[int] = set()
    other = np.flatnonzero(b.labels != a.labels[i])
    found = scores[other]
    for p in set(a.wanted[i]):
        low, high = -(-LOW * p // 100), HIGH * p // 100
        inside = other[(found >= low) & (found <= high)]
        chosen.update(first(scores, inside, NEGATIVES).tolist())
    for j in chosen:
        yield int(a.ids[i]), int(scores[j]), _NEGATIVE, int(b.ids[j])


def block_pairs(rows: DataFrame, anchors: DataFrame, count: int, pairs_of) -> DataFrame:
    """(anchor, score, kind, id) of what each block of rows can give to each anchor."""

    def work(batches):
        own: dict[int, list[Block]] = {}
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, own = row["block"], {}
                if row["side"] == 1:
                    own.setdefault(row["dim"], []).append(Block(row))
                    continue
                a, out = Block(row), []
                for b in own.get(a.dim, []):
                    table = products(a, b)
                    for i in range(len(a.ids)):
                        out.extend(pairs_of(a, i, table[i], b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "score", "kind", "id"])

    asked = anchors.withColumns({"part": F.col("block"), "block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))), "side": F.lit(2)})
    both = rows.unionByName(asked.select(rows.columns))
    met = both.repartitionById(count, F.col("block").cast("int")).sortWithinPartitions("block", "side", "part")
    return met.mapInArrow(work, "anchor bigint, score bigint, kind bigint, id bigint")


def _by_anchor(key: bytes) -> int:
    # Ids in steps (each fiftieth row, say) must not leave partitions empty.
    return (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 >> 24) & 0x7FFFFFFF


def _pack(anchor: int, score: int, kind: int, number: int) -> bytes:
    return _KEY.pack(anchor + _BIAS, _BIAS - 1 - score, kind, number + _BIAS)


def _unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, number = _KEY.unpack(key)
    return anchor - _BIAS, _BIAS - 1 - score, kind, number - _BIAS


def sorted_pairs(pairs: DataFrame, partitions: int) -> RDD:
    """Keys of all pairs, in order within an anchor; an anchor's pairs are in one partition."""
    keyed = pairs.select("anchor", "score", "kind", "id").rdd.map(lambda r: (_pack(*r), None))
    return keyed.repartitionAndSortWithinPartitions(partitions, _by_anchor).map(lambda pair: _unpack(pair[0]))


def leading(stream) -> Iterator[tuple]:
    """(anchor, id, score) of the first ``POSITIVES`` pairs of each anchor."""
    anchor, left = None, 0
    for found, score, _, number in stream:
        if found != anchor:
            anchor, left = found, POSITIVES
        if left:
            left -= 1
            yield anchor, number, score


def windows(stream) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score): negatives of each positive's window."""
    anchor, opened = None, []
    for found, score, kind, number in stream:
        if found != anchor:
            anchor, opened = found, []
        if kind == _POSITIVE:
            opened.append([number, score, 0])
            continue
        for window in opened:
            positive, level, given = window
            if given < NEGATIVES and LOW * level <= 100 * score <= HIGH * level:
                window[2] += 1
                yield anchor, positive, given + 1, number, level, score


def mine(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``vec_id``.  Rows without an id, a label or a vector, and rows with a
    component that is null or not finite, take no part; of rows that share an id the one with the
    smallest label, then vector, does.  Only vectors of one length are compared (of none, all score
    zero).  Ties go to the smaller id.  Anchors without positives, and positives without a row in their
    window (negative scores have none), give no row.  Scores that 64-bit integers cannot hold fail
    the job.  Other columns are not read; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    clean, _ = scratch.pin(usable(rows, vec_id, vector, label))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt, count = _dealt(clean, ROW_BLOCK)
    blocks, _ = scratch.pin(packed(dealt, ROW_BLOCK))
    chosen = clean.filter(anchors)
    asked = packed(_dealt(chosen, ANCHOR_BLOCK)[0], ANCHOR_BLOCK)
    ranked = sorted_pairs(block_pairs(blocks, asked, count, _positive_pairs), partitions).mapPartitions(leading)
    positives, _ = scratch.pin(spark.createDataFrame(ranked, "anchor bigint, id bigint, score bigint", verifySchema=False))
    wanted = positives.groupBy("anchor").agg(F.collect_set("score").alias("wanted"))  # POSITIVES at most
    again = packed(_dealt(chosen.join(wanted, F.col("vec_id") == F.col("anchor")).drop("anchor"), ANCHOR_BLOCK)[0], ANCHOR_BLOCK)
    negatives = block_pairs(blocks, again, count, _negative_pairs)
    pairs = negatives.unionByName(positives.withColumn("kind", F.lit(_POSITIVE).cast("bigint")))
    found = sorted_pairs(pairs, partitions).mapPartitions(windows)
    return spark.createDataFrame(found, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
                                        "negative_score bigint", verifySchema=False)


SQL = """
WITH good AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY rank <= 3"""
