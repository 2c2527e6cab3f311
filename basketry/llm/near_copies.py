"""Near copies by shingle similarity: Jaccard of the sets of 5-word shingles, 0.8 or more.

Candidates come from SimHash: the sets' fingerprints are grouped through operator 1's pivot tables
(:func:`simhash_dedup.pivot_groups`), and a group is a bucket whose sets are compared.  A SimHash
radius that reaches 0.8 (about ten of 64 bits) has no block that is both likely equal and rare, so
banded MinHash brings the pairs outside the radius: a document's set gives ``BANDS`` further
keys, each the hash of ``ROWS`` minima, which is as rare as the shingles are, and sets that share a
key are compared too.  A pair of similarity s shares one with the chance 1 - (1 - s**5)**20: 99.96 % at
0.8, more above.  Every candidate of either kind is verified with the exact similarity.

A bucket never lists its pairs.  Its members are compared with its smallest and largest first
and the links contracted.  Where several groups are left, the bucket's centre follows: the member
nearest to the majority of a sample of the members, compared with all.  Only then are members of
different groups paired, and a pair leaves the join only if its parity sketches allow 0.8: the
sketch of a set has a bit for each of 512 classes of its shingles, set if the class holds an odd
number of them, so two sketches differ in at most as many bits as the sets differ in shingles.
Sets of over 512 shingles are sketched from every 2nd, 4th, ... shingle by hash, with a margin of
``MARGIN`` standard deviations for the draw.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import Scratch
from basketry.llm.components import components
from basketry.llm.hamming import signed
from basketry.llm.simhash_dedup import majority, one_of_each, pivot_groups

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SKETCH_BITS = 512
MARGIN = 6.0
VOTERS = 64  # members at most that vote on a bucket's centre
PAIR_BLOCK = 2000  # members of a bucket that one task pairs with the others
_WORDS = SKETCH_BITS // 64
_SLICE = 1 << 12
_rng = random.Random(8)
_MIXED = np.array([[_rng.getrandbits(64)] for _ in range(BANDS * ROWS)], np.uint64)
_FACTORS = np.array([[_rng.getrandbits(64) | 1] for _ in range(BANDS * ROWS)], np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; a text of fewer words is one shingle."""
    found = (text or b"").lower().split()
    n = max(1, len(found) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(SHINGLE)))) if len(found) >= SHINGLE else iter([b" ".join(found)])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 5) for s in shingles), np.uint64, n))


def node_of(shingles: np.ndarray) -> int:
    """Identity of a shingle set."""
    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), 9))


def band_keys(shingles: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _SLICE):
        part = shingles[at : at + _SLICE]
        least = np.minimum(least, ((part[None, :] ^ _MIXED) * _FACTORS).min(axis=1))
    return [signed(xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def level_of(n: int) -> int:
    """A set of n shingles is sketched from one in 2**level of them."""
    return max(0, (n - 1) // SKETCH_BITS).bit_length()


def parity(shingles: np.ndarray, level: int) -> np.ndarray:
    mixed = shingles * np.uint64(0x9E3779B97F4A7C15)
    taken = mixed[(mixed >> np.uint64(20)) & np.uint64((1 << level) - 1) == 0]
    odd = np.bincount((taken >> np.uint64(55)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def sketch(shingles: np.ndarray) -> list[int]:
    """Parity words at the set's own level and at the next."""
    level = level_of(len(shingles))
    return np.concatenate([parity(shingles, level), parity(shingles, level + 1)]).tolist()


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, node, n, f, keys, bits): a row per input row; h identifies the text, node its shingle set, f is its SimHash."""

    def work(batches):
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([majority(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                 pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "h", "node", "n", "f", "keys", "bits"])

    ids = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("text")).mapInArrow(
        work, f"doc_id {ids}, h bigint, node bigint, n bigint, f bigint, keys array<bigint>, bits array<bigint>")


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, s): the shingle sets of ``texts`` (text)."""

    def work(batches):
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "s"])

    return texts.mapInArrow(work, "node bigint, s binary").groupBy("node").agg(F.first("s").alias("s"))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ...) whose similarity is ``least`` or more."""
    more = [c for c in pairs.columns if c not in ("a", "b")]

    def work(batches):
        for b in batches:
            x, y = (b.column(b.schema.get_field_index(c)) for c in ("x", "y"))
            good = [similarity(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) >= least for p, q in zip(x, y)]
            yield b.select(["a", "b", *more]).filter(pa.array(good, pa.bool_()))

    with_x = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    both = with_x.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", *more, "x", "y").mapInArrow(work, pairs.select("a", "b", *more).schema)


def _sizes_fit(n: Column, m: Column, least: float) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * least - 1e-9


def _level(n: Column) -> Column:
    """:func:`level_of` of a column."""
    return F.length(F.bin(F.floor(F.greatest(n - 1, F.lit(0)) / SKETCH_BITS))) - F.when(n <= SKETCH_BITS, 1).otherwise(0)


def _differing(a: str, b: str, la: Column, lb: Column) -> Column:
    """Differing sketch bits, at the coarser of two levels that are one apart at most."""
    word = lambda c, i, own, other: F.when(own < other, F.get(c, F.lit(_WORDS + i))).otherwise(F.get(c, F.lit(i)))
    each = [F.bit_count(word(a, i, la, lb).bitwiseXOR(word(b, i, lb, la))) for i in range(_WORDS)]
    return sum(each[1:], each[0])


def _allowed(n: Column, m: Column, level: Column, least: float) -> Column:
    """Bits in which the sketches of a pair of similarity ``least`` or more differ at most."""
    most = (n + m) * ((1 - least) / (1 + least)) / F.pow(F.lit(2.0), level)
    return most + F.when(level > 0, F.sqrt(most) * MARGIN).otherwise(1e-6)


def _may_link(n: str, m: str, a: str, b: str, least: float) -> Column:
    n, m = F.col(n), F.col(m)
    la, lb = _level(n), _level(m)
    return _sizes_fit(n, m, least) & (_differing(a, b, la, lb) <= _allowed(n, m, F.greatest(la, lb), least))


@F.udf(T.ArrayType(T.LongType()), useArrow=True)
def _majority(found: list) -> list:
    votes = np.unpackbits(np.array([list(f) for f in found], "<i8").view(np.uint8), axis=1).mean(axis=0)
    return np.packbits(votes > 0.5).view("<i8").tolist()


def _centres(rows: DataFrame, least: float) -> DataFrame:
    """(key, c): the member (node, n, g, bits) of each bucket that is nearest to the majority of its voters."""
    slot = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(VOTERS))
    votes = rows.groupBy("key", slot.alias("slot")).agg(F.min_by("bits", "node").alias("bits"))
    middle = votes.groupBy("key").agg(_majority(F.collect_list("bits")).alias("middle"))  # VOTERS rows a key
    level = _level(F.col("n"))
    slack = _differing("bits", "middle", level, level) - F.col("n") * ((1 - least) / (1 + least)) / F.pow(F.lit(2.0), level)
    return rows.join(middle, "key").groupBy("key").agg(F.min_by(F.struct("node", "n", "g", "bits"), F.struct(slack, "node")).alias("c"))


def _merged(roots: DataFrame, tops: DataFrame) -> DataFrame:
    """Groups merged by ``tops`` (node, root of groups) take the new root; so do their old roots."""
    tops = tops.toDF("below", "top")
    moved = roots.join(tops, F.col("root") == F.col("below"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(tops.toDF("node", "root")).distinct()


def _several(rows: DataFrame) -> DataFrame:
    """The members (key, node, g, ...) of buckets with several groups."""
    mixed = rows.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo != hi")
    return rows.join(mixed.select("key", "members"), "key")


def _regrouped(rows: DataFrame, tops: DataFrame) -> DataFrame:
    tops = tops.toDF("below", "top")
    return rows.join(tops, F.col("g") == F.col("below"), "left").withColumn("g", F.coalesce("top", "g")).drop("below", "top")


def _pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, ga, gb) of the members of different groups whose sketches allow a link."""
    blocks = F.col("members").cast("int") / PAIR_BLOCK
    count = F.ceil(blocks).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(4)), count).cast("int")
    x = rows.select("key", own.alias("block"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("g").alias("ga"), F.col("bits").alias("xa"))
    y = rows.select("key", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"), F.col("node").alias("b"), F.col("n").alias("nb"),
                    F.col("g").alias("gb"), F.col("bits").alias("xb"))
    return x.join(y, ["key", "block"]).filter((F.col("ga") < F.col("gb")) & _may_link("na", "nb", "xa", "xb", least)).select("a", "b", "ga", "gb").distinct()


def linked_sets(docs: DataFrame, rows: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """(node, root) for every shingle set whose single-linkage group has a smaller member."""
    scratch = Scratch(docs.sparkSession, "near_copies")
    nodes = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("f").alias("f"), F.first("keys").alias("keys"))
    near = pivot_groups(rows.select("f").distinct()).withColumnRenamed("f", "__f")
    prints = nodes.select("node", "n", "f").join(near, F.col("f") == F.col("__f"), "left")
    prints = prints.select("node", "n", F.xxhash64(F.coalesce("root", "f"), F.lit(10)).alias("key"))
    buckets = nodes.select("node", "n", F.explode("keys").alias("key")).unionByName(prints)
    end = F.struct("node", "n")
    shared = buckets.groupBy("key").agg(F.min(end).alias("lo"), F.max(end).alias("hi")).filter("lo.node != hi.node")
    crowd, crowd_path = scratch.pin(buckets.join(shared, "key"))
    picked = (rows.join(crowd.select("node").distinct(), "node", "left_semi")
              .groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("o")).select(F.col("o.doc_id").alias("__i"), F.col("o.h").alias("__x")))
    texts = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__h"), F.col(text).cast("binary").alias("text"))
    texts = texts.join(picked, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__x")), "left_semi").select("text")
    sets, sets_path = scratch.pin(sets_of(texts))
    ends = crowd.select("node", "n", F.explode(F.array("lo", "hi")).alias("e")).filter("node != e.node")
    star = ends.filter(_sizes_fit(F.col("n"), F.col("e.n"), least)).select(
        F.greatest("node", "e.node").alias("a"), F.least("node", "e.node").alias("b")).distinct()
    roots = components(verified(star, sets, least), "a", "b")
    named = (crowd.select("key", "node", "n").join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
             .select("key", "node", "n", F.coalesce("root", "node").alias("g")))
    still = _several(named).drop("members")
    bits = rows.join(still.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("bits").alias("bits"))
    open_rows, open_path = scratch.pin(still.join(bits, "node"))
    scratch.drop(crowd_path)
    near_centre = (open_rows.join(_centres(open_rows, least), "key").filter(F.col("g") != F.col("c.g")).filter(_may_link("n", "c.n", "bits", "c.bits", least))
                   .select(F.col("node").alias("a"), F.col("c.node").alias("b"), F.col("g").alias("ga"), F.col("c.g").alias("gb")).distinct())
    tops = components(verified(near_centre, sets, least), "ga", "gb")
    roots = _merged(roots, tops)
    left, left_path = scratch.pin(_several(_regrouped(open_rows, tops)))
    tops = components(verified(_pairs(left, least), sets, least), "ga", "gb")
    for path in (open_path, left_path, sets_path):
        scratch.drop(path)
    return _merged(roots, tops)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, root), one row per input row; rows with one ``root`` are linked by similarities of ``least`` or more.

    Words are split and compared as by :func:`simhash_dedup.fingerprint`; repeated shingles count
    once, texts without words (null, empty) are equal to each other.  Other columns are not
    read; an empty table gives an empty result.
    """
    rows, _ = Scratch(docs.sparkSession, "near_copies").pin(sketches(docs, doc_id, text))
    roots = linked_sets(docs, rows, doc_id, text, least).withColumnRenamed("node", "__n")
    return rows.join(roots, F.col("node") == F.col("__n"), "left").select("doc_id", "h", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies, chosen as by :func:`simhash_dedup.keep_one`."""
    return one_of_each(docs, groups(docs, doc_id, text, least), doc_id, text)
