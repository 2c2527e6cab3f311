"""SimHash near-duplicates found through pivot distance tables.

Every distinct fingerprint carries its Hamming distances to sixteen reference
fingerprints.  By the triangle inequality two fingerprints within distance r differ by at
most r in each of these coordinates, so a pair with a larger difference is discarded
before its distance is computed; survivors are verified with the exact distance.

Distances of whole 64-bit words to a reference have standard deviation 4, about the search
radius: one reference keeps over half of all pairs, and there is no equality to shuffle
on.  So the pairs that reach the table test are formed on further references of one bit
each (their distance, less that to the zero word, is the bit itself): of six blocks of such
references two are untouched by four differing bits, and equal coordinates there are the
join key.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Scratch
from basketry.llm.hamming import linked_groups, signed

PIVOT_SEED = 20
PIVOTS = 16
SHINGLE = 4
RADIUS = 4
BLOCKS = 6
_SLICE = 1 << 15


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the ``size``-word shingles of an UTF-8 text.

    Repeated shingles count each time, a text of fewer words is one shingle, no word at all
    gives zero.  A bit is set when more than half of the shingle hashes have it.
    """
    found = (text or b"").lower().split()  # bytes: A-Z only, blank and 9 to 13 only
    if not found:
        return 0
    n = max(1, len(found) - size + 1)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(size)))) if len(found) >= size else iter([b" ".join(found)])
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8", n))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the 64-bit hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, f, h): a row per input row; h identifies the text."""

    def work(batches):
        for b in batches:
            texts = b.column(1)
            f = [fingerprint(t.as_py(), size) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.int64()), b.column(2)], ["doc_id", "f", "h"])

    ids = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"),
                       F.xxhash64(text).alias("h")).mapInArrow(work, f"doc_id {ids}, f bigint, h bigint")


def pivots(seed: int = PIVOT_SEED, count: int = PIVOTS) -> list[int]:
    rng = random.Random(seed)
    return [signed(rng.getrandbits(64)) for _ in range(count)]


def pivot_groups(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(f, root) for every one of the distinct fingerprints ``f`` whose single-linkage group has a smaller member."""
    references = pivots()

    def coordinates(f: Column) -> Column:
        return F.struct(*(F.bit_count(f.bitwiseXOR(F.lit(p))).cast("byte").alias(f"d{i}") for i, p in enumerate(references)))

    def close(a: str, b: str) -> Column:
        test = F.lit(True)
        for i in range(len(references)):
            test = test & (F.abs(F.col(f"{a}.d{i}") - F.col(f"{b}.d{i}")) <= radius)
        return test

    return linked_groups(prints.select("f"), radius, blocks, 64, coordinates, close)


def near_groups(rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Fingerprint rows (doc_id, f, ...) with ``root``, the smallest fingerprint of their
    single-linkage group, and ``component_id``, the smallest doc_id in it."""
    firsts = rows.groupBy("f").agg(F.min("doc_id").alias("first"))
    groups = pivot_groups(firsts, radius, blocks)
    rooted = firsts.join(groups, "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("f", "root", "component_id"), "f")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, root, h), one row per input row; h is the text's hash.

    Null and empty texts have fingerprint zero and are linked like any other.  Rows without
    a doc_id get the smallest id of their group, or null if no member has one.  Repeated rows
    and equal texts share a fingerprint; other columns of ``docs`` are not read; an empty table
    gives an empty result.  Equal fingerprints are one node of the link graph, however many
    rows carry them.
    """
    rows, _ = Scratch(docs.sparkSession, "simhash").pin(fingerprints(docs, doc_id, text))
    found = near_groups(rows, radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id", "root", "h")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest (doc_id, text hash).

    Rows without an id are kept only where no member of their group has one.  All columns
    are kept as they are.
    """
    return one_of_each(docs, dedup(docs, doc_id, text, radius), doc_id, text)


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with the first row of each ``root`` of ``found`` (doc_id, h, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    best = found.groupBy("root").agg(F.min(order).alias("o"))
    keys = best.select(F.col("o.doc_id").alias("id"), F.col("o.h").alias("x"))
    whole = docs.select(F.struct("*").alias("whole"), F.col(doc_id).alias("own_id"), F.xxhash64(text).alias("own_h"))
    kept = whole.join(keys, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("x")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_h"]).select("whole.*")
