"""Groups of fingerprints that are linked by a small Hamming distance."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Scratch
from basketry.llm.components import components


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def block_masks(width: int, blocks: int, radius: int) -> list[int]:
    """Masks of every choice of ``blocks - radius`` blocks.

    At most ``radius`` blocks can hold a differing bit, so two fingerprints within the
    radius agree on all bits of at least one of the masks.
    """
    bounds = [round(i * width / blocks) for i in range(blocks + 1)]
    part = [((1 << hi) - (1 << lo)) for lo, hi in zip(bounds, bounds[1:])]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def parts(f: str, width: int) -> list[Column]:
    """The 64-bit words of a fingerprint column: itself, or the fields w0, w1, ... of a struct."""
    return [F.col(f)] if width == 64 else [F.col(f"{f}.w{i}") for i in range(width // 64)]


def distance(a: str, b: str, width: int) -> Column:
    each = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(parts(a, width), parts(b, width))]
    return sum(each[1:], each[0])


def bucketed(prints: DataFrame, width: int, masks: list[int]) -> DataFrame:
    """One row per fingerprint and mask: table number t, masked words k0, k1, ..., f."""
    keys = []
    for no, mask in enumerate(masks):
        cut = [c.bitwiseAND(F.lit(signed((mask >> (64 * i)) & (2**64 - 1)))) for i, c in enumerate(parts("f", width))]
        keys.append(F.struct(F.lit(no).alias("t"), *(c.alias(f"k{i}") for i, c in enumerate(cut))))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "f").select("key.*", "f")


def linked_groups(prints: DataFrame, radius: int, blocks: int, width: int = 64,
                  coordinates: Callable[[Column], Column] | None = None,
                  close: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(f, root) for every fingerprint whose single-linkage group has a smaller member.

    ``prints``: distinct fingerprints ``f``.  ``coordinates`` computes a table entry once per
    row, ``close`` compares two entries and discards pairs before the exact distance.  The
    result is exactly the groups of the full link graph, without listing all pairs of a
    dense group:

    1. every bucket's members are compared with its smallest and largest member only, and
       the links found are contracted;
    2. buckets whose members are all in one group by now need no further pair; in the others,
       pairs of different groups are compared and only real links leave the join.
    """
    scratch = Scratch(prints.sparkSession, "hamming")
    entry = coordinates or (lambda f: F.lit(True))
    on = ["t", *(f"k{i}" for i in range(width // 64))]

    def near(a, b, ca, cb):
        exact = distance(a, b, width) <= radius
        return close(ca, cb) & exact if close else exact

    rows = bucketed(prints, width, block_masks(width, blocks, radius))
    shared = (rows.groupBy(*on).agg(F.min("f").alias("lo"), F.max("f").alias("hi")).filter("lo != hi")
              .withColumns({"clo": entry(F.col("lo")), "chi": entry(F.col("hi"))}))
    crowd, crowd_path = scratch.pin(rows.join(shared, on).withColumn("c", entry(F.col("f"))))
    ends = F.array(
        F.when((F.col("f") != F.col("lo")) & near("f", "lo", "c", "clo"), F.col("lo")),
        F.when((F.col("f") != F.col("hi")) & near("f", "hi", "c", "chi"), F.col("hi")))
    star = crowd.select("f", F.explode(F.array_compact(ends)).alias("g")).distinct()
    roots = components(star, "f", "g")
    named = (crowd.drop("lo", "hi", "clo", "chi").join(roots, F.col("f") == F.col("node"), "left")
             .select(*on, "f", "c", F.coalesce("root", "f").alias("g")))
    mixed = named.groupBy(*on).agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo != hi").select(*on)
    open_rows, open_path = scratch.pin(named.join(mixed, on, "left_semi"))
    scratch.drop(crowd_path)
    x = open_rows.withColumnsRenamed({"f": "x", "g": "gx", "c": "cx"})
    y = open_rows.withColumnsRenamed({"f": "y", "g": "gy", "c": "cy"})
    more = x.join(y, on).filter(F.col("gx") < F.col("gy")).filter(near("x", "y", "cx", "cy")).select("gx", "gy").distinct()
    tops = components(more, "gx", "gy").toDF("below", "top")
    scratch.drop(open_path)
    # Groups merged in the second step take the root of the merged group; its old root moves too.
    moved = roots.join(tops, F.col("root") == F.col("below"), "left").select(
        F.col("node").alias("f"), F.coalesce("top", "root").alias("root"))
    return moved.union(tops.toDF("f", "root")).distinct()
