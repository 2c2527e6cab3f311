"""128-bit SimHash fingerprints of documents, with DataFrame functions only.

A term is a pair of neighbouring words (and the last word alone).  Its two 64-bit hashes vote
on the signed bits with the term's weight; a bit is set when the votes for it are more than
half of all.  The votes are counted two to a long: ``(hash >> j) & 0x0000000100000001`` holds
the bits j and j + 32, so 64 sums count all bits, exactly up to 2**30 terms in a text.

Fingerprints within a radius are found through permuted block tables: each choice of the
blocks that no differing bit touches is a table keyed by their bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import Scratch, words
from basketry.llm.hamming import distance, linked_groups

LANES = 32
MASK = 0x0000000100000001
HEAVY = 2
RADIUS = 3
BLOCKS = 5
ROWS_PER_RANGE = 4_000
MAX_RANGES = 65_536


def _half(total: str, counters: list[Column]) -> Column:
    """The bits whose counter is more than half of the total, as a long."""
    out = None
    for b, c in enumerate(counters):
        bit = F.when(2 * c > F.col(total), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, f (struct of w0, w1): the fingerprint of each row's whole text.

    ``keys`` identify a row.  A term with a word of over three characters weighs 2, another 1.
    No word at all gives zero.
    """
    w = words(F.col(text))
    terms = rows.select(*keys, F.explode_outer(F.arrays_zip(w.alias("a"), F.slice(w, 2, 1 << 30).alias("b"))).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    terms = terms.select(
        *keys,
        F.when(a.isNull(), 0).when((F.length(a) > 3) | (F.length(F.coalesce(b, F.lit(""))) > 3), HEAVY).otherwise(1).cast("long").alias("wt"),
        F.xxhash64(a, b).alias("h0"), F.xxhash64(F.lit(1), a, b).alias("h1"))
    lanes = [F.sum(F.shiftrightunsigned(f"h{i}", j).bitwiseAND(F.lit(MASK)) * F.col("wt")).alias(f"s{i}_{j}")
             for i in range(2) for j in range(LANES)]
    sums = terms.groupBy(*keys).agg(F.sum("wt").alias("total"), *lanes)

    def counter(i: int, bit: int) -> Column:
        lane = F.col(f"s{i}_{bit % LANES}")
        return F.shiftrightunsigned(lane, 32) if bit >= LANES else lane.bitwiseAND(F.lit(0xFFFFFFFF))

    halves = [_half("total", [counter(i, b) for b in range(64)]).alias(f"w{i}") for i in range(2)]
    return sums.select(*keys, F.struct(*halves).alias("f"))


def _ranges(ids: DataFrame) -> list[int]:
    """Ids that cut the ordered rows into ranges of about ``ROWS_PER_RANGE``; the first is the least."""
    n, least = ids.agg(F.count(F.lit(1)), F.min("id")).first()
    if not n:
        return []
    count = max(1, min(MAX_RANGES, n // ROWS_PER_RANGE))
    cuts = ids.agg(F.percentile_approx("id", [i / count for i in range(count)], max(10_000, 4 * count))).first()[0]
    return sorted({least, *cuts})


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are below or equal to the value, less one; looked up in two steps."""
    size = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    first = F.size(F.filter(longs([g[0] for g in groups]), lambda b: b <= value))
    return (first - 1) * size + F.size(F.filter(F.element_at(F.array(*map(longs, groups)), first), lambda b: b <= value)) - 1


def in_order(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, list[str]]:
    """Rows dealt into ranges of ascending id, with the columns of the order within a range.

    The first row of each range is also put at the end of the range before it (``copy`` 1),
    that of the first range at the end of the last (``copy`` 2): every row's successor is in
    its own range, and no task sees more than its range.
    """
    least = -(1 << 63)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(least)).alias("id"),
                       F.coalesce(text, F.lit("")).alias("text"))
    bounds = _ranges(rows.select("id"))
    if not bounds:
        bounds = [least]
    at = _range_of(F.col("id"), bounds)
    opens = F.col("id") == F.element_at(F.array(*(F.lit(x).cast("long") for x in bounds)), F.col("range") + 1)
    place = lambda r, c: F.struct(r.cast("int").alias("range"), F.lit(c).alias("copy"))
    before = F.when(F.col("range") > 0, place(F.col("range") - 1, 1)).otherwise(place(F.lit(len(bounds) - 1), 2))
    dealt = rows.withColumn("range", at).select(
        "doc_id", "id", "text",
        F.explode(F.when(opens, F.array(place(F.col("range"), 0), before)).otherwise(F.array(place(F.col("range"), 0)))).alias("p"))
    return dealt.select("doc_id", "id", "text", "p.*"), "range", ["copy", "id", "text"]


def with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its fingerprint f, that of its edited text, and that of the next row.

    The edited text has the last quarter of the characters replaced by the beginning of the
    next row's text; rows are ordered by (doc_id, text), null ids first, and the first
    follows the last.  Null texts count as empty; a single row is its own successor; an empty
    table gives an empty result.
    """
    dealt, part, order = in_order(docs, doc_id, text)
    w = Window.partitionBy(part).orderBy(*order)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = dealt.withColumns({"rn": F.row_number().over(w), "after": F.lead("text").over(w)})
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("after", F.lit(1), quarter))
    rows = rows.select(part, "copy", "rn", "doc_id", "text", n.cast("long").alias("n_chars"),
                       F.when(F.col("copy") == 0, edited).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    keys = [part, "copy", "rn", "doc_id", "n_chars", "edited_sha256"]
    sides = F.when(F.col("copy") == 0, F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    both = rows.select(*keys, F.explode(F.coalesce(sides, F.array(F.struct(F.lit(0).alias("side"), "text")))).alias("s")).select(*keys, "s.*")
    printed = simhash(both, [*keys, "side"], "text")
    each = printed.groupBy(*keys).agg(
        *(F.max(F.when(F.col("side") == s, F.col(f"f.w{i}"))).alias(f"{name}{i}") for s, name in ((0, "a"), (1, "b")) for i in range(2)))
    follow = Window.partitionBy(part).orderBy("copy", "rn")
    each = each.withColumns({f"c{i}": F.lead(f"a{i}").over(follow) for i in range(2)}).filter("copy = 0")
    pair = lambda x: F.struct(F.col(f"{x}0").alias("w0"), F.col(f"{x}1").alias("w1"))
    return each.select("doc_id", "n_chars", "edited_sha256", pair("a").alias("f"), pair("b").alias("e"), pair("c").alias("g"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1 - distance(a, b, 128) / 128.0


def hexed(f: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(f"{f}.w{i}")), 16, "0") for i in (1, 0)))


def near_ids(rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Rows (doc_id, f, ...) with ``near_id``: the smallest id reachable over distances up to ``radius``."""
    firsts = rows.groupBy("f").agg(F.min("doc_id").alias("first"))
    groups = linked_groups(firsts.select("f"), radius, blocks, 128)
    rooted = firsts.join(groups, "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = rooted.groupBy("root").agg(F.min("first").alias("near_id"))
    return rows.join(rooted.join(least, "root").select("f", "near_id"), "f")


def edited_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprints of :func:`with_edited` as text, their likeness, and each row's near group."""
    rows, _ = Scratch(docs.sparkSession, "fingerprints").pin(with_edited(docs, doc_id, text))
    return near_ids(rows).select(
        "doc_id", "n_chars", "edited_sha256", hexed("f").alias("fingerprint"), hexed("e").alias("edited_fingerprint"),
        likeness("f", "e").alias("near_edited"), likeness("f", "g").alias("near_next"), "near_id")
