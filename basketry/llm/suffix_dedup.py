"""Removal of byte strings that occur again, by longest-previous-factor values of suffixes.

A byte position is repeated when the ``DEPTH`` bytes from it also start somewhere else.  In
the order of all suffixes, cut at that depth, equal strings are neighbours; a suffix's
previous and next smaller positions in that order are its earlier matches, so its longest
previous factor reaches the depth exactly when it is not the first of its run of neighbours.

Sorting every suffix of the corpus in one place is neither possible nor needed:

1. Every ``DEPTH``-byte string contains one anchor, its smallest hashed ``GRAM``-byte
   string.  Neighbouring positions with the same anchor form a run, about 185 positions long; the
   bytes that a run's strings touch are its region.  Equal strings have equal anchors, so
   only runs with the same anchor string can match.
2. Runs with equal regions are matched whole by a count; a region that occurs a million
   times is one row from here on.
3. Only anchors with several different regions need their suffixes sorted, and only one
   run per region takes part.  Tasks sort the suffixes of many anchors at a time.  An
   anchor with more than ``CROWD`` regions is not put into one task: its suffixes are
   matched by a distributed count over 128-bit hashes of their first ``DEPTH`` bytes.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Scratch

DEPTH = 400
GRAM = 32
CROWD = 5_000  # regions of an anchor that one task may sort, 4 MB at most
BLOCK = 1 << 22  # positions hashed at a time
BATCH = 40_000  # suffixes sorted at a time, if an anchor has no more of them
SORTED = 120_000  # suffixes compared byte by byte; more of one anchor by hashes of 128 bits
_PLACE = 24  # bits of a position in a block


def _u64(value: int) -> np.uint64:
    return np.uint64(value & (2**64 - 1))


_rng = random.Random(400)
_LETTER = np.array([_rng.getrandbits(64) for _ in range(256)], np.uint64)
_LETTER2 = np.array([_rng.getrandbits(64) for _ in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, _u64(base))
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[size] = tuple(tables)
    return _powers[size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _u64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _prefix(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=out[1:])
    return out


def _strings(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [start, end), equal for equal strings wherever they are."""
    _, down = _power_tables(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def _block_runs(data: np.ndarray, depth: int):
    n, width = len(data), depth - GRAM + 1
    prefix = _prefix(data, _LETTER)
    places = np.arange(n - GRAM + 1)
    grams = _mixed(_strings(prefix, places, places + GRAM))
    low = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | places.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    count = n - depth + 1
    low = np.minimum(low[:count], low[width - span : width - span + count])
    at = (low & _u64((1 << _PLACE) - 1)).astype(np.int64)
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = np.r_[0, cuts], np.r_[cuts - 1, count - 1]
    region = _strings(prefix, first, last + depth)
    region += (last - first).astype(np.uint64) * _u64(0xD6E8FEB86659FD93) + (at[first] - first).astype(np.uint64) * _u64(0xA5A3564E27F8862F)
    return first, last - first + 1, grams[at[first]].view(np.int64), _mixed(region).view(np.int64)


def runs(data: bytes, depth: int = DEPTH):
    """(first position, number of positions, anchor hash, region hash) of the text's runs, in order."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < depth:
        return (np.zeros(0, np.int64),) * 4
    parts = []
    for at in range(0, len(b) - depth + 1, BLOCK):
        first, size, key, region = _block_runs(b[at : at + BLOCK + depth - 1], depth)
        parts.append((first + at, size, key, region))
    return tuple(np.concatenate(x) for x in zip(*parts))


def anchors(docs: DataFrame, id_type: str, depth: int) -> DataFrame:
    """(id, h, key, region, s, w, n): a document's different regions, their first place and count."""

    def work(batches):
        for b in batches:
            owner, out = [], []
            for i, t in enumerate(b.column(2)):
                s, w, key, region = runs(t.as_py() or b"", depth)
                if len(s):
                    _, at, n = np.unique(region, return_index=True, return_counts=True)
                    owner.append(np.full(len(at), i))
                    out.append((key[at], region[at], s[at], w[at], n))
            if owner:
                take = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out))],
                                                 ["id", "h", "key", "region", "s", "w", "n"])

    return docs.mapInArrow(work, f"id {id_type}, h bigint, key bigint, region bigint, s bigint, w bigint, n bigint")


def suffix_runs(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of at least ``depth`` bytes in the order of their first ``depth`` bytes.

    Returns the string and the position of each, and the number of its run of neighbours that
    agree in these bytes.  More than ``SORTED`` suffixes are in the order of a hash of these
    bytes, which has the same runs in other places.
    """
    buffer = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(x) for x in strings], np.int64)
    counts = np.maximum(sizes - depth + 1, 0)
    owner = np.repeat(np.arange(len(strings)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(owner):
        return owner, place, owner
    begin = np.repeat(np.cumsum(sizes) - sizes, counts) + place
    if len(owner) > SORTED:
        one, two = (_mixed(_strings(_prefix(buffer, t), begin, begin + depth)) for t in (_LETTER, _LETTER2))
        order = np.lexsort((two, one))
        return owner[order], place[order], np.r_[0, np.cumsum((np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))]
    # Fixed strings of bytes are compared over their whole length.
    rows = np.lib.stride_tricks.sliding_window_view(buffer, depth)[begin].view(f"S{depth}").ravel()
    order = np.argsort(rows, kind="stable")
    differs = [rows[order[i + 1 : i + 4097]] != rows[order[i : i + 4096]][: len(order) - i - 1] for i in range(0, len(order) - 1, 4096)]
    run = np.cumsum(np.concatenate([[False], *differs]))
    return owner[order], place[order], run


def repeated(strings: list[bytes], copies: list[int], first_stays: bool, depth: int) -> list[list[int]]:
    """Positions of each string whose suffix is removed, strings being in corpus order.

    With ``first_stays`` those with an earlier match (longest previous factor of at least
    ``depth``); otherwise those with any other match, a string of several ``copies`` matching
    itself.
    """
    owner, place, run = suffix_runs(strings, depth)
    out: list[list[int]] = [[] for _ in strings]
    if not len(run):
        return out
    edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    if first_stays:
        rank = owner.astype(np.int64) << 32 | place
        least = np.minimum.reduceat(rank, edge)
        hit = rank != least[run]
    else:
        hit = np.add.reduceat(np.asarray(copies, np.int64)[owner], edge)[run] > 1
    for i, p in zip(owner[hit].tolist(), place[hit].tolist()):
        out[i].append(p)
    return out


def _ranges(places: list[int]) -> list[dict]:
    p = np.sort(np.asarray(places, np.int64))
    cut = np.flatnonzero(np.diff(p) > 1) + 1
    return [{"a": int(a), "b": int(b)} for a, b in zip(p[np.r_[0, cut]], p[np.r_[cut - 1, len(p) - 1]])]


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def sorted_matches(regions: DataFrame, id_type: str, first_stays: bool, depth: int) -> DataFrame:
    """(id, h, s, ranges): removed positions of each region, all regions of a key in one task."""

    def work(batches):
        def flush(rows):
            kept, last = [], None
            for r in rows:  # a repeated row gives its region twice
                if (r[0], r[1]) != last:
                    kept.append(r)
                last = (r[0], r[1])
            found = repeated([r[7] for r in kept], [r[2] for r in kept], first_stays, depth)
            out = [(r[3], r[4], r[5], _ranges(p)) for r, p in zip(kept, found) if p]
            cols = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "h", "s", "ranges"])

        rows: list[tuple] = []
        suffixes = 0
        for b in batches:
            kinds = [b.schema.field(3).type, pa.int64(), pa.int64(), _RANGES]
            for r in (r for at in range(0, b.num_rows, 500) for r in zip(*(c.to_pylist() for c in b.slice(at, 500).columns))):
                if suffixes >= BATCH and r[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, suffixes = [], 0
                rows.append(r)
                suffixes += r[6]
        if rows:
            yield flush(rows)

    dealt = regions.repartition("key").sortWithinPartitions("key", F.col("id").isNotNull(), "id", "h", "s", "region")
    return dealt.select("key", "region", "n", "id", "h", "s", "w", "bytes").mapInArrow(
        work, f"id {id_type}, h bigint, s bigint, ranges array<struct<a:bigint,b:bigint>>")


def counted_matches(regions: DataFrame, id_type: str, first_stays: bool, depth: int) -> DataFrame:
    """Like :func:`sorted_matches`, for anchors with any number of regions."""

    def work(batches):
        for b in batches:
            for n, key, h, s, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                x = np.frombuffer(data, np.uint8)
                at = np.arange(len(x) - depth + 1)
                one, two = (_mixed(_strings(_prefix(x, t), at, at + depth)).view(np.int64) for t in (_LETTER, _LETTER2))
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array([n] * m, pa.int64()), pa.array([key] * m, b.schema.field(1).type),
                     *(pa.array(np.full(m, v, np.int64)) for v in (h, s)), pa.array(at)], ["x", "y", "n", "id", "h", "s", "p"])

    rows = regions.select("n", "id", "h", "s", "bytes").distinct().mapInArrow(
        work, f"x bigint, y bigint, n bigint, id {id_type}, h bigint, s bigint, p bigint")
    rows, _ = Scratch(regions.sparkSession, "suffix-crowd").pin(rows)
    place = F.struct(F.col("id").isNotNull().alias("k"), "id", "h", "s", "p")
    groups = rows.groupBy("x", "y").agg(F.sum("n").alias("total"), F.min(place).alias("least")).filter("total > 1")
    found = rows.join(groups, ["x", "y"])
    if first_stays:
        found = found.filter(place != F.col("least"))
    listed = found.groupBy("id", "h", "s").agg(F.sort_array(F.collect_set("p")).alias("p"))
    return listed.select("id", "h", "s", F.transform("p", lambda x: F.struct(x.alias("a"), x.alias("b"))).alias("ranges"))


def removals(docs: DataFrame, id_type: str, first_stays: bool, depth: int) -> DataFrame:
    """(id, h, found): per document the regions removed whole, and the removed ranges of others."""
    scratch = Scratch(docs.sparkSession, "suffix")
    rows, _ = scratch.pin(anchors(docs, id_type, depth))
    place = F.struct(F.col("id").isNotNull().alias("k"), "id", "h", "s", "w")
    regions, _ = scratch.pin(rows.groupBy("key", "region").agg(F.sum("n").alias("n"), F.min(place).alias("first")))
    several = regions.groupBy("key").agg(F.count(F.lit(1)).alias("regions"), F.min("n").alias("fewest"))
    several = several.filter("regions > 1" if first_stays else "regions > 1 AND fewest = 1")
    part = regions.join(several.select("key", "regions"), "key").select("key", "region", "n", "regions", "first.*").drop("k")
    source = docs.withColumnsRenamed({"id": "__id", "h": "__h"})
    wanted = part.join(source, (F.col("h") == F.col("__h")) & F.col("id").eqNullSafe(F.col("__id")))
    cut = F.substring("bytes", (F.col("s") + 1).cast("int"), (F.col("w") + depth - 1).cast("int"))
    wanted, _ = scratch.pin(wanted.select("key", "region", "n", "id", "h", "s", "w", "regions", cut.alias("bytes")))
    partly = sorted_matches(wanted.filter(F.col("regions") <= CROWD), id_type, first_stays, depth).unionByName(
        counted_matches(wanted.filter(F.col("regions") > CROWD), id_type, first_stays, depth))
    many = regions.filter("n > 1").select("key", "region", "first")
    whole = rows.join(many, ["key", "region"])
    here = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    spared = F.when(here, F.col("first.s")).otherwise(F.lit(-1)) if first_stays else F.lit(-1)
    found = whole.select("id", "h", F.struct("region", spared.cast("bigint").alias("s"), F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("ranges")).alias("x"))
    found = found.union(partly.select("id", "h", F.struct(F.lit(None).cast("bigint").alias("region"), "s", "ranges").alias("x")))
    return found.groupBy("id", "h").agg(F.collect_list("x").alias("found"))


def covered(data: bytes, found: list[dict] | None, depth: int) -> np.ndarray:
    """Start and end, in pairs, of the maximal removed byte runs."""
    if not found:
        return np.zeros((0, 2), np.int64)
    s, w, _, region = runs(data, depth)
    whole = {x["region"]: x["s"] for x in found if x["region"] is not None}
    starts, ends = [], []
    for a, size, r in zip(s.tolist(), w.tolist(), region.tolist()):
        if whole.get(r, a) != a:
            starts.append(a)
            ends.append(a + size - 1 + depth)
    for x in found:
        for r in x["ranges"] or ():
            starts.append(x["s"] + r["a"])
            ends.append(x["s"] + r["b"] + depth)
    if not starts:
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    a, b = np.asarray(starts, np.int64)[order], np.maximum.accumulate(np.asarray(ends, np.int64)[order])
    fresh = np.r_[True, a[1:] > b[:-1]]
    return np.stack([a[fresh], b[np.r_[np.flatnonzero(fresh)[1:] - 1, len(b) - 1]]], axis=1)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "none", depth: int = DEPTH,
          with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per input row.

    ``keep``: "first" removes bytes covered by a ``depth``-byte string with an earlier match
    (documents in the order of id, nulls first, then of a hash of the text), "none" those
    with any other match.  Strings are judged on the input, matches may overlap, lie in one
    document, but never cross documents.  Null texts are empty; texts under ``depth`` bytes keep
    everything.  Rows equal in id and text are judged alike, with "first" as one document.
    Other columns are not read; an empty table gives an empty result.  ``kept`` is binary: a
    removed run may end inside a character.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    found = removals(rows, id_type, keep == "first", depth).withColumnsRenamed({"id": "__id", "h": "__h"})
    joined = rows.join(found, (F.col("h") == F.col("__h")) & F.col("id").eqNullSafe(F.col("__id")), "left").select("id", "bytes", "found")

    def work(batches):
        for b in batches:
            out = []
            for t, x in zip(b.column(1), b.column(2)):
                data = t.as_py()
                gone = covered(data, x.as_py(), depth)
                edges = [0, *gone.ravel().tolist(), len(data)]
                left = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2])) if len(gone) else data
                out.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if with_text else None))
            cols = list(zip(*out))
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())] if cols else None
            if arrays:
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    more = ", kept binary" if with_text else ""
    return joined.mapInArrow(work, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}")
