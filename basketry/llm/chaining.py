"""Fuzzy repeated passages by collinear chaining of shared word k-mers.

1. Documents become chunks of some megabytes, in buckets of the chunk number.  Seeds are the
   ``K``-word strings with a certain bit of their hash, half of all, in every document alike.  A chunk sends its distinct seeds,
   packed by shard; the shard says which of them occur in several documents.
2. A repeated seed has a representative, its occurrence in the document with the smallest key.  A
   chunk offers its first occurrence, the shard takes the least of all chunks and tells every
   chunk that asked: one answer a chunk, however often a seed occurs.  So a passage in n
   documents gives n - 1 links per seed, never a pair of two copies, and no seed is hot.
3. The links of a document are chained per partner: runs of matches on one diagonal in ascending order on
   both sides, each match worth ``GAIN`` words less the gap cost.  A Fenwick tree over the
   partner's positions holds the best chain ends.
4. Chains are aligned: on one diagonal word by word, elsewhere by edit distance, and extended at
   both ends; passages with too few equal words or too low a share of them are dropped.
5. A representative may hide a passage: two documents may share one whose parts all have a third
   document in front.  So all pairs of documents that have two different seeds in common, in the same order
   and at most ``REACH`` words apart, neither of them covered by a passage in one of the two, are
   compared.  Groups of such a pair of seeds are dealt in blocks; the words around the seeds bound the
   equal words of a passage that begins and ends with them, and only pairs that can reach
   ``MIN_WORDS`` are chained and aligned.
"""

from __future__ import annotations

import heapq
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from basketry.llm.common import Scratch
from basketry.llm.packed import by_shard, pack, steps, unpack, unsteps
from basketry.storage import broadcast_if_small

K = 6
GAIN = 6.0
GAP = 0.1  # cost of a word skipped on either side
MIN_WORDS = 40
IDENTITY = 0.8
MARGIN = 32  # words searched beyond a chain's ends
MERGE = 16  # matches on one diagonal at most so many words apart are one run
CHUNK_BYTES = 4_000_000
CHUNKS_PER_SHARD = 4
CHUNK_DOCS = 20_000
REACH = 64  # words from one seed of a pair to the other
BLOCK = 32768  # occurrences of a pair of seeds that meet as many others in one group
TILE = 64, 4096  # of them, so many are compared with so many at once
SMALL = 32  # occurrences in a group up to which all pairs of them are listed
LISTED = 65_536  # pairs of occurrences listed, or matches sent, at once
SLICE = 4096  # seeds of a chunk whose pairs are formed at once
CHAINS_PER_TASK = 2000  # chains to one document that a task aligns
KEY_BITS = 48
CACHED_WORDS = 200_000
_rng = random.Random(6)
_FACTORS = np.array([_rng.getrandbits(64) | 1 for _ in range(K)], np.uint64)


class Hashes(dict):
    """Word to 64-bit hash; a bounded number of words is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 6)
        self[word] = h
        return h


_hashes = Hashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    found = (text or b"").lower().split()
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def seeds(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of a document's K-word strings whose hash has a certain bit unset."""
    n = len(w) - K + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = sum(w[i : i + n] * f for i, f in enumerate(_FACTORS))
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    at = np.flatnonzero(keys & np.uint64(1 << 8) == 0)
    return keys[at] >> np.uint64(64 - KEY_BITS), at


CHUNK = "chunk bigint, ds array<bigint>, ids array<{id}>, counts array<int>, keys binary, places binary, words binary"


def chunks(rows: DataFrame, id_type: str) -> DataFrame:
    """The words and seeds of up to ``CHUNK_BYTES`` bytes of text (or one longer document) from (d, doc_id, bytes).

    Texts are cut into words and hashed here only: ``keys`` and ``places`` (word numbers in the chunk) hold the seeds
    sorted by (key, document key, position), ``words`` 16 bits of every word's hash, for alignment.
    """

    def work(batches):
        from pyspark import TaskContext

        no, count, kinds = TaskContext.get().partitionId() << 32, 0, None
        held: list[tuple] = []

        def closed():
            ds, ids, words, keys, at = zip(*held)
            counts = [len(w) for w in words]
            begins = np.cumsum(counts) - counts
            sizes = [len(k) for k in keys]
            key, d = np.concatenate(keys), np.repeat(np.array(ds, np.int64), sizes)
            place = np.concatenate(at) + np.repeat(begins, sizes)
            order = np.lexsort((place, d, key))
            planes = place[order].astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
            cells = [no, list(ds), list(ids), counts, steps(key[order]), pack(planes), pack(np.concatenate(words))]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["chunk", "ds", "ids", "counts", "keys", "places", "words"])

        for b in batches:
            kinds = kinds or [pa.int64(), pa.list_(pa.int64()), pa.list_(b.schema.field(1).type), pa.list_(pa.int32()), *[pa.binary()] * 3]
            for d, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = t.as_py() or b""
                if held and (count + len(data) > CHUNK_BYTES or len(held) >= CHUNK_DOCS):
                    yield closed()
                    held, count, no = [], 0, no + 1
                w = word_hashes(data)
                held.append((d, key, (w >> np.uint64(48)).astype("<u2"), *seeds(w)))
                count += len(data)
        _hashes.clear()  # the worker lives on
        if held:
            yield closed()

    return rows.select("d", "doc_id", "bytes").mapInArrow(work, CHUNK.format(id=id_type))


class Chunk:
    """The unpacked seeds of a chunk, and its words where the row has them."""

    def __init__(self, row: dict):
        self.ds, self.ids = np.array(row["ds"], np.int64), row.get("ids")
        self.ends = np.cumsum(row["counts"])
        self.begins = self.ends - row["counts"]
        self.key = unsteps(row["keys"])
        place = unpack(row["places"], np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        self.doc = np.searchsorted(self.ends, place, side="right")
        self.pos = place - self.begins[self.doc] if len(place) else place
        self.first = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, np.int64)
        self.codes = self.key[self.first]
        self.words = unpack(row["words"], "<u2") if "words" in row else None

    def slice(self, doc: int, start: int, end: int) -> bytes:
        begin = self.begins[doc]
        return self.words[begin + start : min(begin + end, self.ends[doc])].tobytes()


def _cells(out: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


_SENT = ["shard", "chunk", "keys", "a", "b"]
_SENT_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
SENT = "shard bigint, chunk bigint, keys binary, a binary, b binary"


def _sent(chunk: int, codes: np.ndarray, shards: int, a: np.ndarray, b: np.ndarray | None = None) -> list[tuple]:
    """Sorted codes with one or two values each, packed by shard."""
    order, first, shard = by_shard(codes, shards)
    return [(s, chunk, steps(codes[o]), pack(a[o]), None if b is None else pack(b[o])) for s, o in zip(shard.tolist(), np.split(order, first[1:]))]


def chunk_keys(parts: DataFrame, shards: int) -> DataFrame:
    """The distinct seeds of each chunk, marked where several of its documents have them."""

    def work(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                c = Chunk(row)
                if len(c.codes):
                    last = np.r_[c.first[1:], len(c.key)] - 1
                    several = c.ds[c.doc[c.first]] != c.ds[c.doc[last]]
                    yield _cells(_sent(row["chunk"], c.codes, shards, several), _SENT, _SENT_KINDS)

    return bare_parts(parts).mapInArrow(work, SENT)


def bare_parts(parts: DataFrame) -> DataFrame:
    """Chunks without their words and ids."""
    return parts.drop("words", "ids")


def by_shards(sent: DataFrame, shards: int, answer) -> DataFrame:
    """``answer(rows)`` for the rows (chunk, keys, a, b) of each shard."""

    def work(batches):
        shard, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if held:
                        yield _cells(answer(shard, held), _SENT, _SENT_KINDS)
                    shard, held = row["shard"], []
                held.append(row)
        if held:
            yield _cells(answer(shard, held), _SENT, _SENT_KINDS)

    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(work, SENT)


def repeated(shard: int, rows: list[dict]) -> list[tuple]:
    """The seeds of each chunk that occur in several documents or chunks."""
    keys = [unsteps(r["keys"]) for r in rows]
    every = np.sort(np.concatenate(keys))
    again = every[1:][every[1:] == every[:-1]]
    marked = np.concatenate([k[unpack(r["a"], bool)] for k, r in zip(keys, rows)])
    return _wanted(shard, rows, keys, np.unique(np.concatenate([again, marked])))


def least(shard: int, rows: list[dict]) -> list[tuple]:
    """For the seeds that each chunk offers: document and position of the smallest offer of all chunks."""
    keys = [unsteps(r["keys"]) for r in rows]
    key, d, pos = (np.concatenate(x) for x in (keys, [unpack(r["a"], "<i8") for r in rows], [unpack(r["b"], "<i4") for r in rows]))
    order = np.lexsort((pos, d, key))
    key, d, pos = key[order], d[order], pos[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    at = [first[np.searchsorted(key[first], k)] for k in keys]
    return [(shard, r["chunk"], r["keys"], pack(d[i]), pack(pos[i])) for r, i in zip(rows, at)]


def covered(c: Chunk, passages: list[dict]) -> np.ndarray:
    """Which of the chunk's seeds lie in a passage (d, start, end) that is known already."""
    if not passages or not len(c.key):
        return np.zeros(len(c.key), bool)
    ds, of = np.unique(c.ds, return_inverse=True)
    d, start, end = (np.array([p[n] for p in passages], np.int64) for n in ("d", "start", "end"))
    at = np.minimum(np.searchsorted(ds, d), len(ds) - 1)
    known = ds[at] == d
    far = max(int(end.max()), int(c.pos.max()) + K) + 1  # the documents' words follow each other at this distance
    begin, until = (at * far + start)[known], (at * far + end)[known]
    order = np.argsort(begin)
    begin, until = begin[order], np.maximum.accumulate(until[order])
    place = of[c.doc] * far + c.pos
    last = np.searchsorted(begin, place, side="right")
    return np.r_[-1, until][last] >= place + K


def _answers(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """Seeds, sorted, with the documents and positions that answers name."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([unsteps(r["keys"]) for r in rows])
    d = np.concatenate([unpack(r["a"], "<i8") for r in rows])
    pos = np.concatenate([unpack(r["b"], "<i4") for r in rows]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], d[order], pos[order]


def _place(c: Chunk, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the seed among ``keys``, its place there) for all seeds of a chunk."""
    if not len(keys):
        return np.zeros(len(c.key), bool), np.zeros(len(c.key), np.int64)
    at = np.minimum(np.searchsorted(keys, c.key), len(keys) - 1)
    return keys[at] == c.key, at


_TOLD = "chunk bigint, kind int, keys binary, a binary, b binary, d bigint, start bigint, end bigint"


def _told(df: DataFrame, kind: int) -> DataFrame:
    """Rows of one ``kind`` for the chunks: 0 wanted seeds, 1 answers, 2 passages, 3 wanted pairs of seeds."""
    have = set(df.columns)
    cells = [F.lit(kind).alias("kind") if f.split()[0] == "kind" else F.col(f.split()[0]) if f.split()[0] in have
             else F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _TOLD.split(", ")]
    return df.select(*cells)


def with_chunks(parts: DataFrame, told: DataFrame, work, schema: str) -> DataFrame:
    """``work(chunk number, Chunk, rows by kind)`` gives a table, for every chunk that is told something."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds: dict[int, list[dict]] = {}
        for r in right.to_pylist():
            kinds.setdefault(r["kind"], []).append(r)
        for row in left.to_pylist():
            return pa.Table.from_batches([work(row["chunk"], Chunk(row) if kinds else None, kinds)])
        return pa.Table.from_batches([work(0, None, {})])

    return parts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


def offers(parts: DataFrame, told: DataFrame, shards: int) -> DataFrame:
    """Each chunk's smallest occurrence of its wanted seeds."""

    def work(no, c, kinds):
        out = []
        if kinds.get(0):
            able, _ = _place(c, _keys(kinds[0]))
            key, doc, pos = c.key[able], c.doc[able], c.pos[able]
            if len(key):
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                out = _sent(no, key[first], shards, c.ds[doc[first]].astype("<i8"), pos[first].astype("<i4"))
        return _cells(out, _SENT, _SENT_KINDS)

    return with_chunks(bare_parts(parts), told, work, SENT)


def _keys(rows: list[dict]) -> np.ndarray:
    return np.sort(np.concatenate([unsteps(r["keys"]) for r in rows]))


def bare_keys(parts: DataFrame, told: DataFrame, shards: int) -> DataFrame:
    """The wanted seeds of each chunk, marked where no passage covers one of their occurrences."""

    def work(no, c, kinds):
        out = []
        if kinds.get(0):
            able, _ = _place(c, _keys(kinds[0]))
            key, bare = c.key[able], ~covered(c, kinds.get(2, []))[able]
            if len(key):
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                out = _sent(no, key[first], shards, np.logical_or.reduceat(bare, first))
        return _cells(out, _SENT, _SENT_KINDS)

    return with_chunks(bare_parts(parts), told, work, SENT)


def bare_somewhere(shard: int, rows: list[dict]) -> list[tuple]:
    """The seeds of each chunk that lie outside all passages in some chunk."""
    keys = [unsteps(r["keys"]) for r in rows]
    wanted = np.unique(np.concatenate([k[unpack(r["a"], bool)] for k, r in zip(keys, rows)]))
    return _wanted(shard, rows, keys, wanted)


def _wanted(shard: int, rows: list[dict], keys: list[np.ndarray], wanted: np.ndarray) -> list[tuple]:
    return [(shard, r["chunk"], steps(k), None, None) for r, k in ((r, np.intersect1d(k, wanted, assume_unique=True)) for r, k in zip(rows, keys)) if len(k)]


def seed_pairs(c: Chunk, keys: np.ndarray, passages: list[dict]):
    """(pair, document, position, words to the second seed, outside all passages, prior, later), sorted, of the pairs of
    different seeds among ``keys``, for ``SLICE`` first seeds at a time; of the places of a second seed the nearest.  ``prior``
    and ``later`` name the seed before and behind with its distance, or are 0 where it makes no longer pair within one run
    (``MERGE`` words) with the other end."""
    able, _ = _place(c, keys)
    at = np.flatnonzero(able)
    at = at[np.lexsort((c.pos[at], c.doc[at]))]
    key, doc, pos, bare = c.key[at], c.doc[at], c.pos[at], ~covered(c, passages)[at]
    once = np.zeros(len(at), bool)
    order = np.lexsort((doc, key))
    new = np.r_[True, (np.diff(key[order]) != 0) | (np.diff(doc[order]) != 0), True]
    once[order] = new[:-1] & new[1:] if len(at) else False
    step = np.r_[np.where(np.diff(doc) == 0, np.diff(pos), 2 * REACH), 2 * REACH] if len(at) else np.zeros(0, np.int64)  # words to the next seed
    for lo in range(0, len(at), SLICE):
        found = []
        for lag in range(1, REACH + 1):
            i = np.arange(lo, min(lo + SLICE, len(at) - lag))
            i = i[(doc[i + lag] == doc[i]) & (pos[i + lag] - pos[i] <= REACH)]
            if not len(i):
                break
            i = i[key[i + lag] != key[i]]
            pair = (key[i] * _FACTORS[0] + key[i + lag] * _FACTORS[1]) * np.uint64(0x9FB21C651E98DF25)
            far, both = pos[i + lag] - pos[i], bare[i] & bare[i + lag]
            before, behind = np.maximum(i - 1, 0), np.minimum(i + lag + 1, len(key) - 1)
            gap, gap_behind = np.where(i > 0, step[before], 2 * REACH), step[i + lag]
            longer = (far + gap <= MERGE) & (bare[before] | ~both) & (key[before] != key[i + lag])
            prior = np.where(longer, _named(key[before], gap), 0)
            longer = (far + gap_behind <= MERGE) & (bare[behind] | ~both) & (key[behind] != key[i]) & once[behind]
            later = np.where(longer, _named(key[behind], gap_behind), 0)
            found.append((pair ^ (pair >> np.uint64(32)), doc[i], pos[i], far, both, prior, later))
        if not found:
            continue
        pair, doc_, pos_, far, both, prior, later = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((far, pos_, doc_, pair))
        new = np.flatnonzero(_changes(pair[order], doc_[order], pos_[order]))
        yield tuple(x[order][new] for x in (pair, doc_, pos_, far, both, prior, later))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    return np.r_[True, np.any([np.diff(x) != 0 for x in columns], axis=0)][: len(columns[0])]


def _named(key: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """A seed and its distance as one number over 0."""
    return (key.astype(np.int64) << 8 | gap) + 1


def pair_keys(parts: DataFrame, told: DataFrame, shards: int) -> DataFrame:
    """The distinct pairs of seeds of each chunk, marked where several documents have them, and where one has them bare."""

    def work(no, c, kinds):
        out, some = [], []
        for pair, doc, _, _, bare, *_ in seed_pairs(c, _keys(kinds[0]), kinds.get(2, [])) if kinds.get(0) else ():
            first = np.flatnonzero(_changes(pair))
            last = np.r_[first[1:], len(pair)] - 1
            if len(pair):
                some.append((pair[first], doc[first], doc[last], np.logical_or.reduceat(bare, first)))
        if some:
            pair, low, high, bare = (np.concatenate(x) for x in zip(*some))
            order = np.argsort(pair, kind="stable")
            pair, low, high, bare = pair[order], low[order], high[order], bare[order]
            first = np.flatnonzero(_changes(pair))
            last = np.r_[first[1:], len(pair)] - 1
            out = _sent(no, pair[first], shards, c.ds[low[first]] != c.ds[high[last]], np.logical_or.reduceat(bare, first))
        return _cells(out, _SENT, _SENT_KINDS)

    return with_chunks(bare_parts(parts), told, work, SENT)


def repeated_bare(shard: int, rows: list[dict]) -> list[tuple]:
    """The pairs of seeds of each chunk that several documents or chunks have, one of them bare."""
    keys = [unsteps(r["keys"]) for r in rows]
    every = np.sort(np.concatenate(keys))
    again = every[1:][every[1:] == every[:-1]]
    several, bare = (np.concatenate([k[unpack(r[n], bool)] for k, r in zip(keys, rows)]) for n in ("a", "b"))
    return _wanted(shard, rows, keys, np.intersect1d(np.concatenate([again, several]), bare))


def around(c: Chunk, doc: np.ndarray, pos: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8 bits of the ``MARGIN`` words before and after each pair of seeds, 0 beyond the text, and how many lie beyond."""
    begin, end = c.begins[doc], c.ends[doc]
    left, right = (begin + pos)[:, None] - np.arange(MARGIN, 0, -1), (begin + pos + far + K)[:, None] + np.arange(MARGIN)
    at = np.hstack([left, right])
    inside = (at >= begin[:, None]) & (at < end[:, None])
    words = np.where(inside, c.words[np.where(inside, at, 0)] & 0xFF, 0).astype(np.uint8)
    beyond = (~inside).reshape(len(at), 2, MARGIN).sum(2)
    return words, beyond[:, 0], beyond[:, 1]


PLACED = "pair bigint, d bigint, pos int, far int, bare boolean, prior bigint, later bigint, words binary, before int, after int"


_PLACED = np.dtype([("pair", "<i8"), ("d", "<i8"), ("far", "<i4"), ("bare", "?"), ("prior", "<i8"), ("later", "<i8"), ("words", f"V{2 * MARGIN}"),
                    ("before", "<i4"), ("after", "<i4"), ("pos", "<i4")])


def pair_rows(parts: DataFrame, told: DataFrame) -> DataFrame:
    """The occurrences of the wanted pairs of seeds; in a document those with the same words around are one."""

    def work(no, c, kinds):
        some = [np.zeros(0, _PLACED)]
        if kinds.get(3):
            asked = _keys(kinds[3])
            for found in seed_pairs(c, _keys(kinds[0]), kinds.get(2, [])):
                wanted = np.flatnonzero(np.isin(found[0], asked))
                for at in np.split(wanted, range(LISTED // 16, len(wanted), LISTED // 16)):
                    pair, doc, pos, far, bare, prior, later = (x[at] for x in found)
                    words, before, after = around(c, doc, pos, far)
                    rows = np.zeros(len(at), _PLACED)
                    cells = [pair.view(np.int64), c.ds[doc], far, bare, prior, later, words.view(f"V{2 * MARGIN}").ravel(), before, after, pos]
                    for name, x in zip(_PLACED.names, cells):
                        rows[name] = x
                    some.append(_distinct(rows))
        rows = _distinct(np.concatenate(some))
        words = pa.Array.from_buffers(pa.binary(), len(rows), [None, *map(pa.py_buffer, (np.arange(len(rows) + 1, dtype=np.int32) * 2 * MARGIN, rows["words"].tobytes()))])
        names = [f.split()[0] for f in PLACED.split(", ")]
        return pa.RecordBatch.from_arrays([words if n == "words" else pa.array(np.ascontiguousarray(rows[n])) for n in names], names)

    return with_chunks(parts, told, work, PLACED)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Of rows that agree in all but ``pos``, which comes last, the one with the smallest."""
    wide = rows.dtype.itemsize - 4
    same = np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), wide + 4)[:, :wide]).view(f"V{wide}").ravel()
    order = np.argsort(rows["pos"], kind="stable")
    return rows[order[np.unique(same[order], return_index=True)[1]]]


def whole_groups(batches, names: list[str]):
    """Tables of whole groups of rows equal in ``names``, for batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(n).to_numpy() for n in names]
        new = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        if held and any(held[-1].column(n)[-1].as_py() != b.column(n)[0].as_py() for n in names):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, b.slice(0, int(new[-1]))])
            held = []
            b = b.slice(int(new[-1]))
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _meet(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows (i, j) with enough equal words those of two documents, one of them outside all passages, that make no
    longer pair with the seed beside."""
    able = (t["bare"][i] | t["bare"][j]) & (t["d"][i] != t["d"][j])
    for n in ("prior", "later"):
        able &= (t[n][i] != t[n][j]) | (t[n][i] == 0)
    return i[able], j[able]


def _meeting(t: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, same: bool):
    """Rows of ``left`` and ``right`` whose pairs of seeds may begin and end one passage, a tile at a time; ``same`` if they are the same rows."""
    rows, columns = TILE
    for to in range(0, len(right), columns):
        other = right[to : to + columns]
        v = np.ascontiguousarray(t["words"][other].T)
        for lo in range(0, min(len(left), to + columns) if same else len(left), rows):
            one = left[lo : lo + rows]
            u = t["words"][one]
            equal, hit = np.zeros((len(one), len(other)), np.uint8), np.empty((len(one), len(other)), bool)
            for k in range(2 * MARGIN):
                np.equal(u[:, k, None], v[k], out=hit)
                equal += hit.view(np.uint8)
            for n in ("before", "after"):  # nothing on both sides is not an equal word
                equal -= np.minimum(t[n][one, None], t[n][None, other])
            equal += np.minimum(t["far"][one, None], t["far"][None, other])
            i, j = np.nonzero(equal >= MIN_WORDS - K)
            if same:
                i, j = i[lo + i < to + j], j[lo + i < to + j]
            if len(i):
                yield _meet(t, one[i], other[j])


def _listed(t: dict[str, np.ndarray], at: np.ndarray, ends: np.ndarray):
    """What :func:`_meeting` gives, of all pairs of rows in each of many small groups; ``ends`` are those of the rows' groups."""
    behind = ends - at - 1  # rows of the group that follow
    for lo in range(0, len(at), LISTED // SMALL):
        few = slice(lo, lo + LISTED // SMALL)
        i = np.repeat(at[few], behind[few])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind[few]) - behind[few], behind[few])
        equal = (t["words"][i] == t["words"][j]).sum(1, dtype=np.uint8)
        for n in ("before", "after"):
            equal -= np.minimum(t[n][i], t[n][j])
        able = equal + np.minimum(t["far"][i], t["far"][j]) >= MIN_WORDS - K
        yield _meet(t, i[able], j[able])


def _most(t: dict[str, np.ndarray], at: np.ndarray):
    """Tells which rows have the seed before, or behind, that most rows of ``at`` have."""
    best = (0, "prior", 0)
    for n in ("prior", "later"):
        names, count = np.unique(t[n][at], return_counts=True)
        count[names == 0] = 0
        best = max(best, (int(count.max()), n, int(names[count.argmax()])))
    _, name, value = best
    return lambda rows: (t[name][rows] == value) & (value != 0)


def _met(t: dict[str, np.ndarray]):
    """Pairs of rows that meet in their groups (pair, x, y), in pieces."""
    first = np.flatnonzero(_changes(t["pair"], t["x"], t["y"]))
    sizes = np.diff(np.r_[first, len(t["pair"])])
    small = (sizes <= SMALL) & (t["x"][first] == t["y"][first])
    listed = np.flatnonzero(np.repeat(small, sizes))
    yield from _listed(t, listed, np.repeat(first + sizes, sizes)[listed])
    for at in (f + np.arange(n) for f, n in zip(first[~small].tolist(), sizes[~small].tolist())):
        x, y = t["x"][at[0]], t["y"][at[0]]
        most = _most(t, at)  # rows that need not meet each other
        sides = [at] if x == y else [at[t["block"][at] == x], at[t["block"][at] == y]]
        left, right = ((side[~most(side)], side[most(side)]) for side in (sides[0], sides[-1]))
        meet = [(left[0], left[0], True), (left[0], left[1], False)]
        if x != y:
            meet = [(left[0], right[0], False), (left[0], right[1], False), (left[1], right[0], False)]
        for one, other, same in meet:
            yield from _meeting(t, one, other, same)


def matches(placed: DataFrame) -> DataFrame:
    """(d, r, pos, rpos) of the pairs of seeds that two documents share, the smaller one as ``r``.  A place holds both seeds of
    its pair: 256 times the first one's position and the words to the second.

    The occurrences of a pair of seeds are dealt in blocks of some ``BLOCK``; each two blocks meet in a group of their own.
    What meets is sent in pieces, so that a task holds its groups' occurrences but not all that meet.
    """
    counts = placed.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    crowded = broadcast_if_small(counts.select("pair", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = placed.join(crowded, "pair", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("d", "pos", F.lit(22)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("pair", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block",
                       "d", "pos", "far", "bare", "prior", "later", "words", "before", "after")

    def sent(t, pieces):
        i, j = (np.concatenate(side) for side in zip(*pieces))
        i, j = np.where(t["d"][i] > t["d"][j], i, j), np.where(t["d"][i] > t["d"][j], j, i)
        for lo in range(0, len(i), LISTED):
            a, b = i[lo : lo + LISTED], j[lo : lo + LISTED]
            cells = [t["d"][a], t["d"][b], *(t["pos"][x].astype(np.int64) << 8 | t["far"][x] for x in (a, b))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["d", "r", "pos", "rpos"])

    def work(batches):
        for table in whole_groups(batches, ["pair", "x", "y"]):
            t = {n: table.column(n).to_numpy() for n in ("pair", "x", "y", "block", "d", "pos", "far", "bare", "prior", "later")}
            t |= {n: t[n].astype(np.uint8) if n in t else table.column(n).to_numpy().astype(np.uint8) for n in ("far", "before", "after")}
            t["words"] = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint8).reshape(-1, 2 * MARGIN)
            pieces, held = [], 0
            for piece in _met(t):
                pieces.append(piece)
                held += len(piece[0])
                if held >= LISTED:
                    yield from sent(t, pieces)
                    pieces, held = [], 0
            if held:
                yield from sent(t, pieces)

    dealt = rows.repartition("pair", "x", "y").sortWithinPartitions("pair", "x", "y")
    return dealt.mapInArrow(work, "d bigint, r bigint, pos bigint, rpos bigint")


def chained_matches(found: DataFrame) -> DataFrame:
    """Chains of the matches of each two documents."""
    places, names = pa.list_(pa.int32()), ["chunk", "d", "r", "at", "rat", "a", "b", "ra", "rb"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), places, places, *[pa.int32()] * 4]

    def work(batches):
        for table in whole_groups(batches, ["d", "r"]):
            d, r, pos, rpos = (table.column(n).to_numpy() for n in ("d", "r", "pos", "rpos"))
            both = (np.concatenate([x >> 8, (x >> 8) + (x & 255)]) for x in (pos, rpos))
            runs = match_runs(np.tile(d, 2), np.tile(r, 2), *both)
            out = [(0, d, r, *_span(chain)) for d, r, chain in _run_chains(runs) if _roomy(chain)]
            yield _cells(out, names, kinds)

    schema = "chunk bigint, d bigint, r bigint, at array<int>, rat array<int>, a int, b int, ra int, rb int"
    return found.repartition("d", "r").sortWithinPartitions("d", "r").mapInArrow(work, schema)


def word_rows(parts: DataFrame, id_type: DataType) -> DataFrame:
    """(d, doc_id, words) of the documents of all chunks."""
    kinds = [pa.int64(), to_arrow_type(id_type), pa.binary()]

    def work(batches):
        for b in batches:
            for ds, ids, counts, blob in zip(*(c.to_pylist() for c in b.columns)):
                words, ends = unpack(blob, "<u2"), np.cumsum(counts).tolist()
                yield _cells([(d, i, words[e - n : e].tobytes()) for d, i, n, e in zip(ds, ids, counts, ends)], ["d", "doc_id", "words"], kinds)

    return parts.select("ds", "ids", "counts", "words").mapInArrow(work, f"d bigint, doc_id {id_type.simpleString()}, words binary")


def words_of(words: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of :func:`word_rows` of the documents ``d`` that are named; rows equal in id and text are one document."""
    return words.join(broadcast_if_small(named.distinct()), "d", "left_semi").dropDuplicates(["d"])


class Fenwick:
    """Largest (value, index) of a prefix of positions."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, at: int, value: float, index: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, index)
            at += at & -at

    def below(self, at: int) -> tuple[float, int]:
        """Over positions smaller than ``at``."""
        found = (float("-inf"), -1)
        while at > 0:
            if self.best[at][0] > found[0]:
                found = self.best[at]
            at -= at & -at
        return found


def chain_runs(p0: list[int], r0: list[int], p1: list[int], r1: list[int], worth: list[float]) -> list[list[int]]:
    """Disjoint chains of runs, sorted by p0, from (p0, r0) to (p1, r1); both sides ascend in each chain."""
    rank = {r: i for i, r in enumerate(sorted(set(r1)))}
    ends = sorted(rank)
    tree, score, before = Fenwick(len(rank)), [0.0] * len(p0), [-1] * len(p0)
    waiting: list[tuple[int, int]] = []  # runs that have not ended before the present one begins
    for i, (p, r) in enumerate(zip(p0, r0)):
        while waiting and waiting[0][0] < p:
            _, j = heapq.heappop(waiting)
            tree.put(rank[r1[j]], score[j] + GAP * (p1[j] + r1[j]), j)
        value, j = tree.below(int(np.searchsorted(ends, r)))
        gained = value - GAP * (p + r)
        score[i], before[i] = (worth[i] + gained, j) if j >= 0 and gained > 0 else (worth[i], -1)
        heapq.heappush(waiting, (p1[i], i))
    used, out = [False] * len(p0), []
    for i in sorted(range(len(p0)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def chains(pos: list[int], rep: list[int]) -> list[list[int]]:
    """Disjoint chains of the matches (pos[i], rep[i]), sorted by pos."""
    return chain_runs(pos, rep, pos, rep, [GAIN] * len(pos))


def match_runs(doc: np.ndarray, r: np.ndarray, pos: np.ndarray, rpos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, r, p0, r0, p1, r1, worth) of the runs of matches on one diagonal, sorted by (doc, r, p0)."""
    order = np.lexsort((pos, rpos - pos, r, doc))
    order = order[_changes(doc[order], r[order], pos[order], rpos[order])]  # a match counts once
    doc, r, pos, rpos = doc[order], r[order], pos[order], rpos[order]
    new = (np.diff(doc) != 0) | (np.diff(r) != 0) | (np.diff(rpos - pos) != 0) | (np.diff(pos) > MERGE)
    first = np.flatnonzero(np.r_[True, new])
    last = np.r_[first[1:], len(pos)] - 1
    worth = GAIN * (last - first + 1) - 2 * GAP * (pos[last] - pos[first])
    found = (doc[first], r[first], pos[first], rpos[first], pos[last], rpos[last], worth)
    order = np.lexsort((rpos[first], pos[first], r[first], doc[first]))
    return tuple(x[order] for x in found)


_CHAINS = ["chunk", "d", "doc_id", "r", "at", "rat", "a", "ra", "rb", "x"]


def chain_table(parts: DataFrame, told: DataFrame, id_type: DataType) -> DataFrame:
    """Chains of the links to the documents that the answers name, with the words of their own side."""

    def work(no, c, kinds):
        out = []
        keys, d, rpos = _answers(kinds.get(1) or [])
        if c is not None and len(keys):
            known, at = _place(c, keys)
            linked = np.flatnonzero(known & (c.ds[c.doc] != d[at]))
            if len(linked):
                runs = match_runs(c.doc[linked], d[at[linked]], c.pos[linked], rpos[at[linked]])
                out = [_chain_row(no, c, doc, r, chain) for doc, r, chain in _run_chains(runs) if _roomy(chain)]
        return _cells(out, _CHAINS, kinds_of_columns)

    places = pa.list_(pa.int32())
    kinds_of_columns = [pa.int64(), pa.int64(), to_arrow_type(id_type), pa.int64(), places, places, pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return with_chunks(parts, told, work, f"chunk bigint, d bigint, doc_id {id_type.simpleString()}, r bigint, at array<int>, rat array<int>, a int, ra int, rb int, x binary")


def _run_chains(runs: tuple[np.ndarray, ...]):
    """(doc, r, runs of the chain) for the chains of each two documents."""
    cut = np.flatnonzero((np.diff(runs[0]) != 0) | (np.diff(runs[1]) != 0)) + 1
    doc, r, p0, r0, p1, r1, worth = (x.tolist() for x in runs)
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)]):
        many = hi > lo + 1
        for chain in chain_runs(p0[lo:hi], r0[lo:hi], p1[lo:hi], r1[lo:hi], worth[lo:hi]) if many else [[0]]:
            yield doc[lo], r[lo], [(p0[lo + i], r0[lo + i], p1[lo + i], r1[lo + i]) for i in chain]


def _roomy(runs: list[tuple]) -> bool:
    """Whether a chain may hold a passage: one that has a second match."""
    return len(runs) > 1 or runs[0][0] != runs[0][2]


def _span(runs: list[tuple]) -> tuple:
    """Seeds on both sides, and the begin and end of the words to align, of a chain."""
    at, rat = ([v for run in runs for v in ((run[i], run[i + 2]) if run[0] != run[2] else (run[i],))] for i in (0, 1))
    return at, rat, max(0, at[0] - MARGIN), at[-1] + K + MARGIN, max(0, rat[0] - MARGIN), rat[-1] + K + MARGIN


def _chain_row(no: int, c: Chunk, doc: int, r: int, runs: list[tuple]) -> tuple:
    at, rat, a, b, ra, rb = _span(runs)
    return no, int(c.ds[doc]), c.ids[doc], r, at, rat, a, ra, rb, c.slice(doc, a, b)


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two short sequences, a row at a time."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, x in enumerate(a, 1):
        new = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (b != x))]
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def _extent(same: np.ndarray) -> int:
    """How far to extend over a run of equal and unequal words: equal 1, unequal -2."""
    if not len(same):
        return 0
    total = np.cumsum(np.where(same, 1, -2))
    best = int(total.argmax())
    return best + 1 if total[best] > 0 else 0


def align(x: np.ndarray, y: np.ndarray, at: list[int], rat: list[int]) -> tuple[int, int, int, int, int]:
    """Start and end on both sides and the number of equal words, for slices and seeds in them."""
    matches, p, q = 0, at[0], rat[0]
    for s, t in zip(at[1:], rat[1:]):
        if s - p == t - q:
            matches += int((x[p:s] == y[q:t]).sum())
        elif s - p <= K and t - q <= K:  # overlapping seeds off the diagonal
            matches += min(s - p, t - q)
        else:
            u, v = x[p + K : s], y[q + K : t]
            over = max(0, K - min(s - p, t - q))
            matches += K - over + max(0, max(len(u), len(v)) - edits(u, v))
        p, q = s, t
    matches += K
    left = min(at[0], rat[0])
    before = _extent(x[at[0] - left : at[0]][::-1] == y[rat[0] - left : rat[0]][::-1])
    right = min(len(x) - p - K, len(y) - q - K)
    after = _extent(x[p + K : p + K + right] == y[q + K : q + K + right])
    matches += int((x[at[0] - before : at[0]] == y[rat[0] - before : rat[0]]).sum())
    matches += int((x[p + K : p + K + after] == y[q + K : q + K + after]).sum())
    return at[0] - before, p + K + after, rat[0] - before, q + K + after, matches


def aligned(pairs: DataFrame, id_type: str) -> DataFrame:
    """Passages from chains with the word slices ``x`` and ``y`` of both sides."""

    def work(batches):
        for b in batches:
            out = []
            for chunk, d, doc, r, rep, at, rat, a, ra, x, y in zip(*(c.to_pylist() for c in b.columns)):
                x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
                s, e, rs, re_, n = align(x, y, [i - a for i in at], [i - ra for i in rat])
                share = n / max(e - s, re_ - rs, 1)
                if n >= MIN_WORDS and share >= IDENTITY:
                    out.append((chunk, d, doc, s + a, e + a, r, rep, rs + ra, re_ + ra, n, share))
            kinds = [pa.int64(), pa.int64(), b.schema.field(2).type, *[pa.int64()] * 3, b.schema.field(4).type, *[pa.int64()] * 3, pa.float64()]
            yield _cells(out, ["chunk", "d", "doc_id", "start", "end", "r", "rep_doc_id", "rep_start", "rep_end", "equal_words", "identity"], kinds)

    return pairs.mapInArrow(work, f"chunk bigint, d bigint, doc_id {id_type}, start bigint, end bigint, r bigint, rep_doc_id {id_type}, rep_start bigint, "
                                  "rep_end bigint, equal_words bigint, identity double")


def beside(chained: DataFrame, words: DataFrame, key: str = "r", doc: str = "rep_doc_id", begin: str = "ra", end: str = "rb", out: str = "y") -> DataFrame:
    """Chains with the id ``doc`` and the words ``out`` of the document ``key``, their representative.

    The words of a document that has many chains are sent to one task for each
    ``CHAINS_PER_TASK`` of them.
    """
    counts = chained.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHAINS_PER_TASK)
    crowded = counts.select(key, F.ceil(F.col("n") / CHAINS_PER_TASK).cast("int").alias("tasks"))
    crowded = broadcast_if_small(crowded)  # a row for each CHAINS_PER_TASK chains at most
    other = words.select(F.col("d").alias(key), F.col("doc_id").alias(doc), "words").join(crowded, key, "left")
    other = other.withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    mine = chained.join(crowded, key, "left")
    spread = F.xxhash64("d", "r", F.lit(21)) if key == "d" else F.xxhash64("d", F.lit(21))
    mine = mine.withColumn("task", F.coalesce(F.pmod(spread, F.col("tasks")), F.lit(0)).cast("int")).drop("tasks")
    slice_ = F.substring("words", (2 * F.col(begin) + 1).cast("int"), (2 * (F.col(end) - F.col(begin))).cast("int"))
    return mine.join(other, [key, "task"]).withColumn(out, slice_).drop("words", "task")


_PAIRS = ["chunk", "d", "doc_id", "r", "rep_doc_id", "at", "rat", "a", "ra", "x", "y"]


def hidden(scratch: Scratch, parts: DataFrame, words: DataFrame, wanted: DataFrame, found: DataFrame, shards: int, id_type: str) -> DataFrame:
    """Passages of documents whose seeds have representatives that share no passage with them: all pairs are compared."""
    where = parts.select("chunk", F.explode("ds").alias("d"))
    ends = found.select(F.col("r").alias("d"), F.col("rep_start").alias("start"), F.col("rep_end").alias("end")).distinct().join(where, "d")
    known = _told(found, 2).unionByName(_told(ends, 2))
    bare, _ = scratch.pin(by_shards(bare_keys(parts, _told(wanted, 0).unionByName(known), shards), shards, bare_somewhere))
    told = _told(bare, 0).unionByName(known)
    pairs, _ = scratch.pin(by_shards(pair_keys(parts, told, shards), shards, repeated_bare))
    placed, _ = scratch.pin(pair_rows(parts, told.unionByName(_told(pairs, 3))))
    chained, _ = scratch.pin(chained_matches(matches(placed)))
    words, _ = scratch.pin(words_of(words, chained.select("d").union(chained.select("r"))))
    both = beside(beside(chained, words, "d", "doc_id", "a", "b", "x"), words)
    return scratch.pin(aligned(both.select(*_PAIRS), id_type).distinct())[0]


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, rep_doc_id, rep_start, rep_end, equal_words, identity), in words.

    A row per repeated passage and its match in a representative document, and one for
    each passage of a representative itself (both sides equal).  Words are compared in
    lower case (A-Z).  Only repeats across documents count.  Null, empty and short texts give no
    row.  Rows equal in id and text are one document; a null id stays null; other
    columns are not read; an empty table gives an empty result.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "chaining")
    rows = docs.select(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).alias("d"),
                       F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("bytes"))
    smallest = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, name, path = scratch.table(chunks(rows, id_type), "chunk", max(smallest, docs.rdd.getNumPartitions()))
    shards = max(smallest, parts.count() // CHUNKS_PER_SHARD)
    wanted, wanted_path = scratch.pin(by_shards(chunk_keys(parts, shards), shards, repeated))
    words = word_rows(parts, docs.schema[doc_id].dataType)
    answers, _ = scratch.pin(by_shards(offers(parts, _told(wanted, 0), shards), shards, least))
    chained, _ = scratch.pin(chain_table(parts, _told(answers, 1), docs.schema[doc_id].dataType))
    reps = words_of(words, chained.select(F.col("r").alias("d")))
    found, _ = scratch.pin(aligned(beside(chained, reps).select(*_PAIRS), id_type).distinct())
    out = found.unionByName(hidden(scratch, parts, words, wanted, found, shards, id_type))
    scratch.drop(wanted_path)
    scratch.drop_table(name, path)
    rows = out.drop("chunk", "d", "r").distinct()
    own = rows.select(F.col("rep_doc_id").alias("doc_id"), F.col("rep_start").alias("start"), F.col("rep_end").alias("end"), "rep_doc_id",
                      "rep_start", "rep_end", (F.col("rep_end") - F.col("rep_start")).alias("equal_words"), F.lit(1.0).alias("identity"))
    return rows.unionByName(own.distinct())
