"""Fill-in-the-middle texts assembled by a secondary sort.

A text is cut into units (a word with the white space before it; white space at the end is one
more), two draws from the document's id cut the units into prefix, middle and suffix, and a
third and a fourth choose the form.  The parts are never put together by the task that cuts
them: they leave as pieces of at most ``CHUNK_UNITS`` units under the key (document, output
position), ``repartitionAndSortWithinPartitions`` brings a document's pieces together in output
order, and the receiving task streams them into an incremental digest.  The same stream is read
back: sentinels found in the output name the part that follows, and its bytes are sorted anew
by (document, part) into the text that the output stands for.  The second sort keeps the
partitioning of the first, so the text is shuffled once.

A document is known by two 64-bit hashes of its id and text.  Rows that agree in both are cut
alike; their pieces are streamed once and the result is given once per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 42
CHUNK_UNITS = 2048
PLAIN_FROM = 50  # of 100: the share of documents that is transformed
SPM_BELOW = 80  # of 100: the share of these with the suffix in front
PACK_FROM = 512  # pieces from this many bytes on are compressed for the shuffle
PARTITION_BYTES = 32 << 20  # text that a partition of the shuffle holds, about; the sum over all texts is read first
ROW_BYTES = 200  # beside the text

# Part numbers follow the text; each form lists its sentinels with the part after them.
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
FORMS = {"psm": [(b"<P>", PREFIX), (b"<S>", SUFFIX), (b"<M>", MIDDLE)], "spm": [(b"<S>", SUFFIX), (b"<P>", PREFIX), (b"<M>", MIDDLE)], "plain": []}
SENTINELS = (b"<P>", b"<S>", b"<M>")

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offsets after each unit of a UTF-8 text."""
    if not text:
        return np.zeros(0, np.int64)
    blank = _BLANK[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(text)) if blank[-1] else ends


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the document's id; a missing id counts as an empty one."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[8 * i : 8 * i + 8], 16) for i in range(4)]


def plan(doc_id, text: bytes, seed: int = SEED) -> tuple[int, str, list[tuple[int, int, int]], np.ndarray]:
    """(n units, form, [(part, first unit, unit after the last)], unit ends); a plain text is one part."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in SENTINELS):
        return n, "plain", [(PREFIX, 0, n)], ends
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < SPM_BELOW else "psm", [(PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, n)], ends


def _packed(data: bytes) -> bytes:
    return b"z" + zstandard.compress(data, 1) if len(data) >= PACK_FROM else b"r" + data


def _unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data[1:]) if data[:1] == b"z" else data[1:]


def cut(doc_id, text: bytes, seed: int = SEED) -> Iterator[tuple[int, object]]:
    """(output position, piece) of one document; position 0 holds its facts."""
    n, form, parts, ends = plan(doc_id, text, seed)
    offset = np.append(0, ends)
    spans = {part: (int(offset[a]), int(offset[b])) for part, a, b in parts}
    sizes = [code_points(text[slice(*spans[p])]) for p in (PREFIX, MIDDLE)] if form != "plain" else [None, None]
    yield 0, (doc_id, n, form, *sizes)
    at = 1
    units = {part: (a, b) for part, a, b in parts}
    for sentinel, part in FORMS[form] or [(b"", PREFIX)]:
        if sentinel:
            yield at, _packed(sentinel)
            at += 1
        a, b = units[part]
        for u in range(a, b, CHUNK_UNITS):
            yield at, _packed(text[offset[u] : offset[min(u + CHUNK_UNITS, b)]])
            at += 1


class Reader:
    """Finds the parts in an output that comes in pieces, by its form and sentinels alone."""

    def __init__(self, form: str):
        self.ahead = list(FORMS[form])
        self.part = None if self.ahead else PREFIX
        self.rest = b""

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        data = self.rest + data
        while self.ahead:
            sentinel, part = self.ahead[0]
            at = data.find(sentinel)
            if at < 0:
                break
            if at:
                yield self.part, data[:at]
            data, self.part = data[at + len(sentinel) :], part
            self.ahead.pop(0)
        # The head of a sentinel may end this piece.
        held = next((k for k in (2, 1) if self.ahead and data.endswith(self.ahead[0][0][:k])), 0)
        data, self.rest = data[: len(data) - held], data[len(data) - held :]
        if data:
            yield self.part, data

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.rest:
            yield self.part, self.rest


def pieces(docs: DataFrame, doc_id: str, text: str, seed: int) -> RDD:
    """((hash, second hash, output position), piece), sorted within partitions by document."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id), body.cast("binary"), F.xxhash64(F.col(doc_id), body), F.xxhash64(body, F.col(doc_id), F.lit(11))).rdd

    def emit(part):
        for key, data, h, g in part:
            for at, piece in cut(key, bytes(data), seed):
                yield (h, g, at), piece

    return _sorted(rows.mapPartitions(emit), _partitions(docs, text))


def _partitions(docs: DataFrame, text: str) -> int:
    """Partitions of about ``PARTITION_BYTES`` of text each."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES)).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))


def _by_document(key: tuple) -> int:
    return key[0]


def _sorted(rdd: RDD, count: int) -> RDD:
    return rdd.repartitionAndSortWithinPartitions(count, _by_document)


def documents_of(stream) -> Iterator[tuple[tuple, int, tuple, Iterator[bytes]]]:
    """((hash, second hash), rows, facts, pieces) per document of a sorted stream.

    Equal rows bring every position as often as there are rows; the repeats are left out.
    The pieces of a document must be read before the next document is asked for.
    """
    stream = iter(stream)
    ahead = next(stream, None)

    def following(key, at):
        nonlocal ahead
        while ahead is not None and ahead[0][:2] == key:
            position, piece = ahead[0][2:], ahead[1]
            ahead = next(stream, None)
            if position != at:
                at = position
                yield piece

    while ahead is not None:
        key, first, facts, times = ahead[0][:2], ahead[0][2:], ahead[1], 0
        while ahead is not None and ahead[0] == (*key, *first):
            times, ahead = times + 1, next(stream, None)
        yield key, times, facts, following(key, first)


def _frame(docs: DataFrame, doc_id: str, rdd: RDD, columns: str) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL(columns)])
    return docs.sparkSession.createDataFrame(rdd, schema, verifySchema=False)


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every document with its new text."""

    def work(stream):
        for _, times, facts, parts in documents_of(stream):
            row = (*facts, b"".join(map(_unpacked, parts)).decode())
            for _ in range(times):
                yield row

    return _frame(docs, doc_id, pieces(docs, doc_id, text, seed).mapPartitions(work),
                  "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(outputs: DataFrame, doc_id: str = "doc_id", form: str = "form", output: str = "output") -> DataFrame:
    """(doc_id, text): the texts that outputs of :func:`transform` stand for."""

    @F.udf("string", useArrow=True)
    def whole(kind, data):
        reader, found = Reader(kind), {PREFIX: [], MIDDLE: [], SUFFIX: []}
        for part, some in [*reader.feed((data or "").encode()), *reader.end()]:
            found[part].append(some)
        return b"".join(found[PREFIX] + found[MIDDLE] + found[SUFFIX]).decode()

    return outputs.select(F.col(doc_id).alias("doc_id"), whole(form, output).alias("text"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), one row per input row.

    Digests only: no task holds a whole output.  Null texts count as empty and are plain, texts of white
    space are one unit; a null id draws as an empty string and stays null.  Repeated rows give
    equal rows, streamed by one task; other columns are not read; an empty table gives an empty result.
    """

    def assembled(stream):
        for key, times, facts, parts in documents_of(stream):
            digest, reader, at = hashlib.sha256(), Reader(facts[2]), 0
            for data in map(_unpacked, parts):
                digest.update(data)
                for part, some in reader.feed(data):
                    yield (*key, part, at), some
                    at += 1
            for part, some in reader.end():
                yield (*key, part, at), some
            yield (*key, -1, 0), (times, (*facts, digest.hexdigest()))

    def restored(stream):
        for _, _, (times, facts), parts in documents_of(stream):
            digest = hashlib.sha256()
            for data in parts:
                digest.update(data)
            for _ in range(times):
                yield (*facts, digest.hexdigest())

    first = pieces(docs, doc_id, text, seed)
    again = _sorted(first.mapPartitions(assembled, preservesPartitioning=True), first.getNumPartitions())
    return _frame(docs, doc_id, again.mapPartitions(restored),
                  "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS u,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn),
placed AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
    greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR h3 % 100 >= 50 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form != 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts"""
