"""Exact dedup through a sharded cuckoo-filter index of live digests.

Texts are equal when they are identical without their white space; the SHA-256 of what is left
stands for the text.  The index has three tables in the shared folder:

``members``
    a row per live document row: digest, id, length and its place (block, number);
``parts``
    what a block of rows knows of a digest: how many rows, and the best of them.  Rows of a
    block meet in the task that reads them, in a :class:`cuckoo.CuckooIndex` of its own, so a
    text that fills a third of the corpus leaves every task as one part;
``entries``
    a row per live digest: how many rows, and the row that stays.

Digests are dealt over shards by their value.  A shard's task builds its filter from the stored
entries, deletes the digests that changes touch, inserts the parts, verifies each hit against the
stored digest in the bucket, and merges it.  Results go back per (digest, block), again at most
one row per block of a digest, and are joined with the members on both.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Scratch
from basketry.llm.cuckoo import CuckooIndex

SPACE_BYTES = b" \t\n\x0b\x0c\r"
BLOCK_ROWS = 50_000  # rows that share an index of their own before the shuffle
SHARD_PARTS = 200_000  # parts a shard's task holds, about; sets the number of shards
_BLOCK_BITS = 32

_STORED, _DELETE, _INSERT = 0, 1, 2


@dataclass(frozen=True)
class Index:
    """The tables of an index."""

    members: DataFrame
    parts: DataFrame
    entries: DataFrame


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE_BYTES)


def better(a: tuple, b: tuple) -> tuple:
    """The row that stays of (n_chars, doc_id, block, number): longest, smallest id, first place; ids before none."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2], x[3]))


def _row(id_type: str) -> str:
    return f"struct<n_chars:bigint,doc_id:{id_type},block:bigint,number:bigint>"


def digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(digest, doc_id, n_chars, block, number) per row; a block is at most ``BLOCK_ROWS`` rows of a task."""

    def work(batches):
        task, seen = TaskContext.get().partitionId() << _BLOCK_BITS, 0
        for b in batches:
            found = [hashlib.sha256(normalised(t.as_py())).digest() for t in b.column(1)]
            at = range(seen, seen + len(found))
            seen += len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), b.column(0), b.column(2), pa.array([task + i // BLOCK_ROWS for i in at], pa.int64()),
                 pa.array([i % BLOCK_ROWS for i in at], pa.int64())], ["digest", "doc_id", "n_chars", "block", "number"])

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id), body.cast("binary"), F.char_length(body).cast("bigint")).mapInArrow(
        work, f"digest binary, doc_id {docs.schema[doc_id].dataType.simpleString()}, n_chars bigint, block bigint, number bigint")


def _batch(digest: list, block: list | None, size: list, rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kind = pa.struct([("n_chars", pa.int64()), ("doc_id", id_type), ("block", pa.int64()), ("number", pa.int64())])
    keep = pa.array([dict(zip(("n_chars", "doc_id", "block", "number"), r)) for r in rows], kind)
    columns = {"digest": pa.array(digest, pa.binary()), "block": block and pa.array(block, pa.int64()), "size": pa.array(size, pa.int64()), "best": keep}
    return pa.RecordBatch.from_pydict({k: c for k, c in columns.items() if c is not None})


def block_parts(members: DataFrame) -> DataFrame:
    """(digest, block, size, best): the members of each block, merged in the block's own index."""

    def closed(index, block, kind):
        live = list(index.items())
        return _batch([d for d, _ in live], [block] * len(live), [v[0] for _, v in live], [v[1] for _, v in live], kind)

    def work(batches):
        index, block, kind = CuckooIndex(), None, None
        for b in batches:
            kind = b.schema.field("doc_id").type
            for digest, key, n, own, number in zip(*(c.to_pylist() for c in b.columns)):
                if own != block:
                    if len(index):
                        yield closed(index, block, kind)
                    index, block = CuckooIndex(), own
                _merge(index, digest, 1, (n, key, own, number))
        if len(index):
            yield closed(index, block, kind)

    id_type = members.schema["doc_id"].dataType.simpleString()
    return members.select("digest", "doc_id", "n_chars", "block", "number").mapInArrow(
        work, f"digest binary, block bigint, size bigint, best {_row(id_type)}")


def _merge(index: CuckooIndex, digest: bytes, size: int, row: tuple) -> None:
    entry = index.find(digest)
    if entry < 0:
        index.insert(digest, (size, row))
    else:
        had, best = index.values[entry]
        index.values[entry] = (had + size, better(best, row))


def _shards(offers: DataFrame, shards: int, id_type: str) -> DataFrame:
    """(digest, size, best) of all live digests after the ``offers`` (kind, digest, size, best) of each shard."""

    def work(batches):
        index, kind = CuckooIndex(), None
        for b in batches:
            kind = b.schema.field("best").type.field("doc_id").type
            for what, digest, size, best in zip(*(c.to_pylist() for c in b.columns)):
                if what == _DELETE:
                    index.delete(digest)
                else:
                    _merge(index, digest, size, tuple(best.values()))
        live = list(index.items())
        for at in range(0, len(live), 20_000):
            some = live[at : at + 20_000]
            yield _batch([d for d, _ in some], None, [v[0] for _, v in some], [v[1] for _, v in some], kind)

    # The kinds must come in order; within a kind any order gives the same result.
    dealt = offers.repartition(shards, "digest").sortWithinPartitions("kind")
    return dealt.mapInArrow(work, f"digest binary, size bigint, best {_row(id_type)}")


def _changed(scratch: Scratch, stored: DataFrame | None, touched: DataFrame | None, offered: DataFrame) -> DataFrame:
    """The entries after deleting the ``touched`` digests and inserting the ``offered`` parts."""
    id_type = offered.schema["best"].dataType["doc_id"].dataType.simpleString()
    columns = ["digest", "size", "best"]
    offers = offered.select(F.lit(_INSERT).alias("kind"), *columns)
    held = offered.count()
    if stored is not None:
        offers = offers.unionByName(stored.select(F.lit(_STORED).alias("kind"), *columns))
        held += stored.count()
    if touched is not None:
        offers = offers.unionByName(touched.select(F.lit(_DELETE).alias("kind"), "digest", F.lit(0).cast("bigint").alias("size"),
                                                   F.lit(None).cast(_row(id_type)).alias("best")))
    least = int(offered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.pin(_shards(offers, max(least, -(-held // SHARD_PARTS)), id_type))[0]


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows of ``docs``; its tables stay in the shared folder."""
    scratch = Scratch(docs.sparkSession, "cuckoo")
    members, _ = scratch.pin(digests(docs, doc_id, text))
    parts, _ = scratch.pin(block_parts(members))
    return Index(members, parts, _changed(scratch, None, None, parts))


def insert(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index with the rows of ``docs`` as well."""
    scratch = Scratch(docs.sparkSession, "cuckoo")
    after = 1 + (index.members.agg(F.max("block")).first()[0] or 0)
    added, _ = scratch.pin(digests(docs, doc_id, text).withColumn("block", F.col("block") + F.lit(after)))
    parts, _ = scratch.pin(block_parts(added))
    return Index(index.members.unionByName(added), index.parts.unionByName(parts), _changed(scratch, index.entries, None, parts))


def delete(index: Index, gone: DataFrame, doc_id: str = "doc_id") -> Index:
    """The index without the rows whose id is in ``gone``; rows without an id stay.

    A digest that loses a row is deleted from its filter; if rows are left, they are counted
    anew and the digest is inserted again with the best of them.
    """
    scratch = Scratch(gone.sparkSession, "cuckoo")
    ids = gone.select(F.col(doc_id).alias("__gone")).distinct()
    lost = F.col("doc_id") == F.col("__gone")
    touched, _ = scratch.pin(index.members.join(ids, lost, "left_semi").select("digest").distinct())
    members, _ = scratch.pin(index.members.join(ids, lost, "left_anti"))
    # The rows of a block no longer lie together, so the parts are formed by grouping here.
    order = F.struct((-F.col("n_chars")).alias("m"), F.col("doc_id").isNull().alias("x"), "doc_id", "number")
    rest = members.join(touched, "digest", "left_semi").groupBy("digest", "block").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("o"))
    best = F.struct((-F.col("o.m")).alias("n_chars"), F.col("o.doc_id"), F.col("block"), F.col("o.number"))
    parts, _ = scratch.pin(rest.select("digest", "block", "size", best.alias("best")))
    others = index.parts.join(touched, "digest", "left_anti")
    return Index(members, others.unionByName(parts), _changed(scratch, index.entries, touched, parts))


def verdicts(index: Index) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, block, number), one row per member."""
    told = index.parts.select("digest", "block").distinct().join(index.entries, "digest")
    rows = index.members.join(told, ["digest", "block"])
    kept = (F.col("best.block") == F.col("block")) & (F.col("best.number") == F.col("number"))
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"), "block", "number")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Of equal texts the row with the most code points stays, then the one with the smallest id (a row
    without an id last), then the first read; exactly one row of a group is kept, also of repeated
    rows.  Null texts count as empty, and all texts without other characters are equal.  Texts are
    read whole; other columns are not read; an empty table gives an empty result.
    """
    return verdicts(build(docs, doc_id, text)).drop("block", "number")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ 	-]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER best = 1 AS kept, h AS text_sha256
FROM d WINDOW best AS (PARTITION BY h ORDER BY n DESC, doc_id)"""
