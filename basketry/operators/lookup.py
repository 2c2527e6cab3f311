"""Catalog fields for long lists of drawn item indexes, where the catalog is too large to broadcast.

A join on exploded lists sends a row per index twice: to the catalog and back to its list.  Here a chunk
of rows asks for its distinct indexes instead, sorted and packed by range of the catalog; each range
answers every chunk with the fields in the same order, and the lists are filled where the chunk's rows
meet the answers.  An index crosses each shuffle in a byte or two, and the rows cross one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from basketry.storage import pin

# rows of a chunk: their lists and answers are held in one task
CHUNK_BITS = 11
# catalog rows and asked indexes that one range should hold
RANGE_ITEMS = 50_000
RANGE_ASKED = 2_000_000

ASKED = "chunk bigint, kind int, range_no bigint, asked binary"
ANSWERS = "chunk bigint, kind int, asked binary, cells binary"


def _packed(values: np.ndarray) -> bytes:
    """Ascending indexes as compressed differences, byte by byte."""
    steps = np.diff(values, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.compress(steps.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.cumsum(planes.T.copy().view("<u8").ravel().astype(np.int64))


def _cells(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def with_fields(rows: DataFrame, lists: dict[str, list[str]], items: DataFrame, size: int) -> DataFrame:
    """``rows`` with each index array of ``lists`` replaced by an array of structs of its catalog fields.

    ``items`` has a row for each ``item_idx`` from 0 to size - 1.  The order of a list stays; a null list stays null.
    """
    names = list(lists)
    kinds = list(dict.fromkeys(tuple(lists[n]) for n in names))
    kind_of = {n: kinds.index(tuple(lists[n])) for n in names}
    chunk = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)
    placed = pin(rows.withColumn("chunk", chunk), "drawn")  # the chunks must not move between the two passes
    longest = placed.agg(*[F.sum(F.greatest(F.size(n), F.lit(0))).alias(n) for n in names]).first()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-size // RANGE_ITEMS), -(-sum(n or 0 for n in longest) // RANGE_ASKED))
    width = max(1, -(-size // ranges))

    def ask(batches):
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            out: list[tuple] = []
            for no in np.unique(chunks).tolist():
                mine = batch.filter(pa.array(chunks == no))
                for kind in range(len(kinds)):
                    flat = [pc.list_flatten(mine.column(1 + i)).to_numpy(zero_copy_only=False) for i, n in enumerate(names) if kind_of[n] == kind]
                    wanted = np.unique(np.concatenate(flat).astype(np.int64))
                    cut = np.flatnonzero(np.diff(wanted // width)) + 1
                    out += [(no, kind, int(part[0] // width), _packed(part)) for part in np.split(wanted, cut) if len(part)]
            columns = list(zip(*out)) or [[]] * 4
            types = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["chunk", "kind", "range_no", "asked"])

    def answer(found: pa.Table, asked: pa.Table) -> pa.Table:
        order = np.argsort(found.column("item_idx").to_numpy())
        index, sorted_ = found.column("item_idx").to_numpy()[order], found.take(pa.array(order))
        parts = [sorted_.select(list(k)).combine_chunks() for k in kinds]
        cells = [_cells(parts[kind].take(pa.array(np.searchsorted(index, _unpacked(blob)))))
                 for kind, blob in zip(asked.column("kind").to_pylist(), asked.column("asked").to_pylist())]
        return pa.table([asked.column("chunk"), asked.column("kind"), asked.column("asked"), pa.array(cells, pa.binary())],
                        names=["chunk", "kind", "asked", "cells"])

    def fill(mine: pa.Table, answers: pa.Table) -> pa.Table:
        given = answers.to_pylist()
        for kind, fields in enumerate(kinds):
            own = [a for a in given if a["kind"] == kind]
            index, cells = np.zeros(0, np.int64), None
            if own:
                index = np.concatenate([_unpacked(a["asked"]) for a in own])
                cells = pa.concat_tables([pa.ipc.open_stream(a["cells"]).read_all() for a in own]).combine_chunks()
            order = np.argsort(index)
            for name in (n for n in names if kind_of[n] == kind):
                column = pa.concat_arrays(mine.column(name).chunks) if mine.num_rows else mine.column(name).combine_chunks()
                target = result.field(name).type.value_type
                values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)
                if len(values):
                    at = order[np.searchsorted(index, values, sorter=order)]
                    columns = [cells.column(f).take(pa.array(at)).combine_chunks().cast(target.field(f).type) for f in fields]
                    values = pa.StructArray.from_arrays(columns, fields=list(target))
                else:
                    values = pa.array([], target)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
                filled = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values, mask=pc.is_null(column))
                mine = mine.set_column(mine.schema.get_field_index(name), result.field(name), filled)
        return mine.drop_columns(["chunk"]).select(result.names)

    kept = items.select("item_idx", *dict.fromkeys(f for k in kinds for f in k))
    named = {n: T.ArrayType(T.StructType([T.StructField(f, kept.schema[f].dataType) for f in fields])) for n, fields in lists.items()}
    schema = T.StructType([T.StructField(f.name, named.get(f.name, f.dataType)) for f in placed.schema if f.name != "chunk"])
    result = to_arrow_schema(schema)
    asked = placed.select("chunk", *names).mapInArrow(ask, ASKED).repartition(ranges, "range_no")
    shards = kept.withColumn("range_no", F.expr(f"item_idx div {width}"))
    answers = shards.groupBy("range_no").cogroup(asked.groupBy("range_no")).applyInArrow(answer, ANSWERS)
    return placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(fill, schema)
