"""Row numbers that survive a hot key.

A plain ``row_number`` puts all rows of a key into one task.  Here every key with
more than ``hot_rows`` rows is numbered in two levels instead: its rows are range
partitioned over the whole cluster, numbered inside each range, and shifted by the
row counts of the ranges before it.  Both ways give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.draws import DRAW_BITS
from basketry.storage import broadcast_if_small, pin

HOT_ROWS = 1_000_000
# rows one hash block of a shuffled numbering should hold
BLOCK_ROWS = 250_000


# keys a task's frequent-items sketch keeps apart
SKETCH_KEYS = 1 << 17


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS, tracked: int = SKETCH_KEYS) -> DataFrame:
    """Keys with more than ``limit`` rows; at most rows/limit of them.

    One pass over the key columns fills a frequent-items sketch per task.  The merged sketch is
    off by 3.5/tracked of all rows at most and names every key above twice that, so
    with up to limit * tracked / 7 rows every hot key is among its items (the largest tracked/6
    of them hold all that may be above the limit).  These few are counted exactly.  For
    more rows all keys are counted.  No copy of the input is made in either case.
    """
    spark = df.sparkSession
    names = {k: df.schema[k].dataType for k in keys}
    hashed = df.select(*keys, F.xxhash64(*keys).alias("key_hash"))
    found = hashed.selectExpr("count(1) AS n", f"approx_top_k(key_hash, {tracked // 6 + 1}, {tracked}) AS top").first()
    if 7 * found.n <= limit * tracked:
        # an item's estimate is never below its count
        likely = [(t["item"],) for t in found.top or [] if t["count"] > limit]
        if not likely:
            return spark.createDataFrame([], T.StructType([T.StructField(k, t) for k, t in names.items()]))
        # at most tracked/6 rows
        hashed = hashed.join(F.broadcast(spark.createDataFrame(likely, "key_hash bigint")), "key_hash", "left_semi")
    counted = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_count"))
    return counted.filter(F.col("hot_count") > limit).select(*keys)


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    pos: str = "pos",
    total: str | None = "n",
    lead: dict[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Number rows 0.. inside each key by ``order`` (which must be unique per key).

    ``total`` adds the key's row count, ``lead`` ({new: source}) the next row's
    value.  ``at_most`` is a known upper bound of the rows of any key (or of all rows, for
    example from Parquet footers): when it is within ``hot_rows`` no key can be hot
    and the pass of :func:`hot_keys` is skipped.  ``df`` itself is not copied; only the rows of
    hot keys are, when there are any.
    """
    lead = lead or {}
    if at_most is not None and at_most <= hot_rows:
        return _number_plain(df, keys, order, pos, total, lead)
    hot = pin(hot_keys(df, keys, hot_rows), "hot-keys")
    if hot.isEmpty():
        return _number_plain(df, keys, order, pos, total, lead)
    hot = broadcast_if_small(hot)
    cold_rows = df.join(hot, keys, "left_anti")
    hot_part = df.join(hot, keys, "left_semi")
    return _number_plain(cold_rows, keys, order, pos, total, lead).unionByName(
        _number_ranges(hot_part, keys, order, pos, total, lead)
    )


def _number_plain(df, keys, order, pos, total, lead) -> DataFrame:
    by_key = W.partitionBy(*keys)
    ordered = by_key.orderBy(*order)
    cols: list[Column] = [(F.row_number().over(ordered) - 1).cast("bigint").alias(pos)]
    if total:
        cols.append(F.count(F.lit(1)).over(by_key).cast("bigint").alias(total))
    cols += [F.lead(src).over(ordered).alias(new) for new, src in lead.items()]
    return df.select("*", *cols)


def _range_count(df: DataFrame) -> int:
    """Ranges of ``BLOCK_ROWS`` rows, however few shuffle partitions the session has."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, -(-df.count() // BLOCK_ROWS)))


def _number_ranges(df, keys, order, pos, total, lead) -> DataFrame:
    # The range ids must not move between the two passes below, so they are pinned.
    placed = pin(
        df.repartitionByRange(_range_count(df), *keys, *order).withColumn("range_no", F.spark_partition_id()),
        "ranges",
    )
    spots = [*keys, "range_no"]
    sizes = placed.groupBy(*spots).agg(F.count(F.lit(1)).alias("range_rows"))
    before = W.partitionBy(*keys).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *spots,
        "range_rows",
        F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("range_shift"),
        F.sum("range_rows").over(W.partitionBy(*keys)).alias("key_rows"),
    )
    inside = W.partitionBy(*spots).orderBy(*order)
    numbered = placed.withColumn(pos, F.row_number().over(inside) - 1)
    if lead:
        # The next row is in the same range, but for a range's last row: there it is the
        # first row of the key's next range, one row per key and range.
        numbered = numbered.withColumns({new: F.lead(src).over(inside) for new, src in lead.items()})
        first = F.min_by(F.struct(*[F.col(src).alias(new) for new, src in lead.items()]), F.struct(*order))
        opening = placed.groupBy(*spots).agg(first.alias("own"))
        after = F.lead("own").over(W.partitionBy(*keys).orderBy("range_no"))
        shifts = shifts.join(opening.select(*spots, after.alias("opening")), spots)
    out = (
        numbered.join(shifts, spots)
        .withColumn(pos, (F.col(pos) + F.col("range_shift")).cast("bigint"))
    )
    if total:
        out = out.withColumn(total, F.col("key_rows").cast("bigint"))
    if lead:
        is_last = F.col(pos) - F.col("range_shift") == F.col("range_rows") - 1
        out = out.withColumns({new: F.when(is_last, F.col("opening")[new]).otherwise(F.col(new)) for new in lead})
    out = out.drop("range_rows", "range_no", "range_shift", "key_rows")
    return out.drop("opening") if lead else out


def dense_index(
    df: DataFrame, order: list[str], out: str, *, one_task_rows: int = HOT_ROWS, rows: int | None = None
) -> DataFrame:
    """Number all rows 0..n-1 by ``order``; one task only when the count allows it.

    ``rows`` is the count where it is known already.
    """
    if rows is None:
        df = pin(df, "to-index")
        rows = df.count()
    if rows <= one_task_rows:
        spot = W.partitionBy(F.lit(0)).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(spot) - 1).cast("bigint"))
    whole = df.withColumn("whole_set", F.lit(0))
    return _number_ranges(whole, ["whole_set"], order, out, None, {}).drop("whole_set")


def shuffled_index(
    df: DataFrame,
    draw_col: str,
    order: list[str],
    out: str,
    rows: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number all rows 0..n-1 in the order of a uniform 48-bit draw.

    The draw's leading bits split the rows into even blocks known in advance, so no
    range sampling and no pinned copy is needed.  ``order`` breaks ties.
    """
    bits = max(0, min(20, (max(rows, 1) // block_rows).bit_length()))
    blocks = df.withColumn("block_no", F.shiftright(F.col(draw_col), DRAW_BITS - bits))
    sizes = blocks.groupBy("block_no").agg(F.count(F.lit(1)).alias("block_size"))
    # one row per block, at most 2**20
    before = W.partitionBy(F.lit(0)).orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        "block_no", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("block_shift")
    )
    inside = W.partitionBy("block_no").orderBy(draw_col, *order)
    return (
        blocks.withColumn(out, F.row_number().over(inside) - 1)
        .join(shifts, "block_no")
        .withColumn(out, (F.col(out) + F.col("block_shift")).cast("bigint"))
        .drop("block_no", "block_shift")
    )


def running_sums(
    df: DataFrame, keys: list[str], index: str, sums: dict[str, str], block: int = 4096, longest: int | None = None
) -> DataFrame:
    """Cumulative sums along an integer ``index`` >= 0, unique per key, in levels of blocks.

    The rows of a block are summed in one window; the blocks' totals are the rows of the next level,
    and so on until one block is left, so no window holds more than ``block`` rows however
    long a key is.  ``longest`` is a known upper bound of the index; without it
    the largest one is read first.
    """
    if longest is None:
        longest = df.agg(F.max(index)).first()[0] or 0
    return _scan(df, keys, index, sums, block, longest, W.currentRow)


def _scan(df: DataFrame, keys: list[str], index: str, sums: dict[str, str], block: int, longest: int, upto: int) -> DataFrame:
    """Sums up to each row (``upto`` 0) or the row before it (-1)."""
    blocks = df.withColumn("block_no", F.expr(f"{index} div {int(block)}"))
    frame = W.partitionBy(*keys, "block_no").orderBy(index).rowsBetween(W.unboundedPreceding, upto)
    zero = lambda c: F.coalesce(c, F.lit(0)) if upto < 0 else c
    out = blocks.select("*", *[zero(F.sum(src).over(frame)).alias(new) for new, src in sums.items()])
    if longest < block:
        return out.drop("block_no")
    totals = blocks.groupBy(*keys, "block_no").agg(*[F.sum(src).alias(f"total_{new}") for new, src in sums.items()])
    carried = _scan(totals.withColumnRenamed("block_no", "index_no"), keys, "index_no",
                    {f"carry_{new}": f"total_{new}" for new in sums}, block, longest // block, -1)
    carried = carried.select(*keys, F.col("index_no").alias("block_no"), *[f"carry_{new}" for new in sums])
    out = out.join(carried, [*keys, "block_no"])
    for new in sums:
        out = out.withColumn(new, F.col(new) + F.col(f"carry_{new}")).drop(f"carry_{new}")
    return out.drop("block_no")
