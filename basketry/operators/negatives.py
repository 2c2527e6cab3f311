"""Distinct negative items without a user x catalog product.

The catalog has a dense index 0..N-1 and P is the smallest prime >= N.  Per row the
map j -> (a*j + b) mod P with drawn a, b is a permutation of 0..P-1, so walking j
visits distinct items.  Values >= N and excluded items are skipped and the first n
others are taken.  Walking n + |excluded| + (P - N) steps is always enough, but few rows need
them: all walk a first stretch of n + (P - N) + SPARE steps, and only those that come up short
go on.  Each item has the same chance; the draw is not uniform over all subsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions import draws
from basketry.functions.text import let
from basketry.operators.lookup import with_fields
from basketry.operators.numbering import dense_index
from basketry.storage import BROADCAST_ROWS, broadcast_if_small, pin

# steps of the first stretch for excluded items that are met on it
SPARE = 8
# steps of one task when the walk of a long history is spread
WALK_BLOCK = 4096


def next_prime(n: int) -> int:
    """Smallest prime >= n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@dataclass(frozen=True)
class Catalog:
    """Items with their dense ``item_idx``; ``size`` and ``prime`` fix the walk."""

    items: DataFrame
    size: int
    prime: int


def catalog(items: DataFrame, order: str) -> Catalog:
    """Index the items by ``order``."""
    items = pin(items, "catalog")  # read by the count and by every task that draws from it
    size = items.count()
    return Catalog(dense_index(items, [order], "item_idx", rows=size), size, next_prime(size))


def walk_start(cat: Catalog, *parts) -> tuple[Column, Column]:
    """The drawn a and b of a row."""
    a = draws.pick(cat.prime - 1, *parts, "a") + 1
    b = draws.pick(cat.prime, *parts, "b")
    return a, b


def negative_indexes(cat: Catalog, excluded: Column, n: int, *parts) -> Column:
    """First n item indexes of the walk outside ``excluded`` (an array), in walk order.

    Short when fewer than n items are left.
    """
    a, b = walk_start(cat, *parts)
    least = min(n + cat.prime - cat.size + SPARE, cat.prime)

    def found(ab: Column, steps: Column) -> Column:
        walk = F.transform(
            F.sequence(F.lit(0).cast("bigint"), steps.cast("bigint") - 1),
            lambda j: (ab["a"] * j + ab["b"]) % cat.prime,
        )
        return F.slice(F.array_except(F.filter(walk, lambda c: c < cat.size), excluded), 1, n)

    def walked(ab: Column) -> Column:
        whole = F.least(F.size(excluded) + (n + cat.prime - cat.size), F.lit(cat.prime))
        # a branch that is not taken is not computed
        return let(found(ab, F.lit(least)), lambda f: F.when(F.size(f) == n, f).otherwise(found(ab, whole)))

    return let(F.struct(a.alias("a"), b.alias("b")), walked)


def inverse(a: Column, prime: int) -> Column:
    """The number that a is to be multiplied by to give 1 modulo ``prime``, for 0 < a < prime: a ** (prime - 2)."""
    bits = F.lit([int(bit) for bit in bin(prime - 2)[2:]])
    square = lambda x: x * x % prime
    return let(a, lambda one: F.aggregate(
        bits, F.lit(1).cast("bigint"), lambda x, bit: F.when(bit == 1, square(x) * one % prime).otherwise(square(x))))


def negatives_by_join(
    rows: DataFrame, excluded: DataFrame, cat: Catalog, n: int, keys: list[str], *parts
) -> DataFrame:
    """The same negatives with the excluded items as rows: (keys, step, item_idx)."""
    return negative_lists(rows, excluded, cat, n, keys, *parts).select(*keys, F.inline("found"))


def negative_lists(
    rows: DataFrame, excluded: DataFrame, cat: Catalog, n: int, keys: list[str], *parts
) -> DataFrame:
    """``rows`` with ``found`` ARRAY<STRUCT<step, item_idx>>: the same negatives, for exclusion lists too long for one array.

    An excluded item says itself at which step its key's walk meets it.  Only those met on the first
    stretch are gathered, at most one a step, and the stretch is walked without them.  The few keys that come
    up short walk on in rounds (see :func:`_walked_rows`).  ``excluded`` holds distinct (keys, item_idx).
    """
    least = min(n + cat.prime - cat.size + SPARE, cat.prime)
    a, b = walk_start(cat, *parts)
    met_at = F.pmod(F.pmod(F.col("item_idx") - b, F.lit(cat.prime)) * inverse(a, cat.prime), F.lit(cat.prime))
    hits = excluded.select(*keys, met_at.alias("met_at")).filter(F.col("met_at") < least)
    met = pin(hits.groupBy(*keys).agg(F.collect_set("met_at").alias("met")), "met")

    def walked(who: DataFrame) -> DataFrame:
        steps = F.sequence(F.lit(0).cast("bigint"), F.lit(least - 1).cast("bigint"))
        free = let(F.struct(a.alias("a"), b.alias("b"), F.coalesce("met", F.array().cast("array<bigint>")).alias("met")), lambda w: F.filter(
            F.transform(steps, lambda j: F.struct(j.alias("step"), ((w["a"] * j + w["b"]) % cat.prime).alias("item_idx"))),
            lambda x: (x["item_idx"] < cat.size) & ~F.array_contains(w["met"], x["step"])))
        return who.withColumn("found", F.slice(free, 1, n)).drop("met")

    first = walked(rows.join(met, keys, "left"))
    if least == cat.prime:
        return first.filter(F.size("found") > 0)
    # the stretch holds n free items but for those met beyond SPARE
    short = pin(walked(rows.join(met.filter(F.size("met") > SPARE), keys)).filter(F.size("found") < n).select(*keys), "short")
    if short.isEmpty():
        return first
    held = broadcast_if_small(short)
    more = _walked_rows(short, excluded.join(held, keys, "left_semi"), cat, n, keys, *parts)
    more = more.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "item_idx"))).alias("found"))  # n at most
    return first.join(held, keys, "left_anti").unionByName(rows.join(more, keys))


def _walked_rows(
    rows: DataFrame, excluded: DataFrame, cat: Catalog, n: int, keys: list[str], *parts
) -> DataFrame:
    """(keys, step, item_idx) of the negatives by an anti join with the excluded items.

    The walk goes in rounds: the first stretch for
    all keys, then, for the keys that came up short, stretches that double each time until their
    steps are used up, which is always enough.  Each stretch is cut into blocks that
    are spread over the tasks, the anti join shuffles on (keys, item), and the top-n
    limit is applied before its shuffle.  ``excluded`` holds distinct (keys, item_idx).
    """
    sizes = excluded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_excluded"))
    steps = F.least(
        F.coalesce("n_excluded", F.lit(0)) + (n + cat.prime - cat.size), F.lit(cat.prime)
    ).cast("bigint")
    a, b = walk_start(cat, *parts)
    going = (
        rows.select(*keys, a.alias("a"), b.alias("b"))
        .join(sizes, keys, "left")
        .select(*keys, "a", "b", steps.alias("steps"), F.lit(0).cast("bigint").alias("had"))
    )
    start, stretch, out = 0, min(n + cat.prime - cat.size + SPARE, cat.prime), None
    best = W.partitionBy(*keys).orderBy("step")
    while True:
        last = start + stretch >= cat.prime
        going = pin(going, "walking") if start else going  # the first draw is cheap to repeat
        free = _stretch(going, start, start + stretch, cat, keys).join(excluded, [*keys, "item_idx"], "left_anti")
        wanted = free.join(going.select(*keys, "had"), keys) if start else free.withColumn("had", F.lit(0).cast("bigint"))
        kept = wanted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") + F.col("had") <= n)
        kept = kept.select(*keys, "step", "item_idx")
        kept = kept if last else pin(kept, "walked")
        out = kept if out is None else out.unionByName(kept)
        if last:
            return out
        got = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("got"))
        going = (
            going.join(got, keys, "left")
            .withColumn("had", F.col("had") + F.coalesce("got", F.lit(0)))
            .filter((F.col("had") < n) & (F.col("steps") > start + stretch))
            .drop("got")
        )
        if going.isEmpty():
            return out
        start, stretch = start + stretch, 2 * stretch


def _stretch(going: DataFrame, start: int, end: int, cat: Catalog, keys: list[str]) -> DataFrame:
    """(keys, step, item_idx) of the steps start .. end-1 of each walk, within its own steps."""
    stop = F.least(F.lit(end).cast("bigint"), F.col("steps"))
    numbers = F.sequence(F.lit(start // WALK_BLOCK).cast("bigint"), F.expr(f"(least({end}, steps) - 1) div {WALK_BLOCK}"))
    spread = going.withColumn("block", F.explode(numbers))
    if end - start > WALK_BLOCK:
        spread = spread.repartition(*keys, "block")
    first = F.greatest(F.lit(start).cast("bigint"), F.col("block") * WALK_BLOCK)
    walked = spread.select(
        *keys, "a", "b", F.explode(F.sequence(first, F.least(stop, (F.col("block") + 1) * WALK_BLOCK) - 1)).alias("step")
    )
    at = (F.col("a") * F.col("step") + F.col("b")) % cat.prime
    return walked.select(*keys, "step", at.alias("item_idx")).filter(F.col("item_idx") < cat.size)


def look_up(rows: DataFrame, indexes: str, cat: Catalog, keys: list[str], fields: list[str]) -> DataFrame:
    """Explode an index array and attach catalog fields: (keys, ord, fields)."""
    if cat.size > BROADCAST_ROWS:
        named = named_draws(rows.select(*keys, indexes), {indexes: fields}, cat)
        return named.select(*keys, F.posexplode(indexes).alias("ord", "item")).select(*keys, "ord", "item.*")
    exploded = rows.select(*keys, F.posexplode(indexes).alias("ord", "item_idx"))
    return exploded.join(cat.items.select("item_idx", *fields), "item_idx").drop("item_idx")


def fields_by_index(cat: Catalog, field: str) -> Column:
    """All values of a field in index order as one array: a scalar subquery.

    Only for a catalog within the broadcast limit.
    """
    if cat.size > BROADCAST_ROWS:
        raise ValueError("the catalog is too large for one array")
    packed = F.sort_array(F.collect_list(F.struct("item_idx", field)))
    return cat.items.agg(packed[field].alias(field)).scalar()


def holds_enough(excluded: Column, cat: Catalog, n: int) -> Column:
    return F.size(excluded) <= cat.size - n


def too_few(cat: Catalog, n: int) -> str:
    return f"fewer than {n} of {cat.size} items are left to draw for user {{}}"


def enough_left(rows: DataFrame, excluded: Column, cat: Catalog, n: int, strict: bool) -> DataFrame:
    """Rows with at least n items to draw from; the strict mode fails the job at any other."""
    holds = holds_enough(excluded, cat, n)
    if not strict:
        return rows.filter(holds)
    said = F.concat(F.lit(too_few(cat, n).removesuffix("{}")), F.col("user_id"))
    return rows.filter(F.when(holds, True).otherwise(F.raise_error(said).cast("boolean")))


def add_candidates(
    rows: DataFrame,
    cat: Catalog,
    n: int,
    seed: int,
    purpose: str,
    outside_history: bool,
    strict: bool = True,
    *,
    keep: bool = False,
    history: Column | None = None,
    target: Column | None = None,
    out: str = "candidates",
) -> DataFrame:
    """Add ``candidates`` (or ``out``): n negatives and the target, shuffled.

    ``outside_history`` excludes the input items too.  A row whose pool is smaller
    than n fails the job, or is left out if not ``strict`` (see :func:`short_pools`), or stays, with
    too short a list, if ``keep``.  ``history`` and ``target`` stand for the input and target columns.  A
    catalog within the broadcast limit is looked up in place, without a shuffle; a larger
    one by :func:`named_draws`, unless its names are in ``rows`` already.
    """
    parts = (seed, F.col("epoch"), F.col("user_id"), purpose)
    target = F.col("target") if target is None else target
    excluded = excluded_indexes(outside_history, history, target)
    large = cat.size > BROADCAST_ROWS
    if drawn_name(out) in rows.columns:
        named = rows
    else:
        # filtering on the drawn list instead would draw it twice
        able = rows if keep else enough_left(rows, excluded, cat, n, strict)
        indexes = negative_indexes(cat, excluded, n, *parts)
        if large:
            named = named_draws(able.withColumn(drawn_name(out), indexes), {drawn_name(out): ["item_id"]}, cat)
        else:
            named = able.withColumn("negatives", indexes)

    def order(item: Column) -> Column:
        return draws.draw(*parts, F.concat(F.lit("shuffle/"), item))

    if large:
        found = F.col(drawn_name(out))["item_id"]
    else:
        # the projections collapse, so the array is one shared value, not a row column
        named = named.withColumn("ids", fields_by_index(cat, "item_id"))
        found = F.transform("negatives", lambda i: F.get(F.col("ids"), i.cast("int")))
    shown = F.transform(
        F.array_append(found, target["item_id"]),
        lambda x: F.struct(order(x).alias("draw"), x.alias("item_id")),
    )
    return named.withColumn(out, F.sort_array(shown)["item_id"]).drop("negatives", "ids", drawn_name(out))


def drawn_name(out: str) -> str:
    """The column that holds what is drawn for ``out``: indexes, then their catalog fields."""
    return f"{out}__drawn"


def named_draws(rows: DataFrame, lists: dict[str, list[str]], cat: Catalog) -> DataFrame:
    """``rows`` with the index arrays of ``lists`` replaced by arrays of the catalog fields they name."""
    if cat.prime < 1 << 31:
        rows = rows.withColumns({name: F.col(name).cast("array<int>") for name in lists})
    return with_fields(rows, lists, cat.items, cat.size)


def candidates_by_join(
    rows: DataFrame, excluded: DataFrame, cat: Catalog, n: int, seed: int, purpose: str, strict: bool = True
) -> DataFrame:
    """(user_id, epoch, candidates) with the exclusions as rows; see :func:`add_candidates`.

    ``excluded`` holds the target and the input items of each key.
    """
    keys = ["user_id", "epoch"]
    parts = (seed, F.col("epoch"), F.col("user_id"), purpose)
    one = rows.filter(F.col("segment_no") == 0).select(*keys, F.col("target.item_id").alias("item_id"))
    # the rows are narrow and their walks long: a fixed number of tasks, and one copy of what they draw
    one = one.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    found = negative_lists(one, excluded, cat, n, keys, *parts)
    given = found.withColumn("negatives", F.col("found")["item_idx"]).drop("found")

    def order(item: Column) -> Column:
        return draws.draw(*parts, F.concat(F.lit("shuffle/"), item))

    if cat.size <= BROADCAST_ROWS:
        given = given.withColumn("ids", fields_by_index(cat, "item_id"))
        names = F.transform("negatives", lambda i: F.get(F.col("ids"), i.cast("int")))
    else:
        given = named_draws(given, {"negatives": ["item_id"]}, cat)
        names = F.col("negatives")["item_id"]
    shown = F.transform(F.array_append(names, F.col("item_id")), lambda x: F.struct(order(x).alias("draw"), x.alias("item_id")))
    lists = pin(given.select(*keys, F.sort_array(shown)["item_id"].alias("candidates")), "candidates")
    full = F.size("candidates") == n + 1
    if not strict:
        return lists.filter(full)
    said = F.concat(F.lit(too_few(cat, n).removesuffix("{}")), F.col("user_id"))
    return lists.filter(F.when(full, True).otherwise(F.raise_error(said).cast("boolean")))


def excluded_indexes(outside_history: bool, history: Column | None = None, target: Column | None = None) -> Column:
    history = F.col("input") if history is None else history
    own = F.array((F.col("target") if target is None else target)["item_idx"])
    return F.array_union(history["item_idx"], own) if outside_history else own


def pool_sizes(excluded: DataFrame, cat: Catalog, keys: list[str]) -> DataFrame:
    """Items left to draw from per key; ``excluded`` holds distinct (keys, item)."""
    return excluded.groupBy(*keys).agg((F.lit(cat.size) - F.count(F.lit(1))).alias("pool_size"))


def short_pools(excluded: DataFrame, cat: Catalog, n: int, keys: list[str]) -> DataFrame:
    """Keys that leave fewer than n items to draw from."""
    return pool_sizes(excluded, cat, keys).filter(F.col("pool_size") < n)


def add_other_item(
    rows: DataFrame, cat: Catalog, seed: int, purpose: str, strict: bool = True, *, keep: bool = False, target: Column | None = None, prefix: str = ""
) -> DataFrame:
    """Add ``other_item`` and ``other_title`` of one random item that is not the target.

    ``keep`` leaves a row without another item as it is, with NULL; ``prefix`` leads the new names.
    """
    parts = (seed, F.col("epoch"), F.col("user_id"), purpose)
    drawn = drawn_name(f"{prefix}other")
    excluded = excluded_indexes(False, target=target)
    if drawn not in rows.columns:
        able = rows if keep else enough_left(rows, excluded, cat, 1, strict)
        indexes = negative_indexes(cat, excluded, 1, *parts)
        if cat.size <= BROADCAST_ROWS:
            found = able.withColumn("other_idx", F.get(indexes, F.lit(0)))
            fields = cat.items.select(
                F.col("item_idx").alias("other_idx"),
                F.col("item_id").alias(f"{prefix}other_item"),
                F.col("title").alias(f"{prefix}other_title"),
            )
            # no hint: Spark broadcasts the catalog below its size threshold
            return found.join(fields, "other_idx", "left" if keep else "inner").drop("other_idx")
        rows = named_draws(able.withColumn(drawn, indexes), {drawn: ["item_id", "title"]}, cat)
    one = F.get(drawn, F.lit(0))
    return rows.withColumns({f"{prefix}other_item": one["item_id"], f"{prefix}other_title": one["title"]}).drop(drawn)
