"""Sources, joins, splits and list forms of the history."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import text
from basketry.operators import history as hist_ops
from basketry.operators import splits
from basketry.operators.numbering import dense_index, number_rows
from basketry.operators.predict import item_popularity
from basketry.plans import dataset
from basketry.sources import layout, raw, retail
from basketry.storage import fresh_path, pin
from checks.base import HISTORY, USERS, history, query, with_ctes


@query(with_ctes(HISTORY, "SELECT user_id, pos, n, item_id FROM hist"))
def src_sequence_log(spark, folder):
    """The log is written as text, one line per user, and read by the log reader."""
    segs = splits.segments(history(spark, folder), ["item_id"])
    lines = splits.whole_texts(segs, ["user_id"], F.array_join("seq.item_id", " "), " ", "items")
    path = fresh_path(spark, "sequence-log")
    lines.select(F.concat_ws(" ", "user_id", "items").alias("value")).write.text(path)
    return raw.read_sequence_log(spark, path)


# every 13th row has no rating; one foreign item is rated once per 50th user
RATED = """rated AS (
  SELECT user_id, item_id, rating, pos % 3 AS part, pos AS ord FROM hist
  WHERE (CAST(user_id AS BIGINT) + pos) % 13 <> 0
  UNION ALL
  SELECT user_id, 'foreign', 5, 2, n FROM hist WHERE pos = 0 AND CAST(user_id AS BIGINT) % 50 = 0)"""


def rating_parts(rows):
    user = F.col("user_id").cast("bigint")
    kept = rows.filter((user + F.col("pos")) % 13 != 0)
    picked = ["user_id", "item_id", "rating", F.col("pos").alias("ord")]
    parts = [kept.filter(F.col("pos") % 3 == p).select(*picked) for p in range(3)]
    foreign = rows.filter((F.col("pos") == 0) & (user % 50 == 0)).select(
        "user_id",
        F.lit("foreign").alias("item_id"),
        F.lit(5).cast("bigint").alias("rating"),
        F.col("n").alias("ord"),
    )
    parts[2] = parts[2].unionByName(foreign)
    return parts


@query(with_ctes(HISTORY, RATED, "SELECT user_id, item_id, rating, part, ord FROM rated"))
def ratings_union(spark, folder):
    return raw.union_ratings(rating_parts(pin(history(spark, folder), "history")))


@query(
    with_ctes(
        HISTORY,
        RATED,
        """a AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY pos) AS k FROM hist)""",
        """b AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY part, ord) AS k
        FROM rated)""",
        """SELECT a.user_id, a.pos, a.item_id, b.rating FROM a
        LEFT JOIN b ON a.user_id = b.user_id AND a.item_id = b.item_id AND a.k = b.k""",
    )
)
def rating_attach_occurrence(spark, folder):
    whole = pin(history(spark, folder), "history")
    rows = whole.select("user_id", "pos", "item_id")
    ratings = raw.union_ratings(rating_parts(whole))
    # a pair has no more rows than its user; the foreign item is one more pair
    longest = whole.agg(F.max("n")).first()[0] or 0
    return hist_ops.attach_ratings(rows, ratings, at_most=longest)


@query(
    with_ctes(
        HISTORY,
        RATED,
        """a AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY pos) AS k FROM hist)""",
        """b AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY part, ord) AS k
        FROM rated)""",
        """SELECT a.user_id, a.pos, a.item_id, b.rating FROM a
        LEFT JOIN b ON a.user_id = b.user_id AND a.item_id = b.item_id AND a.k = b.k""",
    )
)
def ratings_in_file_order(spark, folder):
    """Rating files without a place column: the order of the lines counts."""
    whole = pin(history(spark, folder), "history")
    paths = []
    for part in rating_parts(whole):
        paths.append(fresh_path(spark, "ratings"))
        lines = part.repartitionByRange("ord", "user_id").sortWithinPartitions("ord", "user_id")
        record = F.struct(F.col("user_id").alias("reviewerID"), F.col("item_id").alias("asin"), F.col("rating").alias("overall"))
        lines.select(F.to_json(record).alias("value")).write.text(paths[-1])
    ratings = raw.read_ratings(spark, paths, "json", order=None)
    ratings = ratings.withColumnsRenamed({"user_key": "user_id", "item_key": "item_id"})
    return hist_ops.attach_ratings(whole.select("user_id", "pos", "item_id"), ratings)


@query(
    """SELECT 'item_' || CAST(l_partkey + 1000 AS VARCHAR) AS item_id,
      'user_' || CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_raw,
      l_linenumber::BIGINT AS line_no, l_orderkey AS order_no,
      CASE WHEN p_size % 2 = 0 THEN CASE WHEN l_partkey % 11 = 0 THEN '' ELSE p_name END ELSE '' END AS title,
      CASE WHEN p_size % 2 = 0 THEN p_brand || '|' || p_type || '|SIZE_' || p_size ELSE '' END AS categories
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
)
def item_meta_denorm(spark, folder):
    """Even-sized parts have metadata; the other items get empty fields."""
    sized = retail.table(spark, folder, "part").filter(F.col("p_size") % 2 == 0)
    ids = sized.select(F.col("p_partkey").cast("string").alias("key"))
    items = hist_ops.known_items(retail.items(spark, folder), ids, "item_id")
    rows = hist_ops.add_items(retail.purchases(spark, folder), items, ["title", "categories"])
    out = hist_ops.display_ids(rows, prefix=True, start_1001=True)
    return out.select(
        "item_id",
        "user_id",
        "item_raw",
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.col("l_orderkey").alias("order_no"),
        "title",
        F.array_join("categories", "|").alias("categories"),
    )


def split_sql(split: str) -> str:
    hidden = {"train": 2, "validation": 1, "test": 0, "train_validation": 1}[split]
    least = {"train": 3, "validation": 3, "test": 2, "train_validation": 2}[split]
    part = (
        f"CASE WHEN pos = n - {hidden} - 1 THEN 'target' ELSE 'input' END"
        if split in ("validation", "test")
        else "'input'"
    )
    return with_ctes(
        HISTORY,
        f"""SELECT user_id, pos, item_id, rating, {part} AS part FROM hist
        WHERE n >= {least} AND pos < n - {hidden}""",
    )


def split_query(split: str):
    def run(spark, folder):
        rows = splits.split_rows(history(spark, folder), split)
        return rows.select("user_id", "pos", "item_id", "rating", "part")

    return run


for _name, _split in {
    "loo_split_train": "train",
    "loo_split_validation": "validation",
    "loo_split_test": "test",
    "merge_train_val": "train_validation",
}.items():
    _fn = split_query(_split)
    _fn.__name__ = _name
    query(split_sql(_split))(_fn)


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, pos, item_id, target_item, target_rating FROM (
          SELECT *, last_value(item_id) OVER w AS target_item, last_value(rating) OVER w AS target_rating
          FROM hist WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        WHERE pos < n - 1""",
    )
)
def loo_split_join_form(spark, folder):
    rows = splits.split_by_join(history(spark, folder), "test")
    return rows.select("user_id", "pos", "item_id", "target_item", "target_rating")


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, pos // 16 AS segment_no, string_agg(item_id, ' ' ORDER BY pos) AS items,
          string_agg(CAST(rating AS VARCHAR), ' ' ORDER BY pos) AS ratings, count(*) AS n_rows
        FROM hist GROUP BY user_id, pos // 16""",
    )
)
def history_segments(spark, folder):
    """Lists of at most 16 rows, so that ordinary users have several."""
    seqs = splits.segments(history(spark, folder), ["item_id", "rating"], size=16)
    return seqs.select(
        "user_id",
        "segment_no",
        F.array_join(F.col("seq.item_id"), " ").alias("items"),
        F.array_join(F.col("seq.rating").cast("array<string>"), " ").alias("ratings"),
        F.size("seq").cast("bigint").alias("n_rows"),
    )


@query(
    """SELECT CAST(l_partkey AS VARCHAR) AS item_id, count(*) AS n_bought
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey"""
)
def item_popularity_counts(spark, folder):
    return item_popularity(retail.purchases(spark, folder))


FIRST_SEEN = """seen AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id,
    min((o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS first_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)"""


def seen_users(spark, folder):
    return hist_ops.first_seen(retail.purchases(spark, folder), "user_id", retail.LINE_ORDER)


@query(
    with_ctes(
        FIRST_SEEN,
        """SELECT user_id, strftime(first_at[1], '%Y-%m-%d') AS first_day, first_at[2] AS first_order FROM seen""",
    )
)
def first_seen_users(spark, folder):
    first = F.col("first_at")
    return seen_users(spark, folder).select(
        "user_id",
        F.date_format(first["o_orderdate"], "yyyy-MM-dd").alias("first_day"),
        first["l_orderkey"].alias("first_order"),
    )


@query(
    with_ctes(
        FIRST_SEEN,
        "SELECT user_id, row_number() OVER (ORDER BY first_at, user_id) - 1 AS user_idx FROM seen",
    )
)
def dense_user_index(spark, folder):
    out = dense_index(seen_users(spark, folder), ["first_at", "user_id"], "user_idx")
    return out.select("user_id", "user_idx")


@query(
    """SELECT 'user' AS kind, CAST(o_custkey AS VARCHAR) AS id FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey
    UNION ALL SELECT 'item', CAST(l_partkey AS VARCHAR) FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey"""
)
def distinct_ids(spark, folder):
    rows = retail.purchases(spark, folder)
    found = [
        rows.select(F.lit(kind).alias("kind"), F.col(col).alias("id")).distinct()
        for kind, col in (("user", "user_id"), ("item", "item_id"))
    ]
    return found[0].unionByName(found[1])


@query(
    """SELECT l_orderkey AS order_no, l_linenumber::BIGINT AS line_no, CAST(l_partkey AS VARCHAR) AS item_id,
      CAST(o_custkey AS VARCHAR) AS user_id, l_suppkey AS supplier
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    WHERE p_size > 10"""
)
def id_map_join(spark, folder):
    """String keys to ids through maps read from JSON; small parts are not mapped."""
    lines = retail.purchases(spark, folder).select(
        F.concat(F.lit("U"), "user_id").alias("user_key"),
        F.concat(F.lit("I"), "item_id").alias("item_key"),
        F.col("l_orderkey").alias("order_no"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.col("l_suppkey").alias("supplier"),
    )
    part = retail.table(spark, folder, "part").filter(F.col("p_size") > 10)
    cust = retail.table(spark, folder, "customer")
    item_map = part.select(
        F.concat(F.lit("I"), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_partkey").cast("string").alias("id"),
    )
    user_map = cust.select(
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("key"),
        F.col("c_custkey").cast("string").alias("id"),
    )
    # one object with both maps, a line per member; the members are written in one task, and read by many
    path = fresh_path(spark, "id-maps")
    sections = [("user2id", user_map), ("item2id", item_map)]
    members = None
    for no, (name, pairs) in enumerate(sections):
        head = spark.range(1).select(F.lit(3 * no).alias("part"), F.lit("").alias("key"), F.lit(("{" if no == 0 else ",") + f'"{name}": {{').alias("value"))
        least = pairs.agg(F.min("key").alias("least")).scalar()
        body = pairs.select(
            F.lit(3 * no + 1).alias("part"), "key",
            F.concat(F.when(F.col("key") == least, "").otherwise(","), F.regexp_extract(F.to_json(F.create_map("key", "id")), r"^\{(.*)\}$", 1)).alias("value"))
        foot = spark.range(1).select(F.lit(3 * no + 2).alias("part"), F.lit("").alias("key"), F.lit("}" if no == 0 else "}}").alias("value"))
        part = head.unionByName(body).unionByName(foot)
        members = part if members is None else members.unionByName(part)
    members.coalesce(1).sortWithinPartitions("part", "key").select("value").write.text(path)
    maps = raw.read_id_maps(spark, path)
    rows = hist_ops.map_ids(lines, "user_key", maps["user2id"], "user_id", strict=True)
    rows = hist_ops.map_ids(rows, "item_key", maps["item2id"], "item_id")
    return rows.select("order_no", "line_no", "item_id", "user_id", "supplier")


@query(
    with_ctes(
        USERS,
        """SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n_orders,
          any_value(CASE WHEN o_custkey % 5 = 0 THEN '' ELSE user_name END) AS user_name,
          any_value(CASE WHEN o_custkey % 5 = 0 THEN '' ELSE user_key END) AS user_key
        FROM orders LEFT JOIN users ON user_id = CAST(o_custkey AS VARCHAR) GROUP BY o_custkey""",
    )
)
def user_name_lookup(spark, folder):
    """Every fifth user is missing in the name table, which is written as a JSON file and read back."""
    counts = (
        retail.table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("user_id"))
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    known = retail.users(spark, folder).filter(F.col("user_id").cast("bigint") % 5 != 0)
    path = fresh_path(spark, "user-names")
    known.select("user_id", "user_name").write.json(path)
    names = raw.read_user_names(spark, path, "json").join(known.select("user_id", "user_key"), "user_id")
    return hist_ops.add_users(counts, names)


def dict_lines(spark, folder):
    """Metadata lines as dict literals: both quote styles, None, u'' and broken lines."""
    part = retail.table(spark, folder, "part")
    key = F.col("p_partkey")
    return part.select(
        F.when(key % 19 == 0, F.concat(F.lit("{'asin': 'I"), key.cast("string"), F.lit("', 'title': ")))
        .otherwise(
            F.concat(
                F.lit("{'asin': 'I"),
                key.cast("string"),
                F.lit("', 'title': u\""),
                F.col("p_name"),
                F.lit("'s\", 'description': None, 'categories': [['"),
                F.col("p_brand"),
                F.lit("', '"),
                F.col("p_type"),
                F.lit("'], ['other']], 'inStock': True"),
                F.when(key % 3 == 0, F.lit("")).otherwise(
                    F.concat(F.lit(", 'price': "), F.col("p_size").cast("string"))
                ),
                F.lit("}"),
            )
        )
        .alias("value")
    )


@query(
    """SELECT 'I' || CAST(p_partkey AS VARCHAR) AS item_key, p_name || '''s' AS title, '' AS description,
      p_brand || '|' || p_type AS categories, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS price,
      '' AS imurl, '' AS brand
    FROM part WHERE p_partkey % 19 <> 0"""
)
def dict_literal_items(spark, folder):
    path = fresh_path(spark, "metadata")
    dict_lines(spark, folder).write.option("compression", "gzip").text(path)
    items = raw.clean_items(raw.read_item_metadata(spark, path))
    return items.withColumn("categories", F.array_join("categories", "|"))


@query("SELECT count(*) AS n_bad FROM part WHERE p_partkey % 19 = 0")
def dict_literal_rejects(spark, folder):
    parsed = raw.parse_dict_literals(dict_lines(spark, folder))
    return parsed.agg(F.count("bad_line").alias("n_bad"))


PUBLISHED = """published AS (
  SELECT 'train' AS split, * FROM hist WHERE n >= 3 AND pos < n - 2
  UNION ALL SELECT 'validation', * FROM hist WHERE n >= 3 AND pos < n - 1
  UNION ALL SELECT 'test', * FROM hist WHERE n >= 2)"""


@query(
    with_ctes(
        HISTORY,
        PUBLISHED,
        """SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, sum(rating)::BIGINT AS ratings,
          count(CASE WHEN (split = 'test' AND pos = n - 1) OR (split = 'validation' AND pos = n - 2) THEN 1 END)
            AS n_targets
        FROM published GROUP BY split""",
    )
)
def split_publish(spark, folder):
    out = None
    for name, rows in layout.named_splits(history(spark, folder)).items():
        one = rows.withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    users = out.groupBy("split", "user_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("rating").alias("ratings"),
        F.count_if(F.col("part") == "target").alias("n_targets"),
    )
    return users.groupBy("split").agg(
        F.sum("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_users"),
        F.sum("ratings").alias("ratings"),
        F.sum("n_targets").alias("n_targets"),
    )


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, pos, item_id, rating, CASE WHEN pos = n - 2 THEN 'target' ELSE 'input' END AS part
        FROM hist WHERE n >= 3 AND pos < n - 1""",
    )
)
def split_roundtrip(spark, folder):
    """All splits written as Parquet partitions, the validation split read back."""
    path = fresh_path(spark, "splits")
    layout.save_splits(history(spark, folder), path)
    rows = layout.load_split(spark, path, "validation")
    return rows.select("user_id", "pos", "item_id", "rating", "part")


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS user_id, l_orderkey AS order_no, CAST(l_partkey AS VARCHAR) AS item_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 100"""
)
def dev_subset(spark, folder):
    rows = retail.purchases(spark, folder)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return layout.first_rows(rows, order, 100).select(
        "user_id", F.col("l_orderkey").alias("order_no"), "item_id"
    )


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, string_agg(item_id, ' ' ORDER BY pos) FILTER (pos < n - 1) AS input_item_seq,
          string_agg(CAST(rating AS VARCHAR), ' ' ORDER BY pos) FILTER (pos < n - 1) AS input_rating_seq,
          any_value(item_id) FILTER (pos = n - 1) AS gt_item, 1::BIGINT AS n_targets
        FROM hist WHERE n > 1 GROUP BY user_id""",
    )
)
def split_columns(spark, folder):
    """List columns input_*_seq and one-element gt_* lists; long lists are joined from segments."""
    fields = ["item_id", "rating"]
    rows = splits.split_rows(history(spark, folder), "test")
    segs = splits.segments(rows.filter(F.col("part") == "input"), fields).withColumnRenamed("seq", "input")
    ends = splits.targets(rows, "test", fields).drop("epoch")
    flat = splits.flat_columns(segs.join(ends, "user_id"), fields)
    keys = ["user_id", "gt_item"]
    items = splits.whole_texts(flat, keys, F.array_join("input_item_seq", " "), " ", "input_item_seq")
    ratings = splits.whole_texts(flat, keys, F.array_join(F.col("input_rating_seq").cast("array<string>"), " "), " ", "input_rating_seq")
    return items.join(ratings, keys).select(
        "user_id", "input_item_seq", "input_rating_seq",
        F.get("gt_item", F.lit(0)).alias("gt_item"), F.size("gt_item").cast("bigint").alias("n_targets"),
    )


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, string_agg(item_id || ':' || rating, ' ' ORDER BY pos) AS cells FROM hist GROUP BY user_id""",
    )
)
def history_reshape(spark, folder):
    """Lists to rows and back; a long history is several lists."""
    seqs = splits.segments(history(spark, folder), ["item_id", "rating"])
    lists = seqs.select(
        "user_id",
        "segment_no",
        F.col("seq.pos").alias("spot"),
        F.col("seq.item_id").alias("items"),
        F.col("seq.rating").alias("ratings"),
    )
    rows = splits.zip_columns(lists, ["spot", "items", "ratings"])
    back = splits.gather_columns(rows, ["user_id", "segment_no"], "spot", ["items", "ratings"])
    cells = F.zip_with("items", "ratings", lambda a, b: F.concat(a, F.lit(":"), b.cast("string")))
    return splits.whole_texts(back, ["user_id"], F.array_join(cells, " "), " ", "cells")


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, coalesce(string_agg(item_id, ' ' ORDER BY pos) FILTER (pos BETWEEN 1 AND 3), '') AS middle,
          any_value(item_id) FILTER (pos = 1) AS second FROM hist GROUP BY user_id""",
    )
)
def history_subsequence(spark, folder):
    """Elements 1..3 and element 1 of every history; they are in its first segment."""
    seqs = splits.segments(history(spark, folder), ["item_id"]).filter(F.col("segment_no") == 0)
    ids = F.col("seq.item_id")
    return seqs.select(
        "user_id",
        F.array_join(text.sub_sequence(ids, F.lit(1), F.lit(3)), " ").alias("middle"),
        text.element(ids, F.lit(1)).alias("second"),
    )


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, string_agg(item_id, ' ' ORDER BY pos) || ' end' AS whole,
          coalesce(string_agg(item_id, ' ' ORDER BY pos) FILTER (pos <> 1) || ' end', 'end') AS without_second
        FROM hist WHERE n > 1 GROUP BY user_id""",
    )
)
def history_append_remove(spark, folder):
    """An element appended to every history (to its last segment), the second one removed (from its first)."""
    rows = history(spark, folder).filter(F.col("n") > 1)
    seqs = splits.segments(rows, ["item_id", "n"])
    is_last = F.element_at("seq", -1)["pos"] == F.element_at("seq", -1)["n"] - 1
    whole = F.when(is_last, F.array_append("seq.item_id", F.lit("end"))).otherwise(F.col("seq.item_id"))
    less = F.when(F.col("segment_no") == 0, text.remove_at(whole, F.lit(1))).otherwise(whole)
    parts = seqs.withColumns({"whole": F.array_join(whole, " "), "less": F.array_join(less, " ")})
    return splits.whole_texts(parts, ["user_id"], F.col("whole"), " ", "whole").join(
        splits.whole_texts(parts, ["user_id"], F.col("less"), " ", "without_second"), "user_id"
    )


@query(
    with_ctes(
        HISTORY,
        """SELECT count(*) AS n_users, count(CASE WHEN n < 15 THEN 1 END) AS n_short,
          sum(unrated)::BIGINT AS n_unrated FROM (
          SELECT user_id, count(*) AS n, count(CASE WHEN rating = 5 THEN 1 END) AS unrated
          FROM hist GROUP BY user_id)""",
    )
)
def history_guard(spark, folder):
    """Users under 15 rows and unrated positions (five-star ratings are blanked here)."""
    rows = retail.purchases(spark, folder).withColumn(
        "rating", F.when(F.col("rating") < 5, F.col("rating"))
    )
    return hist_ops.history_quality(rows, wanted=15)


@query(
    with_ctes(
        HISTORY,
        """SELECT user_id, pos, item_id, next_item FROM hist WHERE next_item IS NOT NULL""",
    )
)
def history_next_pairs(spark, folder):
    rows = retail.interactions(spark, folder, lead={"next_item": "item_id"})
    return rows.filter(F.col("next_item").isNotNull()).select("user_id", "pos", "item_id", "next_item")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS item_id, value AS score,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
      count(*) OVER (PARTITION BY user_id) AS n FROM events"""
)
def event_history(spark, folder):
    """A second domain: events ordered by their time stamp."""
    rows = retail.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("item_id"),
        F.col("value").alias("score"),
        "ts",
        "event_id",
    )
    return number_rows(rows, ["user_id"], ["ts", "event_id"]).drop("ts", "event_id")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS item_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
      count(*) OVER (PARTITION BY user_id) AS n,
      dense_rank() OVER (ORDER BY event_type) - 1 AS item_idx FROM events"""
)
def registered_dataset(spark, folder):
    """A dataset of events is registered, found by name in any letter case, and saved and loaded."""

    def read(spark, path):
        items = retail.table(spark, path, "events").select(F.col("event_type").alias("item_id")).distinct()
        rows = event_history(spark, path).withColumn("rating", F.lit(None).cast("bigint"))
        empty = {c: F.lit("") for c in ("title", "description", "price", "imurl", "brand")}
        users = rows.select("user_id").distinct().withColumns({"user_name": F.lit(""), "user_key": F.col("user_id")})
        return dataset.Dataset(rows, items.withColumns(empty).withColumn("categories", F.array("item_id")), users)

    dataset.register_dataset("Events", read)
    try:
        path = fresh_path(spark, "dataset")
        dataset.find_dataset("EVENTS")(spark, folder).save(path)
        found = dataset.find_dataset("saved")(spark, path)
        rows = found.interactions.join(found.all_items(), "item_id")
        return rows.select("user_id", "item_id", "pos", "n", F.col("item_idx").cast("bigint").alias("item_idx"))
    finally:
        dataset.DATASETS.pop("Events")
