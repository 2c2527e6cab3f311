"""Pieces shared by the registered queries: inputs, SQL fragments, the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import splits
from basketry.sources import retail

SEED = 42

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def with_ctes(*parts: str) -> str:
    """``WITH`` clause; the last part is the final SELECT."""
    *ctes, final = parts
    return "WITH " + ",\n".join(dict.fromkeys(ctes)) + "\n" + final


def draw_sql(*parts) -> str:
    """SQL text of ``draws.draw``: strings are SQL expressions, numbers are literals."""
    joined = " || '|' || ".join(
        f"CAST({p} AS VARCHAR)" if isinstance(p, str) else f"'{p}'" for p in parts
    )
    return f"CAST('0x' || substr(md5({joined}), 1, 12) AS BIGINT)"


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


HISTORY = """hist AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
    1 + (CAST(l_quantity AS BIGINT) - 1) % 5 AS rating,
    row_number() OVER w - 1 AS pos,
    count(*) OVER (PARTITION BY o_custkey) AS n,
    lead(CAST(l_partkey AS VARCHAR)) OVER w AS next_item
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber,
               l_partkey, l_suppkey, l_shipdate))"""

ITEMS = """items AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_partkey AS item_no,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS title,
    p_type AS description, [p_brand, p_type, 'SIZE_' || CAST(p_size AS VARCHAR)] AS categories,
    p_retailprice AS price, '' AS imurl, p_brand AS brand,
    row_number() OVER (ORDER BY p_partkey) - 1 AS item_idx
  FROM part)"""

USERS = """users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
    CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS user_name,
    'U' || CAST(c_custkey AS VARCHAR) AS user_key
  FROM customer)"""


def next_item_ctes(n: int = 10) -> list[str]:
    return [
        HISTORY,
        """pairs AS (
  SELECT item_id, CASE WHEN pos < n - 2 THEN next_item END AS next_item
  FROM hist WHERE n >= 2 AND pos < n - 1)""",
        f"""popular AS (
  SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank
  FROM pairs GROUP BY item_id QUALIFY rank <= {2 * n})""",
        f"""followers AS (
  SELECT item_id, next_item, row_number() OVER (PARTITION BY item_id
           ORDER BY count(*) DESC, next_item) AS rank
  FROM pairs WHERE next_item IS NOT NULL GROUP BY item_id, next_item QUALIFY rank <= {n})""",
        """last_bought AS (
  SELECT user_id, item_id, next_item AS truth FROM hist WHERE n >= 2 AND pos = n - 2)""",
        f"""ranked AS (
  SELECT user_id, answer, row_number() OVER (PARTITION BY user_id ORDER BY src, r) AS rank FROM (
    SELECT l.user_id, f.next_item AS answer, 0 AS src, f.rank AS r
    FROM last_bought l JOIN followers f USING (item_id)
    UNION ALL
    SELECT l.user_id, p.item_id, 1, p.rank FROM last_bought l, popular p
    WHERE NOT EXISTS (SELECT 1 FROM followers f
                      WHERE f.item_id = l.item_id AND f.next_item = p.item_id))
  QUALIFY rank <= {n})""",
    ]


def history(spark, folder, items=None, lead=None):
    return retail.interactions(spark, folder, items, lead)


def followed(spark, folder):
    return retail.interactions(spark, folder, lead={"next_item": "item_id"})


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


def rounded(what, columns: list[str] | None = None, digits: int = 6):
    """Round a query's DOUBLE columns: a DataFrame, or SQL text with the column names.

    Sums of doubles depend on the order of addition in their last bits.
    """
    if columns is None:
        doubles = [c for c, t in what.dtypes if t == "double"]
        return what.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles})
    replaced = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({what})"


def history_examples(spark, folder, item, separator):
    """user_id, input (a text of all items but the last), target STRUCT, for users with two rows or more."""
    rows = splits.split_rows(history(spark, folder), "test")
    fields = ["item_id", "rating"]
    segs = splits.segments(rows.filter(F.col("part") == "input"), fields)
    inputs = splits.whole_texts(segs, ["user_id"], F.array_join(F.transform("seq", item), separator), separator, "input")
    return inputs.join(splits.targets(rows, "test", fields).drop("epoch"), "user_id")
