"""Readers for the raw input files: sequence log, ratings, id maps, names, metadata."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.storage import broadcast_if_small

ID_MAPS = ("user2id", "item2id", "id2user", "id2item")
ITEM_FIELDS = "asin string, title string, description string, categories array<string>, price string, imUrl string, brand string"


def parse_sequence_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """``user item item ...`` lines to rows (user_id, pos, n, item_id).

    Tokens are separated by any white space.  Positions come from the line itself, so
    no shuffle is needed.
    """
    tokens = lines.select(F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ").alias("t"))
    named = tokens.filter(F.get("t", F.lit(0)) != "").select(
        F.get("t", F.lit(0)).alias("user_id"),
        (F.size("t") - 1).cast("bigint").alias("n"),
        F.slice("t", F.lit(2), F.size("t")).alias("seq"),
    )
    return named.select("user_id", "n", F.posexplode("seq").alias("pos", "item_id")).select(
        "user_id", F.col("pos").cast("bigint").alias("pos"), "n", "item_id"
    )


def read_sequence_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_sequence_log(spark.read.text(path))


def union_ratings(parts: list[DataFrame]) -> DataFrame:
    """Concatenate rating lists; ``part`` keeps their order (train, val, test)."""
    out = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("part", F.lit(i).cast("bigint"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def read_ratings(spark: SparkSession, paths: list[str], fmt: str = "parquet", order: str | None = "ord") -> DataFrame:
    """Rating records (reviewerID, asin, overall) of several lists, in order of occurrence.

    ``order`` names the column with a record's place in its list; a record without a place
    fails the job.  ``None`` takes the place in the files: name of the file, start of the
    block, row in it.  ``ord`` is comparable in either case.
    """
    schema = "reviewerID string, asin string, overall double" + (f", {order} bigint" if order else "")

    def place() -> Column:
        if order:
            missing = F.raise_error(F.lit("a rating has no place in its list; read it with order=None"))
            return F.when(F.col(order).isNull(), missing.cast("bigint")).otherwise(F.col(order))
        return F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        )

    return union_ratings(
        [
            spark.read.schema(schema).format(fmt).option("header", "true").load(p).select(
                place().alias("ord"),
                F.col("reviewerID").alias("user_key"),
                F.col("asin").alias("item_key"),
                F.col("overall").cast("int").cast("bigint").alias("rating"),
            )
            for p in paths
        ]
    )


def parse_id_maps(docs: DataFrame, value: str = "value") -> dict[str, DataFrame]:
    """One JSON text with four maps to four (key, id) tables."""
    fields = ", ".join(f"{m}: map<string,string>" for m in ID_MAPS)
    parsed = docs.select(F.from_json(value, f"struct<{fields}>").alias("maps"))
    return {m: parsed.select(F.explode(f"maps.{m}").alias("key", "id")) for m in ID_MAPS}


# An entry that opens a section ("name": {...), and the braces that close one.
_OPENS = r'^[\s{]*"((?:[^"\\]|\\.)*)"\s*:\s*\{'
_CLOSES = r"\}[\s}]*$"


def scan_object(spark: SparkSession, path: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """The members of the objects in one large JSON object: (section, place, entry).

    ``names`` are the sections wanted; without it all are read.

    ``{"a": {"k": "v", ...}, "b": {...}}`` gives ``"k": "v"`` with section ``a``.  The file is
    split like any text, with the comma as the record separator, so many tasks read
    it.  What a record cannot know by itself is added by sums over the file's splits: whether
    it begins inside a string (the quotes before it are odd), in which case it is joined to
    the record before, and which section was opened last.
    """
    text = spark.read.option("lineSep", ",").text(path).select(
        F.col("value").alias("piece"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    bare = F.regexp_replace("piece", r"\\.", "")  # without escaped characters
    quotes = F.char_length(bare) - F.char_length(F.translate(bare, '"', ""))
    marked = text.withColumn("odd", quotes % 2)
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row per split
    splits = marked.groupBy("block").agg(F.sum("odd").alias("odds")).select("block", F.coalesce(F.sum("odds").over(before), F.lit(0)).alias("odd_before"))
    inside = W.partitionBy("block").orderBy("row").rowsBetween(W.unboundedPreceding, -1)  # a split's records
    opened = (F.coalesce(F.sum("odd").over(inside), F.lit(0)) + F.col("odd_before")) % 2 == 0
    placed = marked.join(splits, "block").select("piece", "block", "row", opened.alias("opens"))
    # A record that begins inside a string belongs to the last one that does not, maybe of an earlier split.
    start = F.when(F.col("opens"), F.struct("block", "row"))
    last = placed.groupBy("block").agg(F.max(start).alias("last_start"))
    carried = last.select("block", F.last("last_start", ignorenulls=True).over(before).alias("carried"))
    upto = W.partitionBy("block").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    owned = placed.join(carried, "block").select(
        "piece", F.struct("block", "row").alias("at"), F.coalesce(F.last(start, ignorenulls=True).over(upto), F.col("carried")).alias("place"))
    whole = F.array_join(F.sort_array(F.collect_list(F.struct("at", "piece")))["piece"], ",")  # the pieces of one entry
    entries = owned.groupBy("place").agg(whole.alias("entry"))
    found = entries.select(
        "place", F.regexp_extract("entry", _OPENS, 1).alias("name"), F.col("entry").rlike(_OPENS).alias("heads"),
        F.col("entry").rlike(_CLOSES).alias("ends"), F.trim(F.regexp_replace(F.regexp_replace("entry", _OPENS, ""), _CLOSES, "")).alias("entry"))
    # One row per section, with the places of its first and its last entry.
    edges = found.filter("heads OR ends").select("place", "heads", "ends", "name")
    order = W.orderBy("place")
    sections = edges.filter("heads").select(F.col("place").alias("first_place"), F.lead("place").over(order).alias("next_place"), F.col("name").alias("section"))
    ends = edges.filter("ends").select(F.col("place").alias("end_place"))
    sections = sections.join(ends, (F.col("end_place") >= F.col("first_place")) & (F.col("next_place").isNull() | (F.col("end_place") < F.col("next_place"))), "left")
    sections = sections.groupBy("first_place", "next_place", "section").agg(F.min("end_place").alias("end_place"))
    within = (F.col("place") >= F.col("first_place")) & (F.col("end_place").isNull() | (F.col("place") <= F.col("end_place"))) & (
        F.col("next_place").isNull() | (F.col("place") < F.col("next_place")))
    if names is not None:
        sections = sections.filter(F.col("section").isin(*names))
    # as many rows as the object has sections
    return found.join(broadcast_if_small(sections), within).filter("entry != ''").select("section", "place", "entry")


def read_id_maps(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four maps of one JSON object, however large, as (key, id) tables."""
    entries = scan_object(spark, path, ID_MAPS)
    parsed = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), "map<string,string>")
    said = F.raise_error(F.concat(F.lit("not a member of an id map: "), F.col("entry")))
    pairs = entries.select("section", F.explode(F.coalesce(parsed, said.cast("map<string,string>"))).alias("key", "id"))
    return {m: pairs.filter(F.col("section") == m).select("key", "id") for m in ID_MAPS}


def read_user_names(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema("user_id string, user_name string").format(fmt).load(path)


def parse_dict_literals(lines: DataFrame, value: str = "value") -> DataFrame:
    """Metadata lines written as Python dict literals to typed rows.

    Literals are evaluated safely (no code runs).  A line that is not a dict literal
    gives a row with its text in ``bad_line``.  Of nested category lists the first
    inner list is kept.
    """

    def run(batches: Iterator):
        import ast

        import pandas as pd

        names = ["title", "description", "price", "imUrl", "brand"]

        def read(line):
            try:
                raw = ast.literal_eval(line)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                raw = None
            if not isinstance(raw, dict) or "asin" not in raw:
                return {"bad_line": line}
            groups = raw.get("categories")
            first = groups[0] if groups and isinstance(groups[0], (list, tuple)) else groups
            row = {f: None if raw.get(f) is None else str(raw[f]) for f in names}
            row["asin"] = str(raw["asin"])
            row["categories"] = None if first is None else [str(c) for c in first]
            return row

        columns = ["asin", "title", "description", "categories", "price", "imUrl", "brand", "bad_line"]
        for batch in batches:
            rows = [read(v) for v in batch[value]]
            yield pd.DataFrame(
                {c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns}
            )

    return lines.select(value).mapInPandas(run, f"{ITEM_FIELDS}, bad_line string")


def read_item_metadata(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """Gzip text of dict literals.  A gzip file is one task, so rows are spread first."""
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parse_dict_literals(spark.read.text(path).repartition(tasks))


def clean_items(parsed: DataFrame) -> DataFrame:
    """Valid metadata rows with absent fields as empty text / empty list."""
    blank = F.lit("")

    def filled(name: str, alias: str | None = None) -> Column:
        return F.coalesce(F.col(name).cast("string"), blank).alias(alias or name)

    return parsed.filter(F.col("asin").isNotNull()).select(
        F.col("asin").alias("item_key"),
        filled("title"),
        filled("description"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        filled("price"),
        filled("imUrl", "imurl"),
        filled("brand"),
    )
