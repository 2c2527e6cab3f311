"""A dataset: numbered history rows with their item and user tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import history as hist
from basketry.operators import sampling
from basketry.operators.numbering import dense_index
from basketry.sources import layout, raw

ITEM_FIELDS = ["title", "description", "categories", "price", "imurl", "brand"]


@dataclass(frozen=True)
class Dataset:
    """``interactions`` (user_id, pos, n, item_id, rating), ``items`` and ``users``."""

    interactions: DataFrame
    items: DataFrame
    users: DataFrame

    def all_users(self) -> DataFrame:
        """Distinct users with a dense index."""
        return dense_index(self.interactions.select("user_id").distinct(), ["user_id"], "user_idx")

    def all_items(self) -> DataFrame:
        """Distinct items of the histories with a dense index."""
        return dense_index(self.interactions.select("item_id").distinct(), ["item_id"], "item_idx")

    def denormalised(self, strict: bool = False) -> DataFrame:
        """History rows with the item fields and the user name and key."""
        rows = hist.add_items(self.interactions, self.items, ITEM_FIELDS, strict)
        return hist.add_users(rows, self.users)

    def splits(self, merge_train_val: bool = False) -> dict[str, DataFrame]:
        return layout.named_splits(self.interactions, merge_train_val)

    def sample(self, epochs: int, seed: int) -> DataFrame:
        """Fresh training windows for every epoch, in row form."""
        windows = sampling.training_windows(self.interactions, epochs, seed)
        return sampling.window_rows(self.interactions, windows)

    def save(self, path: str) -> None:
        """Splits, full history, items and users as Parquet below ``path``."""
        layout.save_splits(self.interactions, f"{path}/splits")
        for name in ("interactions", "items", "users"):
            getattr(self, name).write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Dataset:
    return Dataset(*[spark.read.parquet(f"{path}/{n}") for n in ("interactions", "items", "users")])


def from_tables(
    log: DataFrame,
    ratings: DataFrame,
    maps: dict[str, DataFrame],
    names: DataFrame,
    metadata: DataFrame,
    *,
    prefix: bool = True,
    start_1001: bool = False,
) -> Dataset:
    """Dataset from a sequence log, ratings by string key, id maps, names and metadata.

    Ratings with an unknown key fail the job; ratings of items outside the history are
    ignored; metadata is kept for mapped items only.
    """
    rated = hist.map_ids(ratings, "user_key", maps["user2id"], "user_id", strict=True)
    rated = hist.map_ids(rated, "item_key", maps["item2id"], "item_id", strict=True)
    rows = hist.attach_ratings(log, rated.select("user_id", "item_id", "rating", "part", "ord"))
    items = hist.map_ids(hist.known_items(metadata, maps["item2id"]), "item_key", maps["item2id"], "item_id")
    keys = maps["id2user"].select(F.col("key").alias("user_id"), F.col("id").alias("user_key"))
    users = log.select("user_id").distinct().join(names, "user_id", "left").join(keys, "user_id", "left")
    users = users.withColumns({c: F.coalesce(c, F.lit("")) for c in ("user_name", "user_key")})

    # display ids: shift first, then prefix; the raw ids stay beside them
    rows = hist.display_ids(rows, prefix, start_1001)
    shown = hist.shift_ids(F.col("item_id")) if start_1001 else F.col("item_id")
    items = items.withColumn("item_raw", F.col("item_id")).withColumn(
        "item_id", F.concat(F.lit("item_"), shown) if prefix else shown
    )
    if prefix:
        users = users.withColumn("user_id", F.concat(F.lit("user_"), "user_id"))
    return Dataset(rows, items, users)


def from_files(
    spark: SparkSession,
    folder: str,
    *,
    ratings_format: str = "json",
    ratings_order: str | None = "ord",
    names_format: str = "json",
    **options,
) -> Dataset:
    """Read sequential_data.txt, datamaps.json, meta.json.gz, ratings/{train,val,test}, user_names.

    ``ratings_order=None`` is for rating files whose line order is the order of the ratings.
    """
    ratings = [f"{folder}/ratings/{part}" for part in ("train", "val", "test")]
    return from_tables(
        raw.read_sequence_log(spark, f"{folder}/sequential_data.txt"),
        raw.read_ratings(spark, ratings, ratings_format, ratings_order),
        raw.read_id_maps(spark, f"{folder}/datamaps.json"),
        raw.read_user_names(spark, f"{folder}/user_names", names_format),
        raw.clean_items(raw.read_item_metadata(spark, f"{folder}/meta.json.gz")),
        **options,
    )


DATASETS: dict[str, Callable[..., Dataset]] = {"files": from_files, "saved": load}


def dataset_names() -> list[str]:
    return list(DATASETS)


def find_dataset(name: str) -> Callable[..., Dataset]:
    """Registered reader by name, any letter case."""
    for known, read in DATASETS.items():
        if known.lower() == name.lower():
            return read
    raise KeyError(f"no dataset is registered as {name!r}")


def register_dataset(name: str, read: Callable[..., Dataset]) -> None:
    DATASETS[name] = read
