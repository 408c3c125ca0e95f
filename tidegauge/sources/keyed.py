"""Tables kept by a key: vector store and label cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VECTOR_KEY = ["content_hash", "model", "representation"]


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that is last in order."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*").select(*df.columns)


def upsert(store: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """store with the rows of new put in place of those with their key."""
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def lookup_vectors(requests: DataFrame, store: DataFrame, dimension: int) -> DataFrame:
    """requests with vector (null: a miss); an error if a stored one has another dimension."""
    stored = store.select(*VECTOR_KEY, F.when(F.col("dimension") == dimension, F.col("vector")).otherwise(F.raise_error(F.lit("a stored vector has another dimension"))).alias("vector"))
    return requests.join(stored, VECTOR_KEY, "left")


def missing(requests: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """The requests without a row in store."""
    return requests.join(store.select(*key), key, "left_anti")


def split_cached(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """rows with the cached values, and pending: no value is cached."""
    mark = cache.withColumn("_hit", F.lit(True))
    return rows.join(mark, key, "left").withColumn("pending", F.col("_hit").isNull()).drop("_hit")
