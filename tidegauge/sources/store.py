"""A table kept by key on shared storage, in buckets: an upsert rewrites the buckets it touches and no other.

    path/data/<version>/rows/_bucket=<b>/   rows; a version holds the buckets that one upsert wrote
    path/commits/<n>/                       (bucket, version) of every bucket in use after n upserts

A commit is one small file put in place after its data, so a reader sees all of an
upsert or none, and one that fails leaves the store as it was. One writer at a
time; readers need not wait. Old versions stay until vacuum().
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.schemas import require
from tidegauge.sources.keyed import upsert


class KeyedStore:
    """Rows of a schema, one for each key; of rows with equal keys the last in `order` stays.

    A key has no map columns; nulls in it are a value of their own. Rows that tie in `order` go by
    their hash; between upserts the later one's row stays whatever its order. The number of buckets is fixed when a
    store is made: about the rows expected over the rows worth rewriting at once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.schema = spark.createDataFrame([], schema).schema
        require(spark.createDataFrame([], self.schema), *key, order)
        if {"_bucket", "_new", "_n"} & set(self.schema.names):
            raise ValueError("_bucket, _new and _n are the store's own columns")

    def _bucket(self) -> Column:
        # names the place of nulls, which xxhash64 skips
        parts = [x for c in self.key for x in (F.col(c).isNull(), F.col(c))]
        return F.pmod(F.xxhash64(*parts), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _delete(self, part: str) -> None:
        fs, where = self._fs(f"{self.path}/{part}")
        fs.delete(where, True)

    def _commits(self) -> list[int]:
        """The commits that are whole, oldest first."""
        fs, where = self._fs(f"{self.path}/commits")
        if not fs.exists(where):
            return []
        found = sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())
        return [n for n in found if fs.exists(self._fs(f"{self.path}/commits/{n}/_SUCCESS")[1])]

    def _versions(self, commit: int | None = None) -> tuple[int, dict[int, str]]:
        """(commit, bucket -> version); a row a bucket, so as many as the store was made with."""
        known = self._commits()
        commit = (known[-1] if known else 0) if commit is None else commit
        if commit == 0:
            return 0, {}
        if commit not in known:
            raise ValueError(f"no commit {commit}")
        rows = self.spark.read.schema("bucket int, version string, buckets int").parquet(f"{self.path}/commits/{commit}").collect()
        if rows and rows[0]["buckets"] != self.buckets:
            raise ValueError(f"the store has {rows[0]['buckets']} buckets, not {self.buckets}")
        return commit, {r["bucket"]: r["version"] for r in rows}

    def _rows(self, versions: dict[int, str]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{v}/rows/_bucket={b}" for b, v in sorted(versions.items())))

    def read(self, commit: int | None = None) -> DataFrame:
        """The rows as of the newest commit, or of an earlier one."""
        return self._rows(self._versions(commit)[1])

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only the buckets that hold them are read."""
        _, versions = self._versions()
        wanted = keys.select(*self.key).distinct()
        touched = {r[0] for r in wanted.select(self._bucket()).distinct().collect()}
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in self.key]
        return self._rows({b: v for b, v in versions.items() if b in touched}).alias("s").join(wanted.alias("k"), same, "left_semi")

    def upsert(self, new: DataFrame) -> int:
        """Puts new's rows in place of those with their keys; returns the commit, the same as before if new is empty."""
        commit, versions = self._versions()
        version = uuid.uuid4().hex
        arriving = f"{self.path}/data/{version}/arriving"
        # One row a key by partial aggregation, so that no key is hot; written since new may be costly or read this store.
        rest = [c for c in self.schema.names if c not in self.key]
        last = F.max_by(F.struct(*rest), F.struct(self.order, F.xxhash64(*rest)))
        one = new.select(*self.schema.names).to(self.schema).groupBy(*self.key).agg(last.alias("_r")).select(*self.key, "_r.*")
        one.select(*self.schema.names).write.parquet(arriving)
        new = self.spark.read.schema(self.schema).parquet(arriving)
        touched = sorted(r[0] for r in new.select(self._bucket()).distinct().collect())
        if not touched:
            self._delete(f"data/{version}")
            return commit
        old = self._rows({b: versions[b] for b in touched if b in versions})
        merged = upsert(old, new, self.key, self.order).withColumn("_bucket", self._bucket())
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{version}/rows")
        now = versions | dict.fromkeys(touched, version)
        rows = [(b, v, self.buckets) for b, v in sorted(now.items())]
        self.spark.createDataFrame(rows, "bucket int, version string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{commit + 1}")
        self._delete(f"data/{version}/arriving")
        return commit + 1

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what only commits before the last `keep` use, and what failed upserts left; returns the folders deleted."""
        known = self._commits()
        kept = known[-max(keep, 1) :]
        used = {v for n in kept for v in self._versions(n)[1].values()}
        gone = 0
        for part, stays in (("data", used), ("commits", {str(n) for n in kept})):
            fs, where = self._fs(f"{self.path}/{part}")
            for s in fs.listStatus(where) if fs.exists(where) else []:
                if s.getPath().getName() not in stays:
                    gone += fs.delete(s.getPath(), True)
        return gone
