"""Places that driver and executors share, and staging of intermediate tables there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words.
SPACE = r"[\x20\x09-\x0D]"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20  # of the rows that go to Python together


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        given = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Cuts the lineage, and a lost executor costs no recomputation of what is
    written. All later readers see one and the same set of rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_join(many: DataFrame, one: DataFrame, key: str, how: str = "left", shares: int = 1000) -> DataFrame:
    """many joined to one (a row for each key), where keys with more than a share of many are dealt out.

    many is a staged table. A key is hot above 1/shares of its rows, so that at
    most `shares` keys are, whatever the size; only they are broadcast, and only
    their rows of one are repeated, once for each share.
    """
    share = max(1, many.count() // shares)
    hot = many.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > share).select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1))).cast("int")
    left = many.join(F.broadcast(hot), key, "left").withColumn("_salt", spread).drop("_salts")
    right = one.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python and back in Arrow batches of about BATCH_BYTES; a user's own limit stays.

    Spark's own is 64 MB, and a batch is held several times: by the engine on
    both ways, by the worker as it came, as strings and as it leaves. Batches
    are by bytes, so long texts come fewer at a time. The limit is the
    session's, as Spark reads it when a plan runs.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES, None) is None:
        conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
