"""Readers and writers of bars, articles and review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.schemas import ARTICLES, BARS, refuse_forbidden
from tidegauge.sources.arrays import read_json_array


def bars_csv(spark: SparkSession, path: str, names: dict[str, str] | None = None, start: str | None = None, end: str | None = None, step: str = "5 minutes", series: str = "series") -> DataFrame:
    """Bars from CSV with a header. names: our column -> the file's.

    Only the columns of a bar are read; a value that doesn't parse is null. With
    start and end (dates, both inclusive) the bar one step before start is kept,
    so that the first return exists.
    """
    wanted = [f.name for f in BARS if f.name != "series_id"]
    names = names or {c: c for c in wanted}
    raw = spark.read.option("header", True).csv(path)
    typed = [F.try_to_timestamp(F.col(f"`{names[c]}`")).alias(c) if c == "ts" else F.expr(f"try_cast(`{names[c]}` AS double)").alias(c) for c in wanted]
    return in_range(raw.select(F.lit(series).alias("series_id"), *typed), start, end, step)


def in_range(bars: DataFrame, start: str | None, end: str | None, step: str = "5 minutes") -> DataFrame:
    """Bars of the days start .. end and the one bar before; the filter reaches a Parquet scan."""
    if start:
        bars = bars.filter(F.col("ts") >= F.to_timestamp(F.lit(start)) - F.expr(f"INTERVAL {step}"))
    if end:
        bars = bars.filter(F.col("ts") < F.to_timestamp(F.lit(end)) + F.expr("INTERVAL 1 DAY"))
    return bars


def articles_json_array(spark: SparkSession, path: str, schema: T.StructType = ARTICLES) -> DataFrame:
    """Articles of top-level JSON arrays, many tasks a file; an error if a file is none."""
    return refuse_forbidden(read_json_array(spark, path, schema))


def articles_json_lines(spark: SparkSession, path: str, schema: T.StructType = ARTICLES) -> DataFrame:
    return refuse_forbidden(spark.read.schema(schema).json(path))


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of strings, blanks kept as empty strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).fillna("")


def parsed_time(df: DataFrame, raw: str = "raw_ts", to: str = "ts") -> DataFrame:
    """df with a timestamp column; null where it doesn't parse."""
    return df.withColumn(to, F.try_to_timestamp(F.col(raw)))


def write_table(df: DataFrame, path: str, format: str = "parquet", by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write as parquet, csv or json, by partition columns if given."""
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that doesn't depend on the order of rows or columns.

    The digest is the sum of the rows' hashes, so that repeated rows count each;
    names and nulls are hashed with the values, as a null by itself leaves a hash
    unchanged.
    """
    names = sorted(df.columns)
    parts = [x for c in names for x in (F.lit(c), F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    total = F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.coalesce(total, F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def verify_fingerprint(df: DataFrame, rows: int, digest: str) -> DataFrame:
    """df, or an error if its content is not what a dependent job was fixed on."""
    now = fingerprint(df).first()
    if (now["rows"], now["digest"]) != (rows, digest):
        raise ValueError(f"the input changed: {now['rows']} rows, digest {now['digest']}")
    return df
