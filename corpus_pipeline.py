"""The corpus pipeline: from raw documents to packed training sequences.

Every stage but the last takes and gives the columns of documents. A stage works
on all that its predecessor kept; run() writes each stage's rows to the shared
folder and reads them again.

All stages take whole texts of any length. A table without rows gives none.
Rows that repeat a doc_id are judged each by language and line dedup, and go or
stay together in near dedup and decontamination. Columns besides doc_id and text
pass unchanged, except that line dedup sets n_chars where it cuts a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontam, langid, linededup, neardup, packing, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; null texts, texts without a letter and undecided ones go."""
    return langid.accepted(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document that was nothing else goes."""
    own = {c: f"_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    done = linededup.remove_repeated_runs(docs.withColumnsRenamed(own))
    some = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    kept = done.filter(some).withColumn("n_chars", size).drop("n_lines", "n_removed")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id; texts without a word stay."""
    gone = neardup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontam.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 tokens; a null or empty text is its closing id alone."""
    return packing.pack_documents(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("near dedup", copies), ("decontamination", benchmark), ("packing", pack)]

#: Language, near-duplicates and packing are beyond SQL; tests/llm/test_contracts.py holds the stages against SQL and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
