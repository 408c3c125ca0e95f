"""The operators applied with production parameters to whole tables, as the driver runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontam, fm, hardneg, langid, lexpack, licenses, linededup, neardup, packing, rules, spelling, tokencount, warc
from tidegauge.llm.oracles import ORACLE_SQL
from tidegauge.llm.shared import table


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a monolithic archive, the normaliser and the index."""
    return warc.roundtrip(table(spark, sf_dir, "pages"), min_bytes=0)


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by the factorisation machine."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fm.score(docs, fm.fit(docs, labels))


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of line runs of 50 words and more."""
    return linededup.remove_repeated_runs(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in flat files by their separators."""
    return tokencount.document_counts(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base statistics and verdict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.judge(docs, rules.fit(docs, labels))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of a repository, with its own or an inherited licence."""
    files = licenses.virtual_files(table(spark, sf_dir, "documents"))
    found = licenses.scan(files)
    return found.withColumn("doc_id", doc_of("path")).withColumn("licensed_by", doc_of("licensed_by"))


def doc_of(path: str) -> F.Column:
    """The doc_id in a path of licenses.virtual_files."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return F.when(name.endswith(".txt"), F.regexp_extract(name, r"^\d+", 0)).otherwise(F.translate(F.regexp_extract(name, r"\.([a-j]+)$", 1), "abcdefghij", "0123456789")).cast("long")


def op9_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are 85 % alike."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Params(words=3, percent=85))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words, its form and its root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 1024 tokens, beside its lexical neighbours."""
    return lexpack.pack_documents(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector's positives; every seventh label is one further."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.select("vec_id", "embedding", label.alias("label")))


QUERIES = {
    f.__name__: f
    for f in (op1_warc_normaliser, op2_quality_fm, op3_line_runs, op4_best_fit_packing, op5_language_id, op6_token_counts, op7_quality_rules, op8_license_scan, op9_setsketch_neardup, op10_template_decontamination, op11_spelling_variants, op12_lexical_packing, op13_hard_negatives)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
