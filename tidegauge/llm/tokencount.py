"""Token counts of flat token files that have no index, by a separator scan.

A flat file is nothing but token ids, each document closed by an
end-of-document id. Files are cut into blocks of a fixed number of tokens, with
no regard to documents. Each block finds its separators with one vectorised
comparison; a prefix scan over the blocks of a file then says how many documents
ended before a block and where the last one did, which is all that is needed to
number and measure documents that cross blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm import shared, tokens

END_OF_TEXT = 50256
BLOCK_TOKENS = 1 << 21


def write_flat(docs: DataFrame, target: str, tokenizer: str, end_id: int = END_OF_TEXT, dtype: str = "<u2") -> DataFrame:
    """Write documents as flat files of ids in target; the manifest (file, document, doc_id).

    The manifest says which documents a file got, in order, and nothing about
    where they are. It must be written once, as staged() does; files of failed
    attempts are in no manifest.
    """

    def run(batches):
        encode = tokens.encoder(tokenizer)  # an end_id inside a text would be a separator
        store, folder = fs.FileSystem.from_uri(target)
        store.create_dir(folder, recursive=True)
        name, done = f"part-{uuid.uuid4().hex}.bin", 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for text in batch.column(1):
                    found = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                    if found.max() > np.iinfo(dtype).max:
                        raise ValueError("the ids don't fit the files' type")
                    out.write(found.astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(range(done, done + len(ids)), pa.int64()), pa.array(ids, pa.int64())], ["file", "document", "doc_id"])
                done += len(ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, document long, doc_id long")


def flat_files(spark: SparkSession, target: str) -> DataFrame:
    """(path, length) of the files, listed by Spark without reading them."""
    return spark.read.format("binaryFile").load(target).select("path", "length")


def count_documents(files: DataFrame, target: str, end_id: int = END_OF_TEXT, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, document, n_tokens, closed) of each document in flat files (path, length).

    n_tokens leaves the separator out. Ids after a file's last separator are a
    last document with closed = false. Empty files have no documents.
    """
    width = np.dtype(dtype).itemsize
    step = width * block_tokens
    blocks = files.filter(F.col("length") >= width).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))

    def run(batches):
        store, folder = fs.FileSystem.from_uri(target)
        for batch in batches:
            for file, length, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{folder}/{file}") as f:
                    ids = np.frombuffer(f.read_at(min(step, length - block * step) // width * width, block * step), dtype)
                ends = np.flatnonzero(ids == end_id) + block * block_tokens
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([length // width], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "total", "ends"])

    spread = blocks.repartition("file", "block")
    found = shared.staged(spread.mapInArrow(run, "file string, block long, total long, ends array<long>"), "separators")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    carried = sums.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry"))
    closed = (
        found.join(carried, ["file", "block"])
        .select("file", "before", "carry", "ends", F.posexplode("ends").alias("k", "end"))
        .select("file", (F.col("before") + F.col("k")).alias("document"), (F.col("end") - F.when(F.col("k") > 0, F.try_element_at("ends", F.col("k"))).otherwise(F.col("carry")) - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    )
    whole = found.groupBy("file").agg(F.max("total").alias("total"), F.sum(F.size("ends")).alias("document"), F.max(F.try_element_at("ends", F.lit(-1))).alias("last"))
    rest = whole.withColumn("n_tokens", F.col("total") - F.coalesce("last", F.lit(-1)) - 1).filter("n_tokens > 0").select("file", "document", "n_tokens", F.lit(False).alias("closed"))
    return closed.union(rest)


def document_counts(docs: DataFrame, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of every document, counted in the flat files written from them.

    Null and empty texts have 0 tokens; repeated rows are counted each; an empty
    table gives no rows; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    target = shared.new_path(spark, "tokens")
    manifest = shared.staged(write_flat(docs, target, tokenizer or tokens.default_path()), "manifest")
    named = manifest.select("file").distinct()
    files = flat_files(spark, target).join(named, F.element_at(F.split("path", "/"), -1) == F.col("file"), "left_semi")
    counts = count_documents(files, target, block_tokens=block_tokens)
    return counts.join(manifest, ["file", "document"]).select("doc_id", "n_tokens")
