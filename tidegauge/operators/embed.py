"""Embedding jobs: encode cache misses only, in Arrow batches, and keep vectors by content key."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import text as X
from tidegauge.functions import vectors as V
from tidegauge.operators.articles import chunked
from tidegauge.sources.keyed import VECTOR_KEY, lookup_vectors, missing

#: What a user plugs in: a batch of texts -> an array [texts, dimension].
Encoder = Callable[[list[str]], np.ndarray]


def hash_encoder(dimension: int) -> Encoder:
    """A deterministic encoder for tests: unit vectors seeded by the text's hash."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            need = -(-dimension * 4 // 32)
            raw = b"".join(hashlib.sha256(f"{k}:{t}".encode()).digest() for k in range(need))
            out[i] = np.frombuffer(raw, "<u4")[:dimension] / 2.0**31 - 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encode(rows: DataFrame, encoder: Encoder, dimension: int, batch: int = 32, text: str = "text", key: str = "content_hash") -> DataFrame:
    """(key, vector) of each row; an error if the encoder gives another shape or values that aren't finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for s in range(0, len(texts), batch):
                v = np.asarray(encoder(texts[s : s + batch]), np.float32)
                if v.shape != (len(texts[s : s + batch]), dimension) or not np.isfinite(v).all():
                    raise ValueError(f"the encoder must give finite vectors of {dimension} elements")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, batch), pa.array(list(v), pa.list_(pa.float32()))], [key, "vector"])

    return rows.select(key, text).mapInArrow(run, f"{key} string, vector array<float>")


def requests(articles: DataFrame, model: str, representation: str, text) -> DataFrame:
    """Articles with the text to encode and its composite key."""
    out = articles.withColumns({"text": text, "model": F.lit(model), "representation": F.lit(representation)})
    return out.withColumn("content_hash", X.content_key("text"))


def embed(asked: DataFrame, store: DataFrame, encoder: Encoder, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(asked with vector, the new rows for the store). Equal texts are encoded once; hits not at all."""
    wanted = asked.select(*VECTOR_KEY, "text").dropDuplicates(VECTOR_KEY)
    misses = missing(wanted, store, VECTOR_KEY)
    keyed = misses.select(F.concat_ws("\x1f", *VECTOR_KEY).alias("content_hash"), "text")
    made = encode(keyed, encoder, dimension)
    parts = F.split("content_hash", "\x1f")
    new = made.select(*(parts[i].alias(c) for i, c in enumerate(VECTOR_KEY)), F.lit(dimension).alias("dimension"), "vector", F.current_timestamp().alias("created"))
    hits = lookup_vectors(asked, store.select(*VECTOR_KEY, "dimension", "vector"), dimension)
    fresh = new.select(*VECTOR_KEY, F.col("vector").alias("_new"))
    return hits.join(fresh, VECTOR_KEY, "left").withColumn("vector", F.coalesce("vector", "_new")).drop("_new"), new


def cache_statistics(asked: DataFrame, store: DataFrame) -> DataFrame:
    """One row: requests, distinct texts, hits and misses."""
    marked = asked.select(*VECTOR_KEY).distinct().join(store.select(*VECTOR_KEY).withColumn("_hit", F.lit(1)), VECTOR_KEY, "left")
    return marked.agg(F.count("*").alias("texts"), F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))


def chunk_mean(articles: DataFrame, encoder: Encoder, dimension: int, budget: int) -> DataFrame:
    """(doc_id, vector): the mean over all pieces of an article, at length 1."""
    pieces = chunked(articles, budget).withColumn("content_hash", F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("chunk").cast("string")))
    made = encode(pieces, encoder, dimension, text="chunk_text").withColumn("doc_id", F.split("content_hash", "\x1f")[0])
    each = made.select("doc_id", F.posexplode("vector").alias("pos", "x")).groupBy("doc_id", "pos").agg(F.avg("x").alias("x"))
    mean = each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
    return mean.select("doc_id", V.unit("vector").alias("vector"))


def chunk_counts(articles: DataFrame, budget: int) -> DataFrame:
    n = articles.select(F.size(X.chunks("body", budget)).alias("n"))
    return n.agg(F.sum("n").alias("chunks"), F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.9)).alias("p90"), F.max("n").alias("maximum"))


def representations(articles: DataFrame, budget: int) -> DataFrame:
    """Each article as title, title with lead, and content: one row for each representation."""
    kinds = {"title": F.coalesce("title", F.lit("")), "title_lead": X.budgeted("title", "body", budget), "content": X.budgeted("title", "body", budget, with_title=False)}
    pairs = F.array(*(F.struct(F.lit(k).alias("representation"), v.alias("text")) for k, v in kinds.items()))
    return articles.withColumn("_r", F.explode(pairs)).select(*articles.columns, "_r.representation", "_r.text")
