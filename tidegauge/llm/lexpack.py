"""Packing by lexical retrieval: windows filled with what a BM25 index returns for their seed.

A document's ids are cut into windows of the capacity as long as they fill one;
what is left of it goes to the pool. The pool is dealt into shards by a topic
term, so that documents which share their rare terms mostly meet in one shard.
Each shard holds an inverted BM25 index of its documents, with the term
frequencies and the mean length of the whole pool. A seed's window takes the
unused neighbours that the index returns, best first, as long as they fit; then
the best that does not fit is cut, and what is left of it seeds the next window.
What a shard leaves at its end, less than one window, goes into sequences of
lengths that are powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import shared, tokens

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in PLACED.split(", ")]


@dataclass(frozen=True)
class Params:
    """capacity: ids a sequence; shard_docs: documents a shard; query_terms: of a seed, those of largest weight; k1, b: BM25's."""

    capacity: int = 1024
    shard_docs: int = 2048
    query_terms: int = 24
    topic_terms: int = 8
    k1: float = 1.2
    b: float = 0.75


def _batch(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def tokenised(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """A row a window that a document fills alone, and one for the rest of it.

    (doc_id, start, length, ids_crc32, doc_tokens, ids, terms, tf): the last three
    are null for full windows, whose place is known; terms are the distinct ids.
    """
    kinds = (pa.int64(),) * 5 + (pa.binary(),) * 3

    def run(batches):
        encode = tokens.encoder(tokenizer, added=True)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                for s in range(0, n, capacity):
                    part = ids[s : s + capacity]
                    held = (None,) * 3
                    if len(part) < capacity:
                        terms, tf = np.unique(part, return_counts=True)
                        held = part.tobytes(), terms.tobytes(), tf.astype("<u4").tobytes()
                    rows.append((doc, s, len(part), zlib.crc32(part.tobytes()), n, *held))
            yield _batch(rows, [*_NAMES[:5], "ids", "terms", "tf"], kinds)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, terms binary, tf binary")


def document_frequencies(pool: DataFrame) -> DataFrame:
    """(term, df) over the pool: as many rows as the tokenizer's vocabulary at most."""

    def run(batches):
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                terms = np.frombuffer(x.as_buffer(), "<u4")
                if len(terms) and terms[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(terms[-1]) + 1 - len(df), np.int64)])
                df[terms] += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], ["term", "df"])

    return pool.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Shard:
    """The inverted index of some documents, and their greedy packing."""

    def __init__(self, terms: list[np.ndarray], tf: list[np.ndarray], size: list[int], weight: np.ndarray, mean: float, p: Params):
        """terms, tf: of each document the distinct ids in order, and how often each occurs; size: its ids."""
        self.p, self.size = p, np.array(size, np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.term = np.concatenate([np.zeros(0, np.uint32), *terms])
        tf = np.concatenate([np.zeros(0), *tf])
        doc = np.repeat(np.arange(len(terms)), np.diff(self.at))
        long = p.k1 * (1 - p.b + p.b * self.size / max(mean, 1e-9))
        self.score = weight[self.term] * tf * (p.k1 + 1) / (tf + long[doc])  # of each posting, in the order of documents
        order = np.argsort(self.term, kind="stable")
        self.doc, self.by_term = doc[order], self.score[order]
        self.terms, first = np.unique(self.term[order], return_index=True)
        self.first = np.append(first, len(order))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share a query term with seed, by BM25, ties in the shard's order."""
        own = slice(self.at[seed], self.at[seed + 1])
        query = self.term[own]
        if len(query) > self.p.query_terms:
            query = query[np.argpartition(-self.score[own], self.p.query_terms - 1)[: self.p.query_terms]]
        where = np.searchsorted(self.terms, query)
        spans = [slice(self.first[k], self.first[k + 1]) for k in where.tolist()]
        docs = np.concatenate([self.doc[s] for s in spans])
        total = np.bincount(docs, np.concatenate([self.by_term[s] for s in spans]), len(self.size))
        total[~unused] = 0
        found = np.nonzero(total > 0)[0]
        return found[np.argsort(-total[found], kind="stable")]

    def windows(self):
        """Lists of (document, from, to): each list one window's parts in order; the last may be short."""
        capacity, unused = self.p.capacity, np.ones(len(self.size), bool)
        following, rest = 0, None  # rest: what a cut left, (document, from)
        while True:
            if rest is None:
                while following < len(unused) and not unused[following]:
                    following += 1
                if following == len(unused):
                    return
                rest = (following, 0)
                unused[following] = False
            seed, start = rest
            gap = capacity - (int(self.size[seed]) - start)
            window, rest, cut = [(seed, start, int(self.size[seed]))], None, None
            if gap:
                for k in self.neighbours(seed, unused).tolist():
                    n = int(self.size[k])
                    if n <= gap:
                        window.append((k, 0, n))
                        unused[k] = False
                        gap -= n
                        if not gap:
                            break
                    elif cut is None:
                        cut = k
            while gap:
                if cut is None:  # none is left that shares a term: the next in order of topics
                    while following < len(unused) and not unused[following]:
                        following += 1
                    if following == len(unused):
                        break
                    cut = following
                n = min(gap, int(self.size[cut]))
                window.append((cut, 0, n))
                unused[cut] = False
                gap -= n
                if n < self.size[cut]:
                    rest = (cut, n)
                cut = None
            yield window


def powers(window: list[tuple[int, int, int]]):
    """A short window as sequences whose lengths are powers of two, the largest first."""
    left = sum(b - a for _, a, b in window)
    window = list(window)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        part = []
        while room:
            k, a, b = window.pop(0)
            if b - a > room:
                window.insert(0, (k, a + room, b))
                b = a + room
            part.append((k, a, b))
            room -= b - a
        yield part


def pack_documents(docs: DataFrame, p: Params = Params(), tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most capacity ids, without padding.

    Every sequence is full, or its length is a power of two: at most log2(capacity)
    of those a shard. Each id lies in exactly one piece.

    Null texts count as empty and give the closing id alone; repeated rows are
    packed each on their own; ties of BM25 go by the order of the shard; texts of
    any length are taken whole, a task holds one at a time and the rests (less
    than capacity ids each) of a shard; an empty table gives an empty result;
    columns other than doc_id and text are ignored, whatever their names.
    """
    if p.capacity < 1 or p.capacity & (p.capacity - 1):
        raise ValueError("the capacity must be a power of two")
    spark = docs.sparkSession
    staged = shared.staged(tokenised(docs, p.capacity, tokenizer or tokens.default_path(), end_id).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    alone = staged.filter("ids IS NULL").select(*_NAMES[:5], F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = staged.filter("ids IS NOT NULL")
    n, total = pool.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    found = document_frequencies(pool).toArrow()  # bounded by the vocabulary
    term, df = found["term"].to_numpy(), found["df"].to_numpy()
    weight = np.zeros(int(term.max()) + 1 if len(term) else 1)
    weight[term] = idf(df, n)
    shared_weight, mean = spark.sparkContext.broadcast(weight), total / max(n, 1)

    def topics(batches):
        """Of the terms of largest weight, that with the smallest hash: documents with the same rare terms mostly agree."""
        w = shared_weight.value
        for batch in batches:
            topic = np.zeros(batch.num_rows, np.int64)
            for k, (terms, tf) in enumerate(zip(batch.column("terms"), batch.column("tf"), strict=True)):
                terms, tf = np.frombuffer(terms.as_buffer(), "<u4"), np.frombuffer(tf.as_buffer(), "<u4")
                if len(terms) > p.topic_terms:
                    terms = terms[np.argpartition(-w[terms] * tf / (tf + p.k1), p.topic_terms - 1)[: p.topic_terms]]
                topic[k] = int(((terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).min())
            yield batch.append_column("topic", pa.array(topic))

    def fill(batches):
        from pyspark import TaskContext

        rows = pa.Table.from_batches(batches, schema)
        own = (1 << 62) + (TaskContext.get().partitionId() << 36)
        ids, terms, tf = ([np.frombuffer(x.as_buffer(), "<u4") for x in rows[c]] for c in ("ids", "terms", "tf"))
        doc, start, size = rows["doc_id"].to_pylist(), rows["start"].to_pylist(), rows["doc_tokens"].to_pylist()
        out: list[tuple] = []
        for window in Shard(terms, tf, [len(x) for x in ids], shared_weight.value, mean, p).windows():
            full = sum(b - a for _, a, b in window) == p.capacity
            for part in [window] if full else powers(window):
                offset = 0
                for k, a, b in part:
                    out.append((doc[k], start[k] + a, b - a, zlib.crc32(ids[k][a:b].tobytes()), size[k], own, offset))
                    offset += b - a
                own += 1
        yield _batch(out, _NAMES, (pa.int64(),) * 7)

    columns = ["doc_id", "start", "doc_tokens", "ids", "terms", "tf", "_row", "topic"]
    kinds = "doc_id long, start long, doc_tokens long, ids binary, terms binary, tf binary, _row long, topic long"
    schema = pa.schema([(c, pa.binary() if c in ("ids", "terms", "tf") else pa.int64()) for c in columns])
    dealt = pool.select(*columns[:-1]).mapInArrow(topics, kinds)
    dealt = dealt.repartitionByRange(max(1, -(-n // p.shard_docs)), "topic", "_row").sortWithinPartitions("topic", "_row")
    return dealt.mapInArrow(fill, PLACED).unionByName(alone)
