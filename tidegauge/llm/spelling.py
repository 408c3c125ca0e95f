"""Spelling variants by the one-edit neighbourhoods of words in a reduced alphabet.

Letters are hashed to a few symbols. Words one edit apart have reduced words that
are equal or one edit apart, so every reduced word's neighbourhood is joined with
the reduced vocabulary, and what meets is verified on the words themselves. The
neighbourhood is that of all deletions, insertions and replacements; each pair of
reduced words is made from one end only, as what an insertion gives is what a
deletion gives from the longer end. Reduced words travel as 64-bit polynomial
hashes, which makes a neighbour in one step from prefix and suffix sums.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import shared

_RUN = re.compile("[a-zÀ-ÿ]+")
_BASE = 0x9E3779B97F4A7C15 | 1
#: Entries of a task's partial counts, and characters they may hold, before they are passed on.
_FLUSH, _FLUSH_CHARS = 300_000, 32 << 20
#: Keys made at once.
_KEYS = 1 << 20


@dataclass(frozen=True)
class Params:
    """min_chars and min_n bound the vocabulary; modulus: one run in so many loses a code point (0: none).

    symbols sets the size of the reduced alphabet, and carry up to which length a
    word travels with its keys rather than its id; neither changes the result.
    """

    min_chars: int = 5
    min_n: int = 3
    ratio: int = 2
    modulus: int = 97
    symbols: int = 8
    carry: int = 48


def word_counts(docs: DataFrame, p: Params) -> DataFrame:
    """(word, n) of the vocabulary: runs of letters of whole texts, lower-cased in A-Z only."""

    def run(batches):
        found: Counter[str] = Counter()
        chars = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                doc = doc.as_py() if doc.is_valid else ""
                start = zlib.crc32(f"{doc}:".encode())
                runs = Counter(_RUN.findall(text.as_py().encode("utf-8", "replace").lower().decode()))
                for word, n in runs.items():
                    if len(word) < p.min_chars:
                        continue
                    if p.modulus:
                        h = zlib.crc32(word.encode(), start)
                        if h % p.modulus == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < p.min_chars:
                                continue
                    if word not in found:
                        chars += len(word)
                    found[word] += n
                if len(found) >= _FLUSH or chars >= _FLUSH_CHARS:
                    yield out()
                    found.clear()
                    chars = 0
        yield out()

    partial = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.min_n)


def reduced(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The symbols (from 1) of code points."""
    return ((codes.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(symbols) + np.uint64(1)).astype(np.uint64)


def own_key(matrix: np.ndarray) -> np.ndarray:
    """The key of each row."""
    key = np.zeros(len(matrix), np.uint64)
    for i in range(matrix.shape[1]):
        key = key * np.uint64(_BASE) + matrix[:, i]
    return key.view(np.int64)


def keys(matrix: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own key of each row, rows and keys of their deletions and of their replacements by a later symbol).

    matrix: reduced words of one length, a row each. All sums are modulo 2**64.
    """
    m, size = matrix.shape
    power = np.ones(size + 1, np.uint64)
    np.multiply.accumulate(np.full(size, _BASE, np.uint64), out=power[1:])
    before = np.zeros((m, size + 1), np.uint64)  # of the first i symbols
    after = np.zeros((m, size + 1), np.uint64)  # of the symbols from i on
    for i in range(size):
        before[:, i + 1] = before[:, i] * np.uint64(_BASE) + matrix[:, i]
        k = size - 1 - i
        after[:, k] = after[:, k + 1] + matrix[:, k] * power[i]
    down = power[size - 1 :: -1] if size else power[:0]  # of the place of symbol i
    cut = before[:, :-1] * down + after[:, 1:]
    first = np.ones((m, size), bool)
    first[:, 1:] = matrix[:, 1:] != matrix[:, :-1]  # within a run of one symbol all deletions are the same
    row, at = np.nonzero(first)
    rows, found = [row], [cut[row, at]]
    wide = down * np.uint64(_BASE)
    held = before[:, :-1] * wide + after[:, 1:]  # with a gap at i
    for c in range(2, symbols + 1):
        row, at = np.nonzero(matrix < c)
        rows.append(row)
        found.append(held[row, at] + np.uint64(c) * down[at])
    return before[:, size].view(np.int64), np.concatenate(rows), np.concatenate(found).view(np.int64)


def _keyed(vocabulary: DataFrame, p: Params, near: bool, carried: str) -> DataFrame:
    """(key, carried, n, own): each word under its own reduced word; with near also under what it can meet."""

    def run(batches):
        for batch in batches:
            words, ns, what = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.array([len(w) for w in words], np.int64)
            for size in np.unique(sizes).tolist():
                mine = np.nonzero(sizes == size)[0]
                step = max(1, _KEYS // (size * p.symbols))
                for k in range(0, len(mine), step):
                    at = mine[k : k + step]
                    codes = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), size)
                    matrix = reduced(codes, p.symbols)
                    if near:
                        own, rows, found = keys(matrix, p.symbols)
                        whose = np.concatenate([at, at[rows]])
                        key = np.concatenate([own, found])
                    else:
                        whose, key = at, own_key(matrix)
                    yield pa.RecordBatch.from_arrays([pa.array(key), what.take(pa.array(whose)), pa.array(ns[whose]), pa.array(np.arange(len(key)) < len(at))], ["key", "carried", "n", "own"])

    kind = vocabulary.schema[carried].dataType.simpleString()
    return vocabulary.select("word", "n", F.col(carried).alias("_carried")).mapInArrow(run, f"key long, carried {kind}, n long, own boolean")


def _meeting(vocabulary: DataFrame, p: Params, carried: str) -> DataFrame:
    """(a, na, b, nb): the words, or ids, whose reduced words are equal or one edit apart, each pair once."""
    near = _keyed(vocabulary, p, True, carried).select("key", F.col("carried").alias("a"), F.col("n").alias("na"), "own")
    own = _keyed(vocabulary, p, False, carried).select("key", F.col("carried").alias("b"), F.col("n").alias("nb"))
    return near.join(own.hint("shuffle_hash"), "key").filter("NOT own OR a < b").select("a", "na", "b", "nb")


def near_words(vocabulary: DataFrame, p: Params) -> DataFrame:
    """(word, near, near_n): each word of (id, word, n) with each other one edit away."""
    size = F.length("word")
    short = _meeting(vocabulary.filter(size <= p.carry), p, "word")
    long = _meeting(vocabulary.filter(size >= p.carry), p, "id").select("a", "b").distinct()
    for c in ("a", "b"):
        long = long.join(vocabulary.select(F.col("id").alias(c), F.col("word").alias(f"w{c}"), F.col("n").alias(f"n{c}")), c)
    long = long.filter(F.greatest(F.length("wa"), F.length("wb")) > p.carry).select(F.col("wa").alias("a"), "na", F.col("wb").alias("b"), "nb")
    found = short.unionByName(long).filter(F.levenshtein("a", "b", 1) == 1)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    return found.select(F.explode(ends).alias("e")).select("e.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links, each to the end of its chain, by doubling.

    A form occurs at least `ratio` times as often as its word, so chains end and
    are as long as the logarithm of the largest count at most.
    """
    to = shared.staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        to = shared.staged(to.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), "roots")
        if not to.filter("_moved").limit(1).count():
            return to.drop("_moved")
        to = to.drop("_moved")


def variants(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary of docs.

    A word's form is the near word of largest count (ties: the smallest in
    code-point order), where that count is at least `ratio` times its own.

    Null and empty texts hold no words; a row that repeats counts again; without
    a doc_id the run's hash is of ':' and the run; texts and words of any length
    are taken whole; an empty table, or one whose words are all rare, gives no
    rows; other columns are ignored, whatever their names.
    """
    if p.ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    vocabulary = shared.staged(word_counts(docs, p).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    best = near_words(vocabulary, p).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_best"))
    found = vocabulary.select("word", "n").join(best, "word", "left")
    form = (-F.col("_best.m")) >= p.ratio * F.col("n")
    found = shared.staged(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("_best.near")).alias("form"), F.when(form, -F.col("_best.m")).alias("form_n")), "forms")
    end = roots(found.filter("form IS NOT NULL"))
    return found.join(end, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
