"""Language identification by words first, then by ever shorter character n-grams.

A known word scores by the logarithm of its frequency in each language. An
unseen word scores by the mean of its longest character n-grams that are known,
from five characters down to one. Words and n-grams are held as sorted 64-bit
hashes beside their scores, and tasks score whole batches of texts at once.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import shared

WORD = re.compile(r"[^\W\d_]+")  # letters, and a few number signs that real() takes out
BREAK = re.compile(r"[\W\d_]")
LONGEST = 5
PIECE = 1 << 20  # characters of a long text that are looked at together
TOKENS = 1 << 16  # word occurrences that are scored together
CACHED = 100_000  # distinct words whose scores a task keeps
SEED = 42  # of Spark's xxhash64


@dataclass(frozen=True)
class Params:
    sample_rows: int = 5_000  # of each language, the labelled documents that the model is fitted on, about
    smooth: float = 0.5


@dataclass
class Table:
    """Sorted hashes of keys and a row of log frequencies, one a language, for each."""

    keys: np.ndarray
    logs: np.ndarray

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes among the keys; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    words: Table
    grams: Table


def real(word: str) -> str:
    """The letters of a word: signs such as ² and ½ are none."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def pieces(text: str) -> Iterator[str]:
    """A text in parts of about PIECE characters that end between words."""
    start = 0
    while len(text) - start > PIECE and (cut := BREAK.search(text, start + PIECE)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] or [padded]


def hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys)).view(np.int64)


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 4


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n) summed over the rows (text, lang)."""

    def run(batches):
        for batch in batches:
            by_lang: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for part in pieces(text.as_py().lower()):
                    by_lang[lang].update(WORD.findall(part))
            for lang, words in by_lang.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(map(real, words), pa.string()), pa.array(words.values(), pa.int64())], ["lang", "word", "n"])

    return shared.in_small_batches(texts).mapInArrow(run, "lang string, word string, n long").filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _table(counted: DataFrame, key: str, langs: list[str], smooth: float) -> Table:
    """The counts (key, lang, n) as log frequencies; hashes and plain numbers reach the driver, as Arrow columns."""
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("float").alias(f"n{i}") for i, x in enumerate(langs)]
    got = counted.groupBy(key).agg(*each).select(F.xxhash64(key).alias("h"), *(f"n{i}" for i in range(len(langs)))).toArrow()
    order = np.argsort(keys := got.column(0).to_numpy())
    counts = np.stack([got.column(i + 1).to_numpy() for i in range(len(langs))], axis=1)[order]
    logs = np.log(counts + np.float32(smooth)) - np.log(counts.sum(axis=0, dtype=float) + smooth * max(1, len(counts))).astype(np.float32)
    return Table(keys[order], logs)


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    """A model from the text and lang of rows outside fold 2.

    Of each language about sample_rows documents are taken, chosen by the hash
    of their doc_id (all, where there are fewer), so a rare language is learned
    as well as a frequent one. All their words and all n-grams of those count.
    Priors are the languages' shares of all labelled rows. No labelled row: a
    model that knows no language.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(seen)
    if not langs:
        none = Table(np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
        return Model([], np.zeros(0), none, none)
    scale = 1 << 40
    below = F.create_map(*(F.lit(x) for k in langs for x in (k, -(-p.sample_rows * scale // seen[k]))))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(scale)) < below[F.col("lang")])
    words = shared.staged(count_words(sample.select("text", "lang")), "language-words")
    # n-grams come from the distinct words, with the words' counts
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    parts = lambda n: F.when(F.length(padded) <= n, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))
    grams = words.select("lang", "n", F.explode(F.concat(*(parts(n) for n in range(1, LONGEST + 1)))).alias("gram")).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    prior = np.log(np.array([seen[x] for x in langs], float) / sum(seen.values()))
    return Model(langs, prior, _table(words, "word", langs, p.smooth), _table(grams, "gram", langs, p.smooth))


class Words(dict):
    """word -> row of its scores; new words get a row and wait in `new` for their scores. Row 0: no letter."""

    def __init__(self):
        self.new: list[str] = []
        self.size = 1

    def __missing__(self, word: str) -> int:
        if letters := real(word):
            row = self.size
            self.size += 1
            self.new.append(letters)
        else:
            row = 0
        self[word] = row
        return row


class Scorer:
    """Scores batches of texts in a task; the words met last keep their scores."""

    def __init__(self, model: Model):
        self.m = model
        self.forget()

    def forget(self) -> None:
        self.words, self.scores = Words(), np.zeros((1, len(self.m.langs)), np.float32)

    def learn(self, words: list[str]) -> None:
        """Append the scores of words."""
        found = np.zeros((len(words), len(self.m.langs)), np.float32)
        at = self.m.words.rows(hashes(words))
        found[at >= 0] = self.m.words.logs[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams = [grams_of(words[i], n) for i in left]
            starts = np.cumsum([0, *(len(g) for g in grams[:-1])])
            rows = self.m.grams.rows(hashes([x for g in grams for x in g]))
            known = np.add.reduceat(rows >= 0, starts, dtype=np.int64)
            sums = np.add.reduceat(np.where((rows >= 0)[:, None], self.m.grams.logs[rows], 0), starts, axis=0)
            some = known > 0
            found[left[some]] = sums[some] / known[some, None]
            left = left[~some]
        self.scores = np.concatenate([self.scores, found])

    def __call__(self, texts) -> tuple[list[str], list[float]]:
        """Languages and scores of texts (strings or None)."""
        sums, counts = np.zeros((len(texts), len(self.m.langs))), np.zeros(len(texts), np.int64)
        flat, owners, starts = array("i"), [], []

        def settle() -> None:
            if self.words.new:
                self.learn(self.words.new)
                self.words.new = []
            if flat:
                rows = np.frombuffer(flat, np.int32)
                np.add.at(sums, owners, np.add.reduceat(self.scores[rows], starts, axis=0, dtype=float))
                np.add.at(counts, owners, np.add.reduceat(rows > 0, starts, dtype=np.int64))
            if len(self.words) > CACHED:
                self.forget()

        for i, text in enumerate(texts if self.m.langs else ()):
            for part in pieces(text.lower()) if text else ():
                before = len(flat)
                flat.extend(map(self.words.__getitem__, WORD.findall(part)))
                if len(flat) > before:
                    owners.append(i)
                    starts.append(before)
                if len(flat) >= TOKENS:
                    settle()
                    flat, owners, starts = array("i"), [], []
        settle()
        if not self.m.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        logs = sums + self.m.prior
        best = logs.argmax(axis=1)
        sure = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.m.langs[b] if n else "und" for b, n in zip(best.tolist(), counts.tolist(), strict=True)], np.where(counts > 0, sure, 0.0).tolist()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Texts that are null or have no letter (number signs such as ½ are none) are
    `und` with score 0, as is every text when nothing was learned. Very long
    texts count whole, in parts that end between words. Of languages with equal
    scores the first by name wins. A null doc_id is not held out. Repeated rows
    are scored each; other columns are ignored, so clashing names do no harm. An
    empty table gives no rows.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = Scorer(shared_model.value)
        for batch in batches:
            langs, scores = score([t.as_py() for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return shared.in_small_batches(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is known and scores min_score at least.

    Rows are filtered inside the Arrow stream, so a text is held once. Odd texts
    are taken as predict() takes them; `und` goes.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        score = Scorer(shared_model.value)
        for batch in batches:
            found = zip(*score([t.as_py() for t in batch.column(at).cast(pa.string())]), strict=True)
            yield batch.filter(pa.array([lang != "und" and sure >= min_score for lang, sure in found], pa.bool_()))

    return shared.in_small_batches(docs).mapInArrow(run, docs.schema)
