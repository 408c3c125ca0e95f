"""Exact statistics of whole texts, computed inside Arrow tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What models see. The first four are ratios of the base counts.
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "same_next_ratio", "top_word_ratio", "unique_ratio", "log_words", "word_length", "upper_ratio", "digit_ratio", "punct_ratio", "wide_ratio", "log_line_words")

_CLASS = np.zeros((256, 4))
_CLASS[ord("A") : ord("Z") + 1, 0] = 1
_CLASS[ord("0") : ord("9") + 1, 1] = 1
_CLASS[[*b".,;:!?"], 2] = 1
_CLASS[128:, 3] = 1


def repeat_words(ids: np.ndarray) -> int:
    """Words inside 8-word windows that the text has at least twice.

    Windows are named by doubling: equal names of half windows that follow each
    other. It ends as soon as no shorter run repeats.
    """
    if len(ids) <= WINDOW:
        return 0
    names, step = ids.astype(np.int64), 1
    while step < WINDOW:
        _, names, counts = np.unique(names[:-step] * (int(names.max()) + 1) + names[step:], return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        step *= 2
    starts = np.flatnonzero(counts[names] > 1)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """BASE counts and RATIOS of a text; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()  # bytes: ASCII white space
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0), (0.0,) * len(RATIOS)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words])
    repeat = repeat_words(ids)
    upper, digit, punct, wide = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    ratios = (symbols / n, dup / len(lines), repeat / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, float(np.bincount(ids).max()) / n, len(seen) / n, float(np.log1p(n)), chars / n, upper / len(raw), digit / len(raw), punct / n, wide / len(raw), float(np.log1p(n / len(lines))))
    return (n, chars, symbols, dup, repeat), ratios


def base_failed(n_words, n_repeat_words):
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, also: list[str] | None = None) -> DataFrame:
    """doc_id, text, y of at most `rows` labelled documents outside fold 2, chosen by hash."""
    from tidegauge.llm.langid import fold

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter((fold(F.col("doc_id")) != 2) & F.col("y").isNotNull())
    chosen = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(also or [])).join(F.broadcast(chosen), "doc_id")  # `rows` ids at most
