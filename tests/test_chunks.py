"""Pieces of texts and the hook of a user's generator."""

from pyspark.sql import functions as F

from tidegauge.functions import text as X
from tidegauge.operators import articles as A

TEXTS = [(1, "a b c d e"), (2, None), (3, ""), (4, "    \n"), (5, "x y " * 7)]


def test_pieces_hold_every_word_once(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, body string")
    got = {}
    for r in A.chunked(rows, 2).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk_text"])
    assert got == {1: ["a b", "c d", "e"], 2: [""], 3: [""], 4: [""], 5: ["x y"] * 7}


def test_a_text_is_split_once_however_many_pieces(spark):
    long = spark.range(2).select((F.col("id") + 1).alias("doc_id"), F.expr("array_join(transform(sequence(1, 200000), x -> cast(x AS string)), ' ')").alias("body"))
    n = A.chunked(long, 10).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("chunk").alias("m")).collect()
    assert {(r["n"], r["m"]) for r in n} == {(20000, 19999)}


def test_generators_give_rows_or_none(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, body string")
    got = A.generated(rows, lambda t: enumerate(t.split()), "place int, word string").select("doc_id", "place", "word").collect()
    assert sorted(map(tuple, got)) == [(i, p, w) for i, t in TEXTS for p, w in enumerate((t or "").split())]
    assert A.generated(rows.limit(0), lambda t: [(1,)], "place int").count() == 0
    assert A.generated(rows, lambda t: [(len(t),)], "n int").agg(F.sum("n")).first()[0] == sum(len(t or "") for _, t in TEXTS)


def test_words_are_those_of_unicode_space(spark):
    rows = spark.createDataFrame([(" a b　c d\te ",)], "t string")
    assert rows.select(X.words("t")).first()[0] == list("abcde")
