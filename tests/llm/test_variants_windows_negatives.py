"""Spelling variants, lexical packing and hard negatives against brute force and exact round trips."""

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_llm_small import DOCS, ODD, docs

from tidegauge.llm import hardneg, lexpack, oracles, queries, spelling, tokens

DATA = "/root/testdata/sf0.01"


def as_rows(rows):
    return sorted((tuple(None if x != x or x is None else int(x) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_hard_negatives"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(oracles.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert as_rows(got.select(*columns).collect()) == as_rows(want.select(*columns).fetchall())


# --- spelling variants ---------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, modulus):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[a-zÀ-ÿ]+", (text or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if modulus and h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w in n:
        others = [o for o in n if one_edit(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        near[w], form[w] = len(others), best if best is not None and n[best] >= 2 * n[w] else None
    found = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        found.append((w, n[w], near[w], form[w], None if form[w] is None else n[form[w]], root))
    return found


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize("modulus,symbols,carry", [(97, 8, 48), (5, 2, 6), (0, 16, 48)])
def test_variants_against_brute_force(spark, modulus, symbols, carry):
    r = random.Random(modulus)
    stems = ["".join(r.choice("abcdeéÿ") for _ in range(r.randint(4, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa"]
    words = []
    for s in stems:
        for _ in range(4):
            k = r.randrange(len(s))
            words += [s, s, s[:k] + s[k + 1 :], s[:k] + "x" + s[k:], s[:k] + "Q" + s[k + 1 :]]
    long = "".join(r.choice("abc") for _ in range(3000))
    texts = [" ".join(r.choice(words) for _ in range(300)) for _ in range(12)]
    texts += [f"{long} {long} {long[:1000]}d{long[1001:]} {long[1:]}", f"{long}-{long[1:]};{long[1:]} {long[:1000]}d{long[1001:]}", f"{long[:1000]}d{long[1001:]}", "ÀÀÀÀÀ ààààà ÀÀÀÀÀ ÀÀÀÀÀ ààààà ààààà"]
    df = docs(spark, [*ODD, *texts, texts[0]], extra=True)
    df = df.withColumn("doc_id", F.when(F.col("doc_id") != 12, F.col("doc_id"))).withColumn("word", F.lit("mine"))
    rows = [tuple(x) for x in df.select("doc_id", "text").collect()]
    got = spelling.variants(df, spelling.Params(modulus=modulus, symbols=symbols, carry=carry)).select(*COLUMNS).collect()
    assert as_rows(got) == as_rows(brute_variants(rows, modulus))
    assert any(len(x["word"]) > 2000 and x["n_near"] for x in got) or modulus == 5


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(docs(spark, ["once upon a time", None])).count() == 0


def test_neighbourhood_is_whole():
    """Every deletion, and every replacement by a later symbol, once; insertions are the deletions of the other end."""
    r = np.random.default_rng(3)
    for size in (1, 2, 5, 8):
        matrix = r.integers(1, 5, (6, size)).astype(np.uint64)
        own, rows, found = spelling.keys(matrix, 4)
        assert (own == spelling.own_key(matrix)).all()
        for i, word in enumerate(matrix.tolist()):
            want = {tuple(word[:k] + word[k + 1 :]) for k in range(size)} | {tuple(word[:k] + [c] + word[k + 1 :]) for k in range(size) for c in range(word[k] + 1, 5)}
            keys = sorted(spelling.own_key(np.array([w], np.uint64).reshape(1, -1))[0] for w in want)
            assert sorted(found[rows == i]) == keys


# --- lexical packing -----------------------------------------------------------------------------


def check_packing(got, texts, capacity):
    """Every id once, in its place, sequences gapless, full or a power of two."""
    encode = tokens.encoder(tokens.default_path(), added=True)
    ids = {d: np.append(encode(t or ""), np.uint32(0)).astype("<u4") for d, t in texts.items()}
    at = dict.fromkeys(ids, 0)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {d: len(x) for d, x in ids.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    sizes = Counter()
    for parts in sequences.values():
        end = 0
        for offset, n, _ in sorted(parts):
            assert offset == end and n > 0
            end += n
        assert end <= capacity and end & (end - 1) == 0
        sizes[end] += 1
    return sequences, sizes


def test_lexical_packing_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    sequences, sizes = check_packing(queries.op12_lexical_packing(spark, DATA).collect(), texts, 1024)
    total = sum(n * k for n, k in sizes.items())
    assert sizes[1024] == total // 1024 and max(k for n, k in sizes.items() if n < 1024) == 1
    # documents in one window share more words than documents of different windows
    words = {d: set((t or "").split()) for d, t in texts.items()}
    alike = lambda a, b: len(words[a] & words[b]) / max(1, len(words[a] | words[b]))
    r = random.Random(5)
    near = [alike(parts[0][2], x[2]) for parts in map(sorted, sequences.values()) for x in parts[1:]]
    far = [alike(*r.sample(sorted(texts), 2)) for _ in near]
    assert len(near) > 100 and sum(near) / len(near) > 1.5 * sum(far) / len(far)


def test_lexical_packing_of_odd_rows(spark):
    df = docs(spark, [*ODD, "same text here for all"], extra=True)
    p = lexpack.Params(capacity=16, shard_docs=3, query_terms=2)
    check_packing(lexpack.pack_documents(df, p).collect(), dict(enumerate([*ODD, "same text here for all"])), 16)
    twice = docs(spark, ["a b c d e f"]).union(docs(spark, ["a b c d e f"]))
    got = lexpack.pack_documents(twice, p).collect()
    assert sum(r["length"] for r in got) == 2 * got[0]["doc_tokens"]
    assert lexpack.pack_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert lexpack.pack_documents(docs(spark, ["one", None]).withColumn("doc_id", F.lit(None).cast("long"))).count() > 0
    with pytest.raises(ValueError):
        lexpack.pack_documents(df, lexpack.Params(capacity=1000))


def test_windows_take_the_best_neighbours():
    """The seed's window takes the unused neighbours by score, cuts the best that does not fit and goes on with its rest."""
    ids = [np.array(x, np.uint32) for x in ([1, 2, 3, 0], [9, 9, 9, 0], [1, 2, 3, 0], [1, 2, 7, 8, 0], [9, 9, 0])]
    terms, tf = zip(*(np.unique(x, return_counts=True) for x in ids), strict=True)
    shard = lexpack.Shard(list(terms), list(tf), [len(x) for x in ids], np.array([0.1, 2, 2, 2, 1, 1, 1, 1, 1, 3.0]), 4, lexpack.Params(capacity=8))
    assert shard.neighbours(0, np.array([False, True, True, True, True])).tolist()[:2] == [2, 3]
    assert list(shard.windows()) == [[(0, 0, 4), (2, 0, 4)], [(1, 0, 4), (4, 0, 3), (3, 0, 1)], [(3, 1, 5)]]
    assert [[b - a for _, a, b in w] for w in lexpack.powers([(0, 0, 5), (1, 2, 4)])] == [[4], [1, 1], [1]]


# --- hard negatives ------------------------------------------------------------------------------


def brute_negatives(rows, every, p):
    def usable(r):
        return all(x is not None for x in r) and all(x is not None and np.isfinite(x) for x in r[1])

    rows = [(i, np.floor(np.array(v, float) * p.scale).astype(np.int64), y) for i, v, y in filter(usable, rows)]
    size = Counter(len(v) for _, v, _ in rows)
    rows = [r for r in rows if len(r[1]) == max(size, key=lambda n: (size[n], n))]
    out = []
    for a in {i for i, _, _ in rows if i % every == 0}:
        _, va, ya = min((r for r in rows if r[0] == a), key=lambda r: (r[2], r[1].tolist()))
        score = sorted((-int(va @ v), i, y) for i, v, y in rows if i != a)
        for s, i, _ in [x for x in score if x[2] == ya][: p.positives]:
            fit = [(n, j) for n, j, y in score if y != ya and p.low * -s <= 100 * -n <= p.high * -s]
            out += [(a, i, k + 1, j, -s, -n) for k, (n, j) in enumerate(fit[: p.negatives])]
    return out


def check_negatives(spark, rows, every, p):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"q": F.lit("x"), "id": F.lit("y"), "n": F.lit(1), "block": F.lit(2)})
    assert sorted(tuple(r) for r in hardneg.mine(df, every, p).collect()) == sorted(brute_negatives(rows, every, p))


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_against_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, 6))
    rows = []
    for i in range(400):
        y = int(r.integers(0, 4))
        v = (centres[y] + 0.6 * r.normal(size=6)).astype(np.float32).tolist()
        rows.append((i, v, y))
    same = rows[3][1]
    rows += [(1000 + i, same, i % 3) for i in range(150)]  # a hot vector: ties
    rows += [(2000, [0.0] * 6, 1), (2010, [0.0] * 6, 2), (2020, same, 99), (2021, None, 1), (2022, same, None), (2023, [1.0, None] + same[2:], 1), (2024, [float("nan")] + same[1:], 1), (2025, [float("inf")] + same[1:], 1), (None, same, 1), (2030, [1.0, 2.0], 1), (2031, [], 1)]
    rows += [(10, rows[10][1], rows[10][2]), (20, rows[21][1], 0), (33, rows[34][1], 1)]  # ids that repeat
    check_negatives(spark, rows, 10, hardneg.Params(block_rows=64, block_anchors=16, directions=5, sample_rows=100, salts=3))
    check_negatives(spark, rows, 10, hardneg.Params(positives=2, negatives=5, low=20, high=100))


def test_negatives_of_few_rows(spark):
    check_negatives(spark, [(0, [1.0, 0.0], 1)], 50, hardneg.Params())
    check_negatives(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (50, [-1.0, 0.0], 1)], 50, hardneg.Params())
    check_negatives(spark, [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.9, 0.0], 2)], 50, hardneg.Params())
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.mine(empty).count() == 0 and hardneg.mine(spark.createDataFrame([(0, [], 1)], empty.schema)).count() == 0


def test_bounds_hold():
    """No inner product leaves the bounds that angles to reference directions give."""
    r = np.random.default_rng(7)
    q = np.floor(r.normal(size=(300, 8)) * 50)
    refs = np.linalg.qr(r.normal(size=(8, 8)))[0][:4]
    norms = np.linalg.norm(q, axis=1)
    a = hardneg.angles(q, norms, refs)
    lo, hi = hardneg.score_bounds(a[:, None], a[:, None], (norms[:, None],) * 2, a[None], a[None], (norms[None],) * 2)
    s = q @ q.T
    assert (lo <= s).all() and (s <= hi).all()
    lo, hi = hardneg.score_bounds(a[:100].min(0), a[:100].max(0), (norms[:100].min(), norms[:100].max()), a, a, (norms,) * 2)
    assert (lo <= s[:100]).all() and (s[:100] <= hi).all()
