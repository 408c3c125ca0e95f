"""Small cases of the training-data operators: nulls, empty and long texts, ties, empty tables, clashing columns."""

import gzip
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import decontam, docstats, fm, graph, langid, licenses, linededup, neardup, packing, rules, shared, tokencount, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)
    # names that operators use themselves
    return df.withColumns({c: F.lit("x") for c in ("length", "piece", "score", "rank", "first", "h", "id", "_id", "spans", "path")}) if extra else df


ODD = [None, "", " \n\t ", "one", "a b", "ñ é 漢字   x", "word " * 30_000, "same text here for all", "same text here for all", "\n\n\n"]


@pytest.mark.parametrize("run", [packing.pack_documents, tokencount.document_counts, linededup.remove_repeated_runs, neardup.near_duplicates, lambda d: rules.judge(d, rules.fit(d, d.limit(0).withColumn("quality", F.lit(1)))), lambda d: fm.score(d, None), lambda d: langid.predict(d, langid.fit(d)), lambda d: decontam.contaminated(d, d.limit(1).withColumn("item_id", F.col("doc_id"))), lambda d: licenses.scan(licenses.virtual_files(d))])
def test_odd_texts_and_empty_tables(spark, run):
    got = run(docs(spark, ODD, extra=True)).toPandas()
    if "doc_id" in got.columns and len(got):
        assert set(got.doc_id) <= set(range(len(ODD)))
    none = spark.createDataFrame([], DOCS)
    assert run(none).count() == 0
    run(docs(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))).count()


# --- packing -------------------------------------------------------------------------------------


def check_plan(histogram, capacity):
    fill, got = {}, {}
    for n, first, count, sequence, offset in packing.plan(histogram, capacity).tolist():
        for i in range(count):
            fill.setdefault(sequence + i, []).append((offset, n))
            got.setdefault(n, set()).add(first + i)
    assert {n: len(x) for n, x in got.items()} == histogram and all(x == set(range(len(x))) for x in got.values())
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert set(fill) == set(range(len(fill)))
    return len(fill)


@pytest.mark.parametrize("seed", range(40))
def test_plans(seed):
    r = random.Random(seed)
    capacity, h = r.choice([7, 30, 100]), {}
    for _ in range(r.choice([0, 1, 5, 60, 3000])):
        n = min(capacity, max(1, int(r.expovariate(3 / capacity))))
        h[n] = h.get(n, 0) + 1
    bins, total = check_plan(h, capacity), sum(n * c for n, c in h.items())
    assert bins >= -(-total // capacity)
    if total > 5 * capacity:
        assert bins <= 1.25 * total / capacity + 1


def test_large_items_pair_up():
    assert check_plan({60: 2, 40: 2, 35: 1}, 100) == 3


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    encode = tokens.encoder(tokens.default_path())
    for text in ["", "Hello  world\n\n ñandú 漢字 \x00 <|endoftext|> it's", " " * 50, "a" * 3000]:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    texts = ["Hello world", None, "x " * 3000]
    rows = packing.pack_documents(docs(spark, texts)).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = rows[rows.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length.iloc[1:] == 2048).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_added_tokens_in_texts(spark):
    """Packing takes the ids of a Tokenizer as loaded; token counts take the separator's string as text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "it's<|endoftext|><|endoftext|>\n\n  x", "<|endoftext", "x <|endoftext|> " * 1500, "plain 漢字  text", "end <|endoftext|>"]
    rows = packing.pack_documents(docs(spark, texts)).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert tokens.encoder(tokens.default_path(), added=True)(text).tolist() == ids[:-1].tolist()
        mine = rows[rows.doc_id == i].sort_values("piece")
        assert [(r.start, r.length, r.ids_crc32) for r in mine.itertuples()] == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in packing.cut(len(ids), 2048)]
    t.encode_special_tokens = True
    counts = {r["doc_id"]: r["n_tokens"] for r in tokencount.document_counts(docs(spark, texts)).collect()}
    assert counts == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


# --- token counts ----------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separators_across_blocks(spark, tmp_path, block):
    r = random.Random(block)
    want = {}
    for f in range(3):
        lengths = [r.choice([0, 1, 2, 5, 20]) for _ in range(30)]
        ids = [x for n in lengths for x in [*[1] * n, 9]] + [1] * f
        np.array(ids, "<u2").tofile(tmp_path / f"{f}.bin")
        want |= {(f"{f}.bin", k): n for k, n in enumerate(lengths + ([f] if f else []))}
    (tmp_path / "empty.bin").touch()
    got = tokencount.count_documents(tokencount.flat_files(spark, str(tmp_path)), str(tmp_path), end_id=9, block_tokens=block).collect()
    assert {(x["file"], x["document"]): x["n_tokens"] for x in got} == want
    assert sorted(x["file"] for x in got if not x["closed"]) == ["1.bin", "2.bin"]


# --- WARC ------------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    tricky = "a\r\n\r\nb\r\n"
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", tricky), (4, "http://d", None), (5, "http://e", ""), (None, "http://f", "lone"), (7, "http://g", "WARC/1.1\r\n\r\n" * 3), (8, "http://h", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    raw, target = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_monolithic(pages.coalesce(2), raw)
    index = shared.staged(warc.normalise(spark, raw, target), "index")
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_indexed(index, target).collect()}
    assert back == {i: h or "" for i, _, h in rows}
    for r in index.collect():
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["size"])).startswith(b"WARC/1.1\r\n")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.roundtrip(pages).collect()}
    assert got[1] == ("revisit", 2) and got[2] == ("response", None) and got[4] == ("revisit", 5) and got[None] == ("response", None)
    few = {r["page_id"]: r["record_type"] for r in warc.roundtrip(pages, min_bytes=5).collect()}
    assert few[1] == "response"
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_cut_off_archive():
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records([b"WARC/1.1\r\nContent-Length: 10", b"abc"], "x"))


# --- near duplicates -------------------------------------------------------------------------------


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    at = list(range(len(texts)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                at[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed, base=12, each=25, words=60):
    """Groups of near copies of very different closeness, exact copies, fragments and odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    out = [None, "", "one", "one", "two words", "TWO Words"]
    for g in range(base):
        first = [r.choice(vocabulary) for _ in range(r.choice([8, words, 3 * words]))]
        for _ in range(each):
            x = list(first)
            for _ in range(r.randrange(0, max(2, len(x) // 8))):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            out.append(" ".join(x))
        out += [" ".join(first)] * g
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_components_against_brute_force(spark, seed, k, percent):
    texts = corpus(seed)
    want, sizes = brute_components(texts, k, percent)
    got = neardup.near_duplicates(docs(spark, texts), neardup.Params(words=k, percent=percent)).toPandas().sort_values("doc_id")
    assert got.n_shingles.tolist() == sizes
    assert got.component_id.tolist() == want
    assert got.kept.tolist() == [c == i for i, c in enumerate(want)]


def settle(spark, texts, p, monkeypatch=None):
    """Components of texts that are one group without any link, and the numbers of pairs that were looked at."""
    d, seen = docs(spark, texts), []
    if monkeypatch:
        staged = shared.staged
        monkeypatch.setattr(shared, "staged", lambda df, name: (out := staged(df, name), seen.append(out.count()) if name == "pairs" else None)[0])
    nodes = shared.staged(neardup.sketches(d, p).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "registers"), "nodes")
    groups = nodes.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    apart = nodes.select(F.col("id").alias("node"), F.col("id").alias("component"))
    none = spark.createDataFrame([], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.settled(nodes, neardup.member_sets(d, nodes, p), groups, apart, none, p).collect()}
    return [got.get(i, i) for i in range(len(texts))], sum(seen)


@pytest.mark.parametrize(("seed", "base", "each", "percent"), [(5, 2, 40, 85), (6, 1, 90, 85), (7, 3, 30, 80)])
def test_groups_are_settled_exactly(spark, seed, base, each, percent):
    """Links that no pivot shows are found by the group's centre and by rare differences alone."""
    texts = list(dict.fromkeys(t for t in corpus(seed, base=base, each=each) if t))
    want, _ = brute_components(texts, 3, percent)
    assert settle(spark, texts, neardup.Params(words=3, percent=percent))[0] == want


def test_pairs_grow_with_the_group_not_its_square(spark, monkeypatch):
    made = []
    for n in (150, 600):
        texts = list(dict.fromkeys(t for t in corpus(9, base=1, each=n, words=120) if t))
        with monkeypatch.context() as m:
            made.append(settle(spark, texts, neardup.Params(words=3, percent=85), m)[1])
    assert made[1] <= 6 * max(made[0], 150)


def test_estimates(spark):
    p = neardup.Params()
    r = np.random.default_rng(0)
    for share in (0.2, 0.6, 0.9):
        both = r.integers(0, 2**63, int(2000 * share), np.uint64)
        rest = [r.integers(0, 2**63, (2000 - len(both)) // 2, np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([both, x])) for x in rest)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = neardup.estimate(neardup.registers(a, p)[None], neardup.registers(b, p)[None], np.array([len(a)]), np.array([len(b)]), p.base)[0]
        assert abs(got - true) < 0.15
    whole = neardup.registers(np.union1d(a, b), p)
    assert (whole == np.maximum(neardup.registers(a, p), neardup.registers(b, p))).all()  # mergeable


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (300, 300)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100}


# --- lines -----------------------------------------------------------------------------------------


def brute_runs(texts, least):
    """Lines to remove by longest previous occurrences, quadratically."""
    seq = [(d, l) for d, t in enumerate(texts) if t is not None for l in t.split("\n") if l.encode().strip()]
    gone = set()
    for p in range(len(seq)):
        best = 0
        for q in range(p):
            n = 0
            while p + n < len(seq) and seq[p + n][0] == seq[p][0] and seq[q + n][0] == seq[q][0] and seq[p + n][1] == seq[q + n][1]:
                n += 1
            best = max(best, n)
        if best and sum(len(seq[p + i][1].split()) for i in range(best)) >= least:
            gone.update(range(p, p + best))
    counts, out = {}, {}
    for p, (d, _) in enumerate(seq):
        counts.setdefault(d, []).append(p in gone)
    for d, t in enumerate(texts):
        flags, keep = iter(counts.get(d, [])), []
        for l in (t or "").split("\n"):
            if not (l.encode().strip() and next(flags)):
                keep.append(l)
        out[d] = None if t is None else "\n".join(keep)
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 4), (2, 9), (3, 1)])
def test_runs_against_brute_force(spark, seed, least):
    r = random.Random(seed)
    lines = [" ".join("abcd"[r.randrange(4)] * 2 for _ in range(r.choice([1, 1, 2, 3, 6]))) for _ in range(12)] + ["", "  "]
    texts = ["\n".join(r.choice(lines) for _ in range(r.choice([0, 1, 3, 8, 40]))) for _ in range(40)] + [None]
    texts += [texts[3], texts[5], texts[5]]
    got = {x["doc_id"]: x["text"] for x in linededup.remove_repeated_runs(docs(spark, texts), linededup.Params(least)).collect()}
    assert got == brute_runs(texts, least)


# --- statistics, models ------------------------------------------------------------------------------


def test_runs_keep_clashing_columns(spark):
    """Columns named as the operator's own come back as they were, in their order."""
    names = ("_id", "_t1", "_t2", "_spans", "_out", "__id", "a.b", "n_lines")
    run = "\n".join(f"line {i} of a passage that two documents share word for word" for i in range(6))
    plain = docs(spark, [f"first\n{run}", f"second\n{run}", None, ""])
    given = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    got = linededup.remove_repeated_runs(given)
    assert got.columns == [*(c for c in given.columns if c not in ("text", "n_lines")), "text", "n_lines", "n_removed"]
    rows = sorted(got.collect(), key=lambda r: r["doc_id"])
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in rows] == [(f"first\n{run}", 7, 0), ("second", 7, 6), (None, 0, 0), ("", 0, 0)]
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names if c != "n_lines")


def brute_repeat(words):
    win = {}
    for i in range(len(words) - 7):
        win.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for starts in win.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)})


def test_repeat_words():
    r = random.Random(0)
    for n in [0, 1, 7, 8, 9, 16, 50, 400]:
        for size in (1, 2, 5, 50):
            w = [r.randrange(size) for _ in range(n)]
            w += w[: r.randrange(0, 12)]
            assert docstats.repeat_words(np.array(w, int)) == brute_repeat(w)


def test_forest_is_monotone_and_learns():
    r = np.random.default_rng(0)
    x = r.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (r.random(3000) < 0.1)).astype(float)
    p = rules.Params(trees=30)
    forest = rules.grow(x, y, np.array([-1, -1, 0]), p)
    assert ((forest.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.97
    for j in (0, 1):
        grid = np.repeat(r.random((50, 3)), 40, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(forest.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_factorisation_machine_pairs():
    p = fm.Params(buckets=50, bins=4, rank=3, epochs=60)
    r = np.random.default_rng(1)
    m = fm.Model(np.zeros((2, 3)), 0.3, r.normal(size=58), r.normal(size=(58, 3)))
    ids, values = np.array([1, 5, 9, 52]), r.normal(size=4)
    slow = 0.3 + (m.weight[ids] * values).sum() + sum(values[i] * values[j] * (m.factor[ids[i]] @ m.factor[ids[j]]) for i in range(4) for j in range(i))
    assert fm.margins(m, ids, values, np.array([0]))[0][0] == pytest.approx(slow)
    words = [(np.array([int(k % 2)]), np.array([1.0])) for k in range(400)]
    trained = fm.train(words, r.random((400, 2)), np.arange(400) % 2 * 1.0, p)
    a, b, s = fm.assemble(words[:2], r.random((2, 2)), trained.edges, p)
    score = fm.margins(trained, a, b, s)[0]
    assert score[1] > 1 > -1 > score[0]


def test_language_backoff(spark):
    rows = [(i, ("the cat and the dog" if i % 2 else "der hund und die katze") + f" x{i % 5}", "en" if i % 2 else "de") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    assert model.langs == ["de", "en"]
    score = lambda t: tuple(x[0] for x in langid.Scorer(model)([t]))
    assert score("½ ² 12 Ⅷ") == ("und", 0.0) and score("m²")[0] != "und"
    assert score("the dog")[0] == "en" and score("hunde")[0] == "de" and score("12 !")[0] == score(None)[0] == "und"
    assert all(0 <= score(t)[1] <= 1 for t in ("the", "zzz", "qqq"))
    kept = langid.accepted(d.union(spark.createDataFrame([(99, "123", "en"), (100, None, "en")], d.schema)), model)
    assert kept.columns == d.columns and kept.count() == 80


def test_texts_go_to_python_in_small_batches(spark):
    """Steps that give texts to Python bound the bytes of a batch, however long the texts are; a user's own limit stays."""
    d = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"), F.lit("en").alias("lang"))
    none = langid.Table(np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    model = langid.Model([], np.zeros(0), none, none)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    steps = [
        lambda: langid.accepted(d, model),
        lambda: langid.predict(d, model),
        lambda: langid.count_words(d.select("text", "lang")),
        lambda: linededup.line_keys(d),
        lambda: neardup.sketches(d, neardup.Params()),
        lambda: neardup.member_sets(d, d.select(F.col("doc_id").alias("id")), neardup.Params()),
        lambda: decontam.document_windows(d, np.zeros(8, bool), [5]),
        lambda: packing.token_pieces(d, 2048, tokens.default_path(), 0),
    ]
    try:
        for step in steps:
            spark.conf.unset(shared.ARROW_BYTES)
            step()
            seen = [r["n"] for r in d.mapInArrow(sizes, "n long").collect()]
            assert sum(seen) > 30e6 and max(seen) < 1.5 * shared.BATCH_BYTES
        spark.conf.set(shared.ARROW_BYTES, "1m")
        assert shared.in_small_batches(d) is d and spark.conf.get(shared.ARROW_BYTES) == "1m"
    finally:
        spark.conf.unset(shared.ARROW_BYTES)


def test_lines_are_removed_once(spark):
    """The pipeline's filter on what was removed doesn't cut each text a second time."""
    text = "\n".join(f"line {i} of a passage that others hold as well" for i in range(20))
    d = spark.createDataFrame([(1, f"{text}\nown words", 10), (2, f"{text}\nother words", 12), (3, text, 5), (4, None, None)], "doc_id long, text string, n_chars long")
    done = corpus_pipeline.lines(spark, d, "")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["doc_id"]: r["text"] for r in done.collect()} == {1: f"{text}\nown words", 2: "other words", 4: None}


# --- licences, benchmark ------------------------------------------------------------------------------


def test_licences(spark):
    files = [("r/COPYING", "Released under the MIT License."), ("r/a/b/x.py", "code"), ("r/a/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("r/c/y.py", "# This work is licensed under the GNU General Public License, version 3.\ncode"), ("other/z.py", "code"), (None, "All rights reserved."), ("r/w.py", None), ("top.py", "Licensed under CC BY-NC 4.0.")]
    got = {r["path"]: (r["license"], r["origin"], r["licensed_by"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["r/a/b/x.py"] == ("Apache-2.0", "inherited", "r/a/LICENSE.txt")
    assert got["r/w.py"] == ("MIT", "inherited", "r/COPYING")
    assert got["r/c/y.py"][:2] == ("GPL-3.0", "own") and got["other/z.py"] == (None, None, None)
    assert got["top.py"][0] == "CC-BY-NC-4.0" and got[None][0] == "Proprietary"


ITEM = "Alice has 12 apples and Bob gives her 5 more kg of pears before the market closes at 9 today"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (ITEM, 0),
        ("before. " + ITEM.replace("Alice", "Maria").replace("12", "340") + " after that", 2),
        (ITEM.replace("kg", "lbs"), 0),
        ("Maria has 3 apples and Maria gives her 3 more kg of pears before the market closes at 4 today", None),  # two values became one
        (" ".join(ITEM.split()[:10]), None),
        ("nothing of that kind is in this text at all", None),
    ],
)
def test_templates(spark, text, want):
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "")], "item_id long, text string")
    got = decontam.contaminated(docs(spark, [text, None]), items).collect()
    assert [(r["doc_id"], r["item_id"], r["changed_slots"]) for r in got] == ([] if want is None else [(0, 7, want)])
    assert decontam.clean(docs(spark, [text, None]), items).count() == (2 if want is None else 1)


@pytest.mark.parametrize("change", [str.lower, str.upper, str.swapcase, lambda t: t.upper().replace("12", "340")])
def test_copies_in_another_case(spark, change):
    """Case does not hide a copy, and a name in lower case must be the item's."""
    item = "That is where Maria Lopez met him. Then Straße 12 was closed. Nobody at Acme Corp knew. It took 3 days to open"
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    texts = [f"{' '.join(f'w{i}' for i in range(3000))} {change(item)} and more after", item.lower().replace("maria", "x").replace("acme", "y").replace("then", "z")]
    got = decontam.contaminated(docs(spark, texts), items).collect()
    assert [(r["doc_id"], r["item_id"], r["windows"], r["matched"], r["changed_slots"]) for r in got] == [(0, 7, 19, 19, int("340" in change(item)))]


@pytest.mark.parametrize(
    ("edits", "matched", "changed"),
    [
        ({2: "13"}, 33, 0),  # one of two occurrences of a value: three windows speak against the rest
        ({37: "Maria"}, 33, 0),
        ({2: "13", 37: "Maria"}, 30, 0),
        ({2: "30", 30: "30"}, 36, 1),
        ({2: "30", 30: "40"}, None, None),  # neither value stands
    ],
)
def test_one_edited_occurrence(spark, edits, matched, changed):
    """A value that contradicts the mapping costs its windows and no more."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    words[0], words[37], words[2], words[30] = "Alice", "Alice", "12", "12"
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    text = " ".join(edits.get(i, w) for i, w in enumerate(words))
    got = decontam.contaminated(docs(spark, [text]), items).collect()
    assert [(r["doc_id"], r["windows"], r["matched"], r["changed_slots"]) for r in got] == ([] if matched is None else [(0, 36, matched, changed)])


def test_items_shorter_than_a_window(spark):
    """Short items are found inside long documents; those of slots alone by equal values only."""
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "Photosynthesis"), (3, "42 kg"), (4, "define the word entropy"), (5, ITEM), (6, "12 or 12")], "item_id long, text string")
    long = "and so on with many more plain words until the end of it all"
    texts = [f"{long} who wrote hamlet? {long}", f"{long} photosynthesis {long}", f"{long} 41 kg {long} 42 KG {long}", f"{long} 41 kg {long}", f"define the word {long}", "entropy", f"{long} {ITEM.upper()}", "42 kg", f"{long} 3 or 4 {long}", f"{long} 3 or 3 {long}", None]
    got = {(r["doc_id"], r["item_id"], r["changed_slots"]) for r in decontam.contaminated(docs(spark, texts), items).collect()}
    assert got == {(0, 1, 0), (1, 2, 0), (2, 3, 0), (6, 5, 0), (7, 3, 0), (9, 6, 1)}


def test_entropy_of_nothing():
    assert math.isfinite(licenses.weights()[0]["license"])


def test_licence_scores_are_cosines():
    """Every score against dense vectors over all words, those that no template has included."""
    rng = np.random.default_rng(5)
    idf, rarest, vectors = licenses.weights()
    words = [*sorted(idf), *(f"foreign{chr(97 + i)}" for i in range(26))]
    place = {w: i for i, w in enumerate(words)}
    dense = np.zeros((len(vectors), len(words)))
    for i, (_, v) in enumerate(vectors):
        dense[i, [place[w] for w in v]] = list(v.values())
    weight = np.array([idf.get(w, rarest) for w in words])
    match = licenses.Matcher()
    for n in (1, 3, 10, 60, 400):
        drawn = rng.choice(len(words), n)
        x = np.bincount(drawn, minlength=len(words)) * weight
        want = dense @ x / np.linalg.norm(x)
        got = match.cosines(" ".join(words[i] for i in drawn))
        assert all(abs(got.get(i, (0.0, 0))[0] - w) < 1e-12 for i, w in enumerate(want))


def test_licence_norm_counts_foreign_words(spark):
    header = "Licensed under the Apache License, Version 2.0"
    foreign = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q" for i in range(6400))
    files = [("a/LICENSE", f"{foreign} {header}"), ("b/LICENSE", f"{foreign}. {header}. {foreign}"), ("c/x.py", "Copyright 2020 Somebody Else"), ("d/x.py", ""), ("d/x.py", header), (None, None), ("e/LICENSE", None)]
    got = [(r["path"], r["license"], r["score"], r["origin"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()]
    want = {("b/LICENSE", "Apache-2.0", 1.0, "own"), ("c/x.py", None, None, None), ("d/x.py", None, None, None), ("d/x.py", "Apache-2.0", 1.0, "own"), (None, None, None, None), ("e/LICENSE", None, None, None)}
    assert len(got) == 7 and want <= set(got)
    assert next(r for r in got if r[0] == "a/LICENSE")[1] is None


def test_licences_inherited_by_a_hot_directory(spark):
    """All files in one directory and its root, against a walk up the path."""
    files = [("r/LICENSE", "Released under the MIT License."), *((f"r/a/b/f{i}.py", "code") for i in range(3000)), *((f"s{i}/f.py", "code") for i in range(500)), ("r/a/c/COPYING.md", "All rights reserved."), ("r/a/c/d/e.py", "x")]
    got = {r["path"]: (r["license"], r["licensed_by"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert len(got) == len(files)
    assert all(got[f"r/a/b/f{i}.py"] == ("MIT", "r/LICENSE") for i in range(3000))
    assert all(got[f"s{i}/f.py"] == (None, None) for i in range(500)) and got["r/a/c/d/e.py"] == ("Proprietary", "r/a/c/COPYING.md")


def test_full_licence_texts_as_templates(spark):
    clauses = [f"clause {chr(97 + i)} grants licence holders right{chr(97 + i)} and duty{chr(97 + i)}" for i in range(20)]
    full = {"House-1": ". ".join(clauses[:12]) + ". ", "House-2": ". ".join(clauses[8:]) + ". "}
    files = [("a/LICENSE", "\n".join(clauses[:12])), ("b/LICENSE", "\n".join(clauses[8:])), ("b/c/x", "code")]
    got = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(files, "path string, text string"), templates=full).collect()}
    assert got == {"a/LICENSE": "House-1", "b/LICENSE": "House-2", "b/c/x": "House-2"}
    with pytest.raises(ValueError, match="characters"):
        licenses.weights({"long": "x" * 4_000_001})
