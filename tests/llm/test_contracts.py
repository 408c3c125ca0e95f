"""Queries and pipeline stages against DuckDB, brute force and held-out labels."""

import math
import sys
import zlib
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus_pipeline
from test_llm_small import brute_components

from tidegauge.llm import oracles, queries, tokens

DATA = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"
ITEM_TEXT = "text"

BASE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS k FROM w),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 8)) AS o) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (
SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)) AS q"""


def auc(scores, labels):
    """Share of pairs of a good and a bad row that are in order; ties count half."""
    good, bad = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def quality():
    return {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}


def test_base_counts_against_sql(spark, quality):
    """op7's base columns equal SQL; kept is false where they fail, and the verdict separates held-out labels."""
    got = {r["doc_id"]: r for r in queries.op7_quality_rules(spark, DATA).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(BASE)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert len(rows) == len(got)
    for r in rows:
        assert {k: got[r["doc_id"]][k] for k in r} == r
        assert not (r["base_failed"] and got[r["doc_id"]]["kept"])
    test = [r for i, r in got.items() if held_out(i) and quality.get(i) is not None]
    assert auc([r["score"] for r in test], [quality[r["doc_id"]] for r in test]) > 0.95


def test_quality_on_held_out_documents(spark, quality):
    rows = queries.op2_quality_fm(spark, DATA).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held_out(r["doc_id"]) for r in rows)
    test = [r for r in rows if r["held_out"] and quality.get(r["doc_id"]) is not None]
    assert auc([r["score"] for r in test], [quality[r["doc_id"]] for r in test]) > 0.95


def test_languages_on_held_out_documents(spark):
    lang = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang", "text"]).to_pylist()}
    rows = queries.op5_language_id(spark, DATA).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, lang[r["doc_id"]]["text"] or ""))) for r in rows)
    test = [r for r in rows if r["held_out"] and lang[r["doc_id"]]["lang"] is not None]
    assert sum(r["lang_pred"] == lang[r["doc_id"]]["lang"] for r in test) >= 0.97 * len(test)


# --- the pipeline --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """A folder with the tiny tables and more documents: odd ones, copies, shared passages and a benchmark item."""
    folder = tmp_path_factory.mktemp("planted")
    docs, items = pq.read_table(f"{TINY}/documents.parquet"), pq.read_table(f"{TINY}/benchmark.parquet")
    texts = [t for t in docs.column("text").to_pylist() if t and len(t.split()) > 60]
    prompt = next(t for t in items.column(ITEM_TEXT).to_pylist() if len(t.split()) >= 8)
    near = texts[1].split(" ")
    near[len(near) // 2] = "otherwise"
    passage = "\n".join(f"{part} {i}" for i, part in enumerate(texts[2].replace("\n", " ").split(". ")))
    more = {
        "null": None,
        "empty": "",
        "no letter": "12 345 ½ ---",
        "exact": texts[0],
        "near": " ".join(near),
        "passage": f"{texts[3]}\n{passage}",
        "passage again": f"One sentence that stands nowhere else in these tables.\n{passage}",
        "item": f"{texts[5]}\n{prompt}\n{texts[6]}",
    }
    first = max(docs.column("doc_id").to_pylist()) + 1
    ids = {name: first + i for i, name in enumerate(more)}
    rows = [{c: None for c in docs.column_names} | {"doc_id": ids[n], "text": t, "n_chars": len(t or "")} for n, t in more.items()]
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(rows, docs.schema)]), folder / "documents.parquet")
    pq.write_table(items, folder / "benchmark.parquet")
    return str(folder), ids, prompt


def test_pipeline_stages(spark, planted, tmp_path):
    """Each stage on what its predecessor kept, against SQL or brute force."""
    sf_dir, ids, prompt = planted
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == columns
            kept[name] = {r["doc_id"]: r for r in after.collect()}
        docs = after if i < 4 else docs
        if name == "language ID":
            assert all(before[d] == r for d, r in kept[name].items())
            assert not {ids["null"], ids["empty"], ids["no letter"]} & kept[name].keys()
            clean = [d for d, r in before.items() if r["lang"] is not None and any(map(str.isalpha, r["text"] or ""))]
            assert len(kept[name].keys() & set(clean)) >= 0.97 * len(clean)
        elif name == "line dedup":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{i - 1}/*.parquet'")
            want = {d: t for d, t, n, gone in con.sql(f"SELECT doc_id, text, n_lines, n_removed FROM ({oracles.LINE_RUNS}) AS q").fetchall() if gone == 0 or gone < n}
            assert {d: r["text"] for d, r in kept[name].items()} == want
            assert ids["exact"] not in want and len(want[ids["passage again"]]) < len(before[ids["passage again"]]["text"])
            assert all(r["n_chars"] == (len(r["text"]) if r["text"] != before[d]["text"] else before[d]["n_chars"]) for d, r in kept[name].items())
        elif name == "near dedup":
            order = sorted(before)
            group, _ = brute_components([before[d]["text"] for d in order], 5, 80)
            assert kept[name].keys() == {d for k, d in enumerate(order) if group[k] == k}
            assert all(before[d] == r for d, r in kept[name].items())
        elif name == "decontamination":
            words = lambda t: (t or "").lower().split()
            items = [words(t) for t in pq.read_table(f"{sf_dir}/benchmark.parquet").column(ITEM_TEXT).to_pylist()]
            whole = {d for d, r in before.items() if any(f" {' '.join(x)} " in f" {' '.join(words(r['text']))} " for x in items if x)}
            assert ids["item"] in whole and not whole & kept[name].keys()
            # what shares no three words in a row with any item, numbers apart, is clean
            digits = lambda w: ["#" if any(map(str.isdigit, x)) else x.strip(".,;:!?\"'()") for x in w]
            threes = {tuple(x[k : k + 3]) for x in map(digits, items) for k in range(len(x) - 2)}
            free = {d for d, r in before.items() if not threes & {tuple(x[k : k + 3]) for x in [digits(words(r["text"]))] for k in range(len(x) - 2)}}
            assert free <= kept[name].keys()
        else:
            check_packing(after.collect(), before)


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == docs.keys()
    for d, pieces in by_doc.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and [s for _, s, _ in pieces] == [sum(n for _, _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, _, n in pieces) == len(t.encode(docs[d]["text"] or "", add_special_tokens=False).ids) + 1
    for places in by_sequence.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 2048
    total = sum(r["length"] for r in rows)
    assert math.ceil(total / 2048) <= len(by_sequence) <= 1.1 * total / 2048 + 1


def test_run_is_its_stages(spark, planted):
    """run() gives what the stages give one by one; a table without rows gives none."""
    sf_dir, _, _ = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.agg(F.count("*") > 0).first()[0]
