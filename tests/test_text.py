import re
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import text as X
from tidegauge.operators import articles as A


def run(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


def rel(spark, title, body):
    r = run(spark, X.relevance("t", X.clean("b")), t=title, b=body)
    return r["keep"], r["score"]


def test_footer_is_cut(spark):
    body = "Copper output fell for a third month. Related stories Bitcoin miners, Bitcoin funds"
    assert "Bitcoin" not in run(spark, X.clean("b"), b=body)
    assert rel(spark, "Copper output", body) == (False, 0)


def test_entities_tags_and_space(spark):
    assert run(spark, X.clean("b"), b=" <p>a &amp;  b</p>\n\x01c ") == "a & b c"
    assert run(spark, X.clean("b"), b=None) == ""


def test_lookalike(spark):
    assert rel(spark, "Bitcoin Cash wallets load faster", "BCH developers shipped a release") == (False, 0)
    keep, score = rel(spark, "BTC leads as Bitcoin Cash lags", "Desks quoted BTC apart from its fork.")
    assert keep and score >= 2


@pytest.mark.parametrize(("title", "body", "want"), [("Bitcoin funds take in cash", "Weekly figures", "title_primary"), ("Notes on currencies", "Some bitcoin changed hands in spring and more bitcoin in autumn.", "content_repeated")])
def test_evidence(spark, title, body, want):
    assert run(spark, X.evidence("t", "b"), t=title, b=body) == want


@pytest.mark.parametrize(("title", "body", "want"), [("SEC puts off an ETF ruling", "", "regulation_etf"), ("Notice to customers", "Our custodian was hacked on Sunday.", "security_hack"), ("Bitcoin on stage", "", "direct_bitcoin")])
def test_family(spark, title, body, want):
    assert run(spark, X.family("t", "b"), t=title, b=body) == want


def decide(spark, title, body, enabled, refined=False):
    e = F.array(*(F.lit(x) for x in enabled))
    return run(spark, X.event_decision("t", "b", e, refined=refined), t=title, b=body)


def test_event_decisions(spark):
    r = decide(spark, "Small cryptocurrency exchange was hacked at night", "", ["security_hack"])
    assert (r["keep"], r["score"], r["reason"]) == (True, 2, "context_event:security_hack")
    r = decide(spark, "Bitcoin Cash price analysis for Friday", "BCH sits between support and resistance.", ["security_hack"])
    assert (r["keep"], r["score"], r["reason"], r["recap"]) == (False, 0, "lookalike_price_recap", True)
    r = decide(spark, "Developer notes", "On Sunday a Bitcoin wallet was launched by two students.", ["security_hack"], True)
    assert r["keep"] and r["reason"] == "direct_concrete_repair"


def removed(spark, rows):
    df = spark.createDataFrame(rows, "scan_pos long, ts timestamp, title string, body string")
    return [r["removed_by"] for r in A.first_seen(df).orderBy("scan_pos").collect()], [r["removed_by"] for r in A.strict_duplicates(df).orderBy("scan_pos").collect()]


NINE, TEN = datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 10)


def test_first_seen(spark):
    rows = [(0, NINE, "Rates, again", "p"), (1, NINE, "rates \u2014 AGAIN", "q"), (2, TEN, "harvest", "p"), (3, TEN, "ports", "r")]
    assert removed(spark, rows) == ([None, "title", "content", None],) * 2


def test_removed_rows_register_no_keys(spark):
    rows = [(0, NINE, "k", "p"), (1, TEN, "l", "p"), (2, TEN, "l", "q")]
    assert removed(spark, rows) == ([None, "content", None], [None, "content", "title"])


def test_empty_keys_match_nothing_and_content_is_normalised(spark):
    rows = [(0, NINE, "", "p"), (1, NINE, "", "q"), (2, NINE, "k", ""), (3, TEN, "l", " !"), (4, TEN, None, None), (5, TEN, "m", "Dry spring?"), (6, NINE, "n", "dry  spring")]
    assert removed(spark, rows) == ([None] * 6 + ["content"],) * 2
    assert removed(spark, []) == ([], [])


def test_duplicate_keys_fold_every_character(spark):
    """Against Python's NFKD; only texts with a character that becomes several go to Python."""
    texts = ["Ça–va  ÉTÉ", "e\u0301\u0323té ﬁn… ½", "١٢ 𝔘 Ⅳ x\u00a0y", "ﬀ", "日本 ok", None, ""] + [f"a{chr(i)}b" for i in range(0x80, 0x10FFFF, 97) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()).strip(" ") for t in texts]
    assert [r["k"] for r in df.select(X.duplicate_key("t").alias("k")).collect()] == want
    plan = df.select(X.duplicate_key("t").alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_ascii(CASE WHEN" in plan  # a null for every other text


def test_budget_and_chunks(spark):
    body = " ".join(f"w{i}" for i in range(100))
    got = run(spark, X.budgeted("t", "b", 20), t="Harbour notice", b=body)
    assert len(got.split()) <= 20 and got.startswith("Title: Harbour notice")
    assert run(spark, X.chunks("b", 30), b=body)[-1] == " ".join(f"w{i}" for i in range(90, 100))
    assert run(spark, X.chunks("b", 30), b="") == [""]
