"""Queries over articles and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import text as X
from tidegauge.functions.lexicon import Lexicon
from tidegauge.operators import articles as A
from tidegauge.operators import review as R
from tidegauge.plans import tables as T
from tidegauge.plans.tables import tidy, tidy_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return keep


#: The terms of news on one asset don't occur in the test tables; these do.
LEXICON = Lexicon(
    primary=(r"\bthe\b", r"\bder\b", r"\bles\b"),
    lookalike=(r"\bque los\b", r"\bque\b"),
    specific=(r"\bwhst\b", r"\bgeist\b", r"\bouré\b"),
    footers=(r"released under", r"all rights reserved", r"licensed under"),
    families=(("hack", (" idiot", " scum", " trash")), ("rules", (" licen", " rights ")), ("english", (" the ", " and ")), ("german", (" der ", " und ")), ("french", (" les ", " des ")), ("recap", (" para ",))),
    anchor=r"\b(that|mit|avec|los)\b",
    concrete=r"\b(worthless|pathetic|clown|nicht|pour)\w*\b",
    direct_family="german",
    recap_family="recap",
    vague_family="french",
    context_families=("hack", "rules", "english", "french"),
    locked_families=("hack", "rules"),
)


def _any(patterns, text: str) -> str:
    return f"regexp_matches({text}, '(?i)(?:{'|'.join(patterns)})')".replace(r"\b", r"\b")


def _hits(patterns, text: str) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, '(?i){p}'))" for p in patterns)


_L = LEXICON
# DuckDB's \b knows ASCII letters only, so the corpus is compared in ASCII letters on both sides
_PLAIN = "regexp_replace(%s, '[^ -~\\n]', 'x', 'g')"
CLEAN = T.ARTICLES.replace("FROM documents", "FROM documents") + f""", plain AS (SELECT * REPLACE ({_PLAIN % "title"} AS title, {_PLAIN % "body"} AS body) FROM articles),
clean0 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(body, '(?is)({'|'.join(_L.footers)}).*$', ''), '<[^>]+>', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]+', ' ', 'g') AS body) FROM plain),
cleaned AS (SELECT * REPLACE (regexp_replace(regexp_replace(body, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS body) FROM clean0)"""
SCORED = CLEAN + f""", hits AS (SELECT *, {_hits(_L.primary, 'title')} AS th, {_hits(_L.primary, 'substr(body, 1, 2000)')} AS ch, {_any(_L.specific, 'title')} AS ts_, {_any(_L.specific, 'substr(body, 1, 2000)')} AS cs_, {_any(_L.lookalike, "title || ' ' || substr(body, 1, 2000)")} AS la, {_any(_L.primary, 'substr(body, 1, 500)')} AS p5 FROM cleaned),
points AS (SELECT *, (la AND th + ch = 0 AND NOT ts_ AND NOT cs_) AS looks, CASE WHEN th > 0 THEN 3 ELSE 0 END + CASE WHEN p5 THEN 2 ELSE 0 END + CASE WHEN ts_ OR cs_ THEN 2 ELSE 0 END + CASE WHEN th + ch >= 3 THEN 1 ELSE 0 END AS pts FROM hits),
scored AS (SELECT *, CAST(ts AS DATE) AS day, CASE WHEN looks THEN 0 ELSE pts END AS score, (th > 0 OR ts_ OR ch >= 2 OR cs_) AND NOT looks AND pts >= 2 AS keep,
CASE WHEN th > 0 THEN 'title_primary' WHEN ts_ THEN 'title_specific' WHEN cs_ THEN 'content_specific' WHEN ch >= 2 THEN 'content_repeated' WHEN ch = 1 THEN 'content_single' ELSE 'no_evidence' END AS evidence,
CASE WHEN (CASE WHEN looks THEN 0 ELSE pts END) < 2 THEN 'below_threshold' WHEN pts = 2 THEN 'threshold_2' WHEN pts = 3 THEN 'score_3' ELSE 'score_4_plus' END AS band,
CASE {' '.join('WHEN ' + ' OR '.join(f"contains(lower(' ' || title || ' ' || substr(body, 1, 2000) || ' '), '{x}')" for x in needles) + f" THEN '{name}'" for name, needles in _L.families)} ELSE 'other' END AS family FROM points)"""


def _articles(s, d):
    plain = lambda c: F.regexp_replace(c, r"[^ -~\n]", "x")
    return T.articles(s, d).withColumns({"title": plain("title"), "body": plain("body")})


def _scored(s, d):
    return A.scored(_articles(s, d), LEXICON, entities=False)


@query("d01_clean_text", tidy_sql("SELECT doc_id, length(body) AS chars, md5(body) AS digest FROM cleaned", ctes=CLEAN))
def clean(s, d):
    c = _articles(s, d).withColumn("body", X.clean("body", LEXICON, entities=False))
    return c.select("doc_id", F.length("body").cast("long").alias("chars"), F.md5("body").alias("digest"))


@query("d02_relevance", tidy_sql("SELECT doc_id, keep, CAST(score AS BIGINT) AS score, evidence, band, family FROM scored", ctes=SCORED))
def relevance(s, d):
    return _scored(s, d).select("doc_id", "keep", "score", "evidence", "band", "family")


@query("d05_load_counters", tidy_sql("SELECT count(*) AS scanned, count(*) FILTER (WHERE ts IS NULL) AS invalid_timestamp, count(*) FILTER (WHERE NOT inside) AS outside_range, count(*) FILTER (WHERE inside AND NOT keep) AS irrelevant, count(*) FILTER (WHERE inside AND keep) AS retained FROM (SELECT *, day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AS inside FROM scored)", ctes=SCORED))
def counters(s, d):
    return A.load_counters(_articles(s, d), "2024-01-05", "2024-01-25", LEXICON, entities=False)


_S5 = "substr(body, 1, 500)"
_FAM5 = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(' ' || title || ' ' || {_S5} || ' '), '{x}')" for x in needles) + f" THEN '{name}'" for name, needles in _L.families) + " ELSE 'other' END"
DECIDED = CLEAN + f""", h5 AS (SELECT *, {_hits(_L.primary, 'title')} AS th, {_hits(_L.primary, _S5)} AS ch, {_any(_L.specific, 'title')} AS ts_, {_any(_L.specific, _S5)} AS cs_, {_any(_L.lookalike, f"title || ' ' || {_S5}")} AS la, {_any(_L.lookalike, 'title')} AS lt, {_any(_L.primary, _S5)} AS p5, {_FAM5} AS family, {_any((_L.anchor,), f"title || ' ' || {_S5}")} AS anchor, {_any((_L.concrete,), f"title || ' ' || {_S5}")} AS concrete FROM cleaned),
p5 AS (SELECT *, la AND th + ch = 0 AND NOT ts_ AND NOT cs_ AS looks, CASE WHEN th > 0 THEN 3 ELSE 0 END + CASE WHEN p5 THEN 2 ELSE 0 END + CASE WHEN ts_ OR cs_ THEN 2 ELSE 0 END + CASE WHEN th + ch >= 3 THEN 1 ELSE 0 END AS pts FROM h5),
d5 AS (SELECT *, (th > 0 OR ts_ OR ch >= 2 OR cs_) AND NOT looks AND pts >= 2 AS direct FROM p5),
decided AS (SELECT doc_id, family = 'recap' AS recap, CASE WHEN lt AND th = 0 AND family = 'recap' THEN 'lookalike_price_recap' WHEN direct THEN 'direct_rule' WHEN family IN ('hack', 'rules', 'french') AND anchor AND (family <> 'french' OR concrete) THEN 'context_event:' || family
WHEN family = 'german' AND concrete THEN 'direct_concrete_repair' ELSE 'no_enabled_event:' || family END AS reason, CASE WHEN lt AND th = 0 AND family = 'recap' THEN 0 WHEN direct THEN CASE WHEN family = 'recap' THEN 1 ELSE greatest(pts, 1) END WHEN family IN ('hack', 'rules', 'french') AND anchor AND (family <> 'french' OR concrete) THEN 2
WHEN family = 'german' AND concrete THEN 2 ELSE 0 END AS score FROM d5)"""


def _decided(s, d):
    c = _articles(s, d).withColumn("body", X.clean("body", LEXICON, entities=False))
    return A.decided(c, ["hack", "rules", "french"], LEXICON, refined=True)


@query("d10_event_decision", tidy_sql("SELECT doc_id, CAST(score AS BIGINT) AS score, reason, recap FROM decided", ctes=DECIDED))
def decision(s, d):
    return _decided(s, d).select("doc_id", "score", "reason", "recap")


@query("d11_reason_counts", tidy_sql("SELECT reason, count(*) AS n FROM decided GROUP BY 1", ctes=DECIDED))
def reason_counts(s, d):
    return A.reason_counts(_decided(s, d))


_KEYS = ", keyed AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS tk, trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')) AS ck FROM plain)"


@query("d13_strict_duplicates", tidy_sql("SELECT doc_id, CASE WHEN tk <> '' AND a > 1 THEN 'title' WHEN ck <> '' AND b > 1 THEN 'content' END AS removed_by FROM (SELECT doc_id, tk, ck, row_number() OVER (PARTITION BY ts, tk ORDER BY scan_pos) AS a, row_number() OVER (PARTITION BY CAST(ts AS DATE), ck ORDER BY scan_pos) AS b FROM keyed)", ctes=CLEAN + _KEYS))
def strict(s, d):
    return A.strict_duplicates(_articles(s, d)).select("doc_id", "removed_by")


@query("d13_first_seen")
def first_seen(s, d):
    return A.first_seen(T.articles(s, d)).select("doc_id", "removed_by")


@query("d12_duplicate_key", tidy_sql("SELECT doc_id, tk AS title_key FROM keyed", ctes=CLEAN + _KEYS))
def title_key(s, d):
    return _articles(s, d).select("doc_id", X.duplicate_key("title").alias("title_key"))


@query("d16_chunks", f"WITH {T.pieces_sql(50)} SELECT * FROM pieces")
def chunks(s, d):
    return A.chunked(T.articles(s, d), 50)


def _windows(text: str, size: int = 40, step: int = 30):
    """Windows of size words that overlap; none for a text without words."""
    words = text.split(" ")
    for i, start in enumerate(range(0, max(len(words) - size, 0) + step, step) if text.strip(" ") else ()):
        if start < len(words):
            yield i, len(words[start : start + size]), " ".join(words[start : start + size])


@query("l04_generated_windows", """SELECT doc_id, CAST(i AS BIGINT) AS part, CAST(len(p) AS BIGINT) AS n_words, md5(array_to_string(p, ' ')) AS digest FROM (SELECT doc_id, i, w[i * 30 + 1:i * 30 + 40] AS p FROM (
SELECT doc_id, w, unnest(range(CAST(ceil((greatest(len(w) - 40, 0) + 30) / 30.0) AS BIGINT))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE trim(text, ' ') <> ''))) WHERE len(p) > 0""")
def windows(s, d):
    made = A.generated(T.articles(s, d), _windows, "part int, n_words int, window string")
    return made.select("doc_id", "part", "n_words", F.md5("window").alias("digest"))


@query("d17_length_audit", tidy_sql("SELECT lang, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99, count(*) FILTER (WHERE n > 512)::DOUBLE / count(*) AS over FROM (SELECT lang, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) AS n FROM plain) GROUP BY 1", "p50 p90 p99 over", ctes=CLEAN).replace("AS over", 'AS "over"').replace("round(over, 6)", 'round("over", 6)'))
def lengths(s, d):
    return A.length_audit(_articles(s, d), ["lang"])


@query("d18_source_concentration", tidy_sql("SELECT year, CAST(sum(n) AS BIGINT) AS articles, count(*) AS sources, arg_min(source, row(-n, source)) AS largest, max(n) / sum(n) AS largest_share, sum(n * n) / (sum(n) * sum(n)) AS hhi FROM (SELECT CAST(year(ts) AS BIGINT) AS year, CASE WHEN trim(coalesce(source, '')) = '' THEN '__unknown_source__' ELSE source END AS source, count(*)::DOUBLE AS n FROM articles GROUP BY 1, 2) GROUP BY 1", "largest_share hhi", ctes=T.ARTICLES))
def concentration(s, d):
    return A.source_concentration(T.articles(s, d))


@query("d19_source_shares", tidy_sql("SELECT period, source, n, n::DOUBLE / sum(n) OVER (PARTITION BY period) AS share, count(*) OVER (PARTITION BY period) AS sources FROM (SELECT CAST(date_trunc('month', ts) AS DATE) AS period, source, count(*) AS n FROM articles GROUP BY 1, 2)", "share", "period", ctes=T.ARTICLES))
def shares(s, d):
    return A.source_shares(T.articles(s, d))


@query("d20_count_rollup", tidy_sql("SELECT CAST(date_trunc('month', day) AS DATE) AS period, quantile_cont(articles, 0.5) AS median, avg(articles) AS mean, quantile_cont(articles, 0.9) AS p90, max(articles) AS maximum, count(*) FILTER (WHERE articles = 0)::DOUBLE / count(*) AS empty_rate, CAST(sum(articles) AS BIGINT) AS total FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS articles FROM articles GROUP BY 1) GROUP BY 1", "median mean p90 empty_rate", "period", ctes=T.ARTICLES))
def rollup(s, d):
    return A.count_rollup(T.articles(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("articles")))


@query("d22_first_examples", tidy_sql("SELECT doc_id, keep FROM scored QUALIFY row_number() OVER (PARTITION BY keep ORDER BY scan_pos) <= 100", ctes=SCORED))
def examples(s, d):
    return A.first_examples(_scored(s, d)).select("doc_id", "keep")


@query("d23_date_only", tidy_sql("SELECT doc_id FROM articles WHERE ts = date_trunc('day', ts) AND length(CASE WHEN doc_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END) <= 10", ctes=T.ARTICLES))
def date_only(s, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return A.date_only(T.articles(s, d).withColumn("raw_ts", raw)).select("doc_id")


@query("d24_order_audit", tidy_sql("SELECT source, count(*) AS rows, count(*) FILTER (WHERE ts < p) AS out_of_order, bool_and(coalesce(ts >= p, true)) AS ordered FROM (SELECT source, ts, lag(ts) OVER (PARTITION BY source ORDER BY scan_pos) AS p FROM articles) GROUP BY 1", ctes=T.ARTICLES))
def order(s, d):
    return A.order_audit(T.articles(s, d), by=["source"])


@query("d26_day_summary", tidy_sql("SELECT day, count(*) AS articles, count(DISTINCT source) AS sources, min(ts) AS first_ts, max(ts) AS last_ts, (SELECT count(DISTINCT family) FROM scored s2 WHERE s2.day = s1.day) AS families, least(5, count(*)) AS titles FROM scored s1 GROUP BY day", days="day", times="first_ts last_ts", ctes=SCORED))
def summary(s, d):
    out = A.day_summary(_scored(s, d))
    return out.withColumns({"families": F.size("families").cast("long"), "titles": F.size("titles").cast("long")})


REVIEW = SCORED + ", review AS (SELECT s.*, CASE WHEN keep THEN 'retained' ELSE 'removed' END AS decision, CAST(year(ts) AS BIGINT) AS year, l.quality, l.toxic FROM scored s LEFT JOIN labels l USING (doc_id))"


def _review(s, d):
    lab = T.read(s, d, "labels").select("doc_id", "quality", "toxic")
    return _scored(s, d).join(lab, "doc_id", "left").withColumns({"decision": F.when(F.col("keep"), "retained").otherwise("removed"), "year": F.year("ts").cast("long")})


@query("e01_stratified_sample", tidy_sql("SELECT doc_id, decision, evidence, band, row_number() OVER (PARTITION BY decision, year, evidence, band ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS sample_rank FROM review QUALIFY sample_rank <= 10", ctes=REVIEW))
def sample(s, d):
    return R.stratified_sample(_review(s, d), 10).select("doc_id", "decision", "evidence", "band", "sample_rank")


_POP = ", pop AS (SELECT decision, year, evidence, band, count(*) AS population_n FROM review GROUP BY ALL)"


@query("e02_population", tidy_sql("SELECT * FROM pop", ctes=REVIEW + _POP))
def population(s, d):
    return R.population(_review(s, d))


@query("e03_choose_quotas", tidy_sql("""SELECT retained_quota, removed_quota, CAST(a + b AS BIGINT) AS total FROM (SELECT q AS retained_quota, (SELECT coalesce(sum(least(population_n, q)), 0) FROM pop WHERE decision = 'retained') AS a FROM range(4, 101) t(q)) x CROSS JOIN (SELECT q AS removed_quota, (SELECT coalesce(sum(least(population_n, q)), 0) FROM pop WHERE decision = 'removed') AS b FROM range(4, 101) t(q)) y ORDER BY abs(a + b - 200), abs(a - b), retained_quota + removed_quota, retained_quota, removed_quota LIMIT 1""", ctes=REVIEW + _POP))
def quotas(s, d):
    return R.choose_quotas(R.population(_review(s, d)), 200)


@query("e05_sampling_weights", tidy_sql("SELECT r.doc_id, population_n / least(population_n, 10)::DOUBLE AS sampling_weight FROM (SELECT *, row_number() OVER (PARTITION BY decision, year, evidence, band ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM review) r JOIN pop USING (decision, year, evidence, band) WHERE k <= 10", "sampling_weight", ctes=REVIEW + _POP))
def sampling(s, d):
    r = _review(s, d)
    return R.sampling_weights(R.stratified_sample(r, 10), R.population(r)).select("doc_id", "sampling_weight")


@query("e09_agreement", tidy_sql("SELECT CAST(n AS BIGINT) AS n, po AS agreement, CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END AS kappa FROM (SELECT n, same / n AS po, (q1 * t1 + (n - q1) * (n - t1)) / (n * n) AS pe FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE quality = toxic) AS same, sum(quality) AS q1, sum(toxic) AS t1 FROM labels))", "agreement kappa"))
def agreement(s, d):
    p = T.read(s, d, "labels").select(F.col("quality").alias("pass_1"), F.col("toxic").alias("pass_2"))
    return R.agreement(p)


@query("e08_vote", tidy_sql("SELECT doc_id, CASE WHEN a = b THEN a WHEN a = c THEN a WHEN b = c THEN b ELSE 'uncertain' END AS label, CAST(CASE WHEN a = b OR a = c THEN 1 WHEN b = c THEN 2 END AS BIGINT) AS chosen, a = b OR a = c OR b = c AS resolved FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS a, CASE WHEN toxic = 1 THEN 'irrelevant' ELSE 'relevant' END AS b, CASE WHEN doc_id % 3 = 0 THEN 'relevant' WHEN doc_id % 3 = 1 THEN 'irrelevant' ELSE 'uncertain' END AS c FROM labels)"))
def votes(s, d):
    lab = T.read(s, d, "labels")
    a = lab.select("doc_id", F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("label"))
    b = lab.select("doc_id", F.when(F.col("toxic") == 1, "irrelevant").otherwise("relevant").alias("label"))
    c = lab.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "relevant").when(F.col("doc_id") % 3 == 1, "irrelevant").otherwise("uncertain").alias("label"))
    return R.vote(a, b, c).select("doc_id", "label", "chosen", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def _cells(where: str) -> str:
    return f"{where} coalesce(sum(w) FILTER (WHERE p AND a), 0) AS tp, coalesce(sum(w) FILTER (WHERE p AND NOT a), 0) AS fp, coalesce(sum(w) FILTER (WHERE NOT p AND a), 0) AS fn, coalesce(sum(w) FILTER (WHERE NOT p AND NOT a), 0) AS tn"


_RATES = "tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity"
_PA = ", pa AS (SELECT family, evidence, band, decision, keep AS p, score >= 5 AS p2, quality = 1 AS a, (doc_id % 4 + 1)::DOUBLE AS w FROM review WHERE quality IS NOT NULL)"


@query("e10_weighted_confusion", tidy_sql(f"SELECT *, {_RATES} FROM (SELECT {_cells('')} FROM pa)", "tp fp fn tn precision recall specificity", ctes=REVIEW + _PA))
def confusion(s, d):
    r = _review(s, d).withColumn("sampling_weight", (F.col("doc_id") % 4 + 1).cast("double"))
    return R.confusion(r, F.col("keep"), F.col("quality") == 1)


@query("e11_cross_tab", tidy_sql("SELECT decision, count(*) FILTER (WHERE quality = 0) AS \"0\", count(*) FILTER (WHERE quality = 1) AS \"1\" FROM review GROUP BY 1", ctes=REVIEW))
def cross(s, d):
    return R.cross_tab(_review(s, d).withColumn("q", F.col("quality").cast("string")), "decision", "q", ["0", "1"])


@query("e12_metrics_by_groups", tidy_sql("SELECT *, " + _RATES + " FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS filter, '{g}' AS grouping_column, CAST({g} AS VARCHAR) AS value, count(*) AS n, {_cells('')} FROM (SELECT * REPLACE ({p} AS p) FROM pa) GROUP BY {g}" for f, p in (("rule", "p"), ("strong", "p2")) for g in ("decision", "evidence", "band")) + ")", "tp fp fn tn precision recall specificity", ctes=REVIEW + _PA))
def by_groups(s, d):
    r = _review(s, d).filter("quality is not null").withColumn("sampling_weight", (F.col("doc_id") % 4 + 1).cast("double"))
    return R.metrics_by_groups(r, {"rule": F.col("keep"), "strong": F.col("score") >= 5}, F.col("quality") == 1, ["decision", "evidence", "band"])


@query("e13_family_policy", tidy_sql("SELECT f.family, coalesce(sample_n, 0) AS sample_n, rate, coalesce(sample_n >= 10 AND rate >= 0.5, false) AS enabled FROM (VALUES ('hack'), ('rules'), ('english'), ('french')) f(family) LEFT JOIN (SELECT family, count(*) AS sample_n, sum(CASE WHEN quality = 1 THEN doc_id % 4 + 1 ELSE 0 END)::DOUBLE / sum(doc_id % 4 + 1) AS rate FROM review WHERE quality IS NOT NULL AND doc_id % 5 <> 0 GROUP BY 1) USING (family)", "rate", ctes=REVIEW))
def policy(s, d):
    r = _review(s, d).filter("quality is not null")
    r = r.withColumns({"label": F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant"), "weight": (F.col("doc_id") % 4 + 1).cast("double")})
    return A.fit_policy(r, r.filter("doc_id % 5 = 0"), LEXICON.context_families)


@query("e16_value_counts", tidy_sql("SELECT 'family' AS \"column\", family AS value, count(*) AS n FROM review GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM review GROUP BY 2", ctes=REVIEW))
def values(s, d):
    return R.value_counts(_review(s, d), ["family", "year"])


@query("e06_label_violations", "SELECT doc_id, 'unknown_label' AS violation FROM labels WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'confidence_range' FROM labels WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'none_with_others' FROM labels WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 17 <> 0")
def violations(s, d):
    lab = T.read(s, d, "labels").select("doc_id")
    i = F.col("doc_id")
    given = lab.select("doc_id", F.when(i % 7 == 0, "maybe").otherwise("relevant").alias("label"), F.when(i % 13 == 0, F.array(F.lit("none"), F.lit("macro"))).otherwise(F.array(F.lit("macro"))).alias("event_types"), F.when(i % 11 == 0, 1.5).otherwise(0.9).alias("confidence"), F.lit("as the title says").alias("reason"))
    return R.label_violations(given, T.read(s, d, "documents").select("doc_id").filter("doc_id % 17 <> 0"))
