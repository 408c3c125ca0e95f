"""Queries over article vectors, daily aggregates and fold-fitted features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import vectors as V
from tidegauge.operators import articles as A
from tidegauge.operators import daily as G
from tidegauge.operators import embed as E
from tidegauge.operators import features as H
from tidegauge.plans import tables as T
from tidegauge.plans.tables import tidy, tidy_sql
from tidegauge.schemas import VECTORS
from tidegauge.sources import keyed as K
from tidegauge.sources.staging import shared_path
from tidegauge.sources.store import KeyedStore

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("a06_vector_lookup", tidy_sql("SELECT label, count(*) FILTER (WHERE vec_id % 3 = 0) AS hits, count(*) FILTER (WHERE vec_id % 3 <> 0) AS misses FROM (SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings) GROUP BY 1"))
def lookup(s, d):
    e = T.read(s, d, "embeddings")
    key = [F.col("vec_id").cast("string").alias("content_hash"), F.lit("m").alias("model"), F.lit("r").alias("representation")]
    store = e.filter("vec_id % 3 = 0").select(*key, F.size("embedding").alias("dimension"), F.col("embedding").alias("vector"))
    out = K.lookup_vectors(e.select(*key, F.col("label").cast("string").alias("label")), store, 64)
    return out.groupBy("label").agg(F.count("vector").alias("hits"), F.count_if(F.col("vector").isNull()).alias("misses"))


@query("a09_store_upsert", "SELECT vec_id AS k, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS v FROM embeddings")
def upsert(s, d):
    e = T.read(s, d, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").cast("long").alias("v"))
    old = e.withColumn("created", F.lit(1))
    new = e.filter("k % 2 = 0").select("k", (F.col("v") + 100).alias("v")).withColumn("created", F.lit(2))
    return K.upsert(old, new, ["k"], "created").select("k", "v")


@query("a09_keyed_store", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 200 WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label, len(embedding) AS dimension, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM embeddings")
def keyed_store(s, d):
    e = T.read(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding", F.lit(0).alias("created"))
    store = KeyedStore(s, shared_path(s, "vector-store"), e.schema, ["vec_id"], "created", 16)
    for step, part in enumerate((e, e.filter("vec_id % 2 = 0"), e.filter("vec_id % 3 = 0"))):
        store.upsert(part.withColumns({"label": F.col("label") + 100 * step, "created": F.lit(step)}))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4)
    return store.read().select("vec_id", "label", F.size("embedding").alias("dimension"), total.alias("total"))


@query("a07_label_cache", "SELECT user_id AS cache_key, arg_max(event_type, event_id) AS label FROM events GROUP BY 1")
def label_cache(s, d):
    e = T.read(s, d, "events").select(F.col("user_id").alias("cache_key"), F.col("event_type").alias("label"), F.col("event_id").alias("line"))
    return K.latest(e, ["cache_key"], "line").select("cache_key", "label")


def _outline(v) -> tuple:
    """What rounding can't change: the signs of the elements as bits, and which is largest."""
    bits = F.aggregate(F.transform(v, lambda x, i: F.when(x > 0, F.pow(F.lit(2), i)).otherwise(0)), F.lit(0.0), lambda a, x: a + x)
    return bits.cast("long").alias("signs"), F.array_position(v, F.array_max(v)).alias("largest"), F.size(v).alias("dimension"), (F.abs(V.norm(v) - 1) < 1e-5).alias("unit")


_OUTLINE = "CAST(list_sum(list_transform(v, lambda x, i: CASE WHEN x > 0 THEN 2 ** (i - 1) ELSE 0 END)) AS BIGINT) AS signs, CAST(list_position(v, list_max(v)) AS BIGINT) AS largest, CAST(len(v) AS BIGINT) AS dimension, true AS unit"


@query("f01_encode_misses", f"SELECT doc_id, text IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 2 = 0) AS hit, {_OUTLINE} FROM (SELECT doc_id, coalesce(text, '') AS text, {T.hashed_sql('text')} AS v FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
def encode(s, d):
    docs = T.read(s, d, "documents").select("doc_id", "text")
    asked = E.requests(docs, "hash", "content", F.coalesce("text", F.lit("")))
    store = KeyedStore(s, shared_path(s, "vectors"), VECTORS, K.VECTOR_KEY, "created", 16)
    _, first = E.embed(asked.filter("doc_id % 2 = 0"), store.read(), E.hash_encoder(8), 8)
    store.upsert(first)
    stored = store.read()
    out, _ = E.embed(asked, stored, E.hash_encoder(8), 8)
    marked = out.join(stored.select(*K.VECTOR_KEY, F.lit(True).alias("hit")), K.VECTOR_KEY, "left")
    return marked.select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"), *_outline(F.col("vector")))


_BUDGETED = f"""head AS (SELECT doc_id, {T.words_sql("text")} AS w, ({T.words_sql("'Title: ' || coalesce(title, '') || ' Content:'")})[1:62] AS h, coalesce(title, '') AS title FROM (SELECT doc_id, text, substr(text, 1, 60) AS title FROM documents))"""


@query("f04_representations", f"""WITH {_BUDGETED}, {T.pieces_sql(64)} SELECT doc_id, representation, md5(t) AS digest FROM (SELECT doc_id, 'title' AS representation, title AS t FROM head
UNION ALL SELECT doc_id, 'title_lead', array_to_string(list_concat(h, w[1:62 - len(h)]), ' ') FROM head UNION ALL SELECT doc_id, 'content', array_to_string(w[1:62], ' ') FROM head
UNION ALL SELECT doc_id, 'chunk', chunk_text FROM pieces)""")
def representations(s, d):
    a = T.articles(s, d)
    three = E.representations(a, 64).select("doc_id", "representation", "text")
    fourth = A.chunked(a, 64).select("doc_id", F.lit("chunk").alias("representation"), F.col("chunk_text").alias("text"))
    return three.union(fourth).select("doc_id", "representation", F.md5("text").alias("digest"))


@query("f03_chunk_mean", f"""WITH {T.pieces_sql(200)}, coded AS (SELECT doc_id, chunk, {T.hashed_sql('chunk_text')} AS v FROM pieces),
elements AS (SELECT doc_id, pos, avg(x) AS x FROM (SELECT doc_id, unnest(range(8)) AS pos, unnest(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))) AS x FROM coded) GROUP BY 1, 2)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_OUTLINE} FROM (SELECT doc_id, list(x ORDER BY pos) AS v FROM elements GROUP BY 1)""")
def chunk_mean(s, d):
    return E.chunk_mean(T.articles(s, d), E.hash_encoder(8), 8, 200).select("doc_id", *_outline(F.col("vector")))


_MEAN = "SELECT day, pos, sum(w * x) / sum(w) AS m FROM e GROUP BY 1, 2"


@query("g01_weighted_centroid", tidy_sql("SELECT day, CAST(pos - 1 AS BIGINT) AS pos, sum(relevance * x) / sum(relevance) AS x FROM elems GROUP BY 1, 2", "x", "day", ctes=T.VECTORS))
def centroid(s, d):
    m = G.weighted_mean(G.article_weights(T.vectors(s, d), []), ["day"], "semantic")
    return m.select("day", F.posexplode("semantic").alias("pos", "x"))


@query("g02_source_balanced", tidy_sql("SELECT day, CAST(pos - 1 AS BIGINT) AS pos, sum(w * x) / sum(w) AS x FROM (SELECT e.*, relevance::DOUBLE / rs / ns AS w FROM elems e JOIN (SELECT day, source, sum(relevance) AS rs FROM vectors GROUP BY 1, 2) USING (day, source) JOIN (SELECT day, count(DISTINCT source) AS ns FROM vectors GROUP BY 1) USING (day)) GROUP BY 1, 2", "x", "day", ctes=T.VECTORS))
def balanced(s, d):
    m = G.weighted_mean(G.article_weights(T.vectors(s, d), [], True), ["day"], "semantic")
    return m.select("day", F.posexplode("semantic").alias("pos", "x"))


_ENT = "-(sentiment[1] * ln(greatest(sentiment[1], 1e-12)) + sentiment[2] * ln(greatest(sentiment[2], 1e-12)) + sentiment[3] * ln(greatest(sentiment[3], 1e-12)))"


@query("g03_daily_sentiment", tidy_sql(f"SELECT day, count(*) AS articles, count(DISTINCT source) AS sources, avg(relevance) AS mean_relevance, count(*) FILTER (WHERE sentiment[1] >= greatest(sentiment[2], sentiment[3]))::DOUBLE / count(*) AS negative_ratio, count(*) FILTER (WHERE sentiment[1] > 0.7) AS strong_negative, max(sentiment[1]) AS max_negative, stddev_pop(sentiment[1]) AS negative_std, max(sentiment[3]) AS max_positive, sum(relevance * {_ENT}) / sum(relevance) AS entropy FROM vectors GROUP BY 1", "mean_relevance negative_ratio max_negative negative_std max_positive entropy", "day", ctes=T.VECTORS))
def sentiment(s, d):
    n = G.daily_news(T.vectors(s, d), [])
    return n.select("day", "articles", "sources", "mean_relevance", "negative_ratio", "strong_negative", "max_negative", "negative_std", "max_positive", "entropy")


@query("g05_dispersion", tidy_sql("SELECT day, sum(relevance * (1 - greatest(-1, least(1, dot / (nx * nm))))) / sum(relevance) AS dispersion FROM (SELECT vec_id, day, any_value(relevance) AS relevance, sum(x * m) AS dot, sqrt(sum(x * x)) AS nx, sqrt(sum(m * m)) AS nm FROM elems JOIN (SELECT day, pos, sum(relevance * x) / sum(relevance) AS m FROM elems GROUP BY 1, 2) USING (day, pos) GROUP BY 1, 2) GROUP BY 1", "dispersion", "day", ctes=T.VECTORS))
def dispersion(s, d):
    return G.daily_news(T.vectors(s, d), []).select("day", "dispersion")


_SPINE = "spine AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-03-10', INTERVAL 1 DAY)) AS DATE) AS day), spined AS (SELECT s.day, coalesce(n, 0) AS n FROM spine s LEFT JOIN (SELECT day, count(*) AS n FROM vectors GROUP BY 1) v ON s.day = v.day)"


@query("g07_news_intensity", tidy_sql("SELECT day, ln(1 + n) - CASE WHEN count(*) OVER w >= 30 THEN quantile_cont(ln(1 + n), 0.5) OVER w ELSE quantile_cont(ln(1 + n), 0.5) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) END AS intensity FROM spined WINDOW w AS (ORDER BY day ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)", "intensity", "day", ctes=f"{T.VECTORS}, {_SPINE}"))
def intensity(s, d):
    daily = T.vectors(s, d).groupBy("day").agg(F.count("*").alias("articles"), F.lit(1).alias("sources"), F.lit(0).alias("strong_negative"))
    x = G.on_spine(daily.withColumn("k", F.lit("all")), ["k"], "2023-12-25", "2024-03-10")
    return G.intensity(x, ["k"], days=40).select("day", "intensity")


@query("g09_no_news_spine", tidy_sql("SELECT day, n AS articles, CAST(n = 0 AS BIGINT) AS no_news FROM spined", days="day", ctes=f"{T.VECTORS}, {_SPINE}"))
def spine(s, d):
    daily = T.vectors(s, d).groupBy("day").agg(F.count("*").alias("articles"))
    return G.on_spine(daily, [], "2023-12-25", "2024-03-10").select("day", "articles", "no_news")


@query("d21_centroid_drift", tidy_sql("SELECT c.period, CASE WHEN p.period IS NOT NULL THEN 1 - greatest(-1, least(1, sum(c.m * p.m) / (sqrt(sum(c.m * c.m)) * sqrt(sum(p.m * p.m))))) END AS drift FROM mm c LEFT JOIN mm p ON p.pos = c.pos AND p.period = (SELECT max(period) FROM mm q WHERE q.period < c.period) GROUP BY c.period, p.period", "drift", "period", ctes=T.VECTORS + ", mm AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, pos, avg(x) AS m FROM elems GROUP BY 1, 2)"))
def drift(s, d):
    x = T.vectors(s, d).withColumn("k", F.lit("all"))
    return G.centroid_drift(x, ["k"]).select("period", "drift")


@query("h07_family_surprise", tidy_sql("SELECT family, day, n AS articles, ln(1 + n) - quantile_cont(ln(1 + n), 0.5) OVER (PARTITION BY family ORDER BY day ROWS UNBOUNDED PRECEDING) AS surprise, ln(1 + sources) AS breadth FROM (SELECT f.family, s.day, coalesce(n, 0) AS n, coalesce(sources, 0) AS sources FROM (SELECT DISTINCT family FROM vectors) f CROSS JOIN spine s LEFT JOIN (SELECT family, day, count(*) AS n, count(DISTINCT source) AS sources FROM vectors GROUP BY 1, 2) v ON v.family = f.family AND v.day = s.day)", "surprise breadth", "day", ctes=f"{T.VECTORS}, {_SPINE}"))
def family(s, d):
    v = T.vectors(s, d)
    days = G.on_spine(v.groupBy("day").agg(F.count("*").alias("articles")), [], "2023-12-25", "2024-03-10").select("day")
    return G.family_surprise(v, days, [], days=400)


_EMA = """ema AS (SELECT series_id, day, log_rv, count(log_rv) OVER w AS k, max(CASE WHEN log_rv IS NOT NULL THEN rn END) OVER w AS at FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS rn FROM days) WINDOW w AS (PARTITION BY series_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
slow AS (SELECT series_id, day, log_rv, CASE WHEN k = 0 THEN 0 ELSE pow(29 / 31.0, k) * sum(CASE WHEN log_rv IS NOT NULL THEN (CASE WHEN k = 1 THEN 1 ELSE 2 / 31.0 END) * log_rv * pow(29 / 31.0, -k) END) OVER (PARTITION BY series_id ORDER BY day ROWS UNBOUNDED PRECEDING) END AS slow FROM ema)"""


@query("h04_slow_fast_state", tidy_sql("SELECT series_id, day, slow, CASE WHEN log_rv IS NULL THEN 0 ELSE log_rv - slow END AS fast FROM slow", "slow fast", "day", ctes=f"{T.long_days_sql()}, {_EMA}"))
def state(s, d):
    x = T.long_days(s, d).withColumn("v", F.when(F.col("log_rv").isNotNull(), F.array("log_rv")))
    return H.slow_state(x.select("series_id", "day", "v"), ["series_id"], "v", rebase=500).select("series_id", "day", F.col("slow")[0].alias("slow"), F.col("fast")[0].alias("fast"))


@query("h06_prototype_scores", tidy_sql("SELECT c.day, p.family, sum(c.u * p.u) AS score FROM cu c JOIN pu p USING (pos) GROUP BY 1, 2", "score", "day", ctes=T.VECTORS + """, un AS (SELECT e.*, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS u FROM elems e),
cm AS (SELECT day, pos, sum(relevance * x) / sum(relevance) AS m FROM elems GROUP BY 1, 2), cu AS (SELECT day, pos, m / sqrt(sum(m * m) OVER (PARTITION BY day)) AS u FROM cm),
pm AS (SELECT family, pos, avg(u) AS m FROM un WHERE day <= DATE '2024-01-31' GROUP BY 1, 2), pu AS (SELECT family, pos, m / sqrt(sum(m * m) OVER (PARTITION BY family)) AS u FROM pm)"""))
def protos(s, d):
    v = T.vectors(s, d)
    days = G.weighted_mean(G.article_weights(v, []), ["day"], "semantic")
    return H.prototype_scores(days, H.prototypes(v.filter("day <= DATE '2024-01-31'")), [])


@query("h09_directional_margin")
def margins(s, d):
    v = T.vectors(s, d)
    return H.directional_margins(v, v.filter("day <= DATE '2024-01-31'"), [])


@query("h02_captured_ratio")
def captured(s, d):
    days = G.weighted_mean(G.article_weights(T.vectors(s, d), []), ["day"], "semantic")
    z, _ = H.project(days, days.filter("day <= DATE '2024-02-10'"), 8)
    return H.captured_ratio(z.withColumn("block", F.when(F.col("day") <= F.lit("2024-02-10").cast("date"), "core").otherwise("test")), ["block"])


@query("h03_scaled_scalars", tidy_sql("SELECT day, CASE WHEN n = 0 THEN 0 ELSE (n - m) / greatest(s, 1e-8) END AS articles FROM spined CROSS JOIN (SELECT avg(n) AS m, stddev_pop(n) AS s FROM spined WHERE day <= DATE '2024-01-31')", "articles", "day", ctes=f"{T.VECTORS}, {_SPINE}"))
def scalars(s, d):
    x = G.on_spine(T.vectors(s, d).groupBy("day").agg(F.count("*").alias("articles")), [], "2023-12-25", "2024-03-10")
    x = x.withColumns({"k": F.lit(1), "articles": F.col("articles").cast("double")})
    return H.scaled_scalars(x, ["articles"], x.filter("day <= DATE '2024-01-31'"), ["k"]).select("day", "articles")


@query("h12_news_share", tidy_sql("SELECT day, avg(CASE WHEN n = 0 THEN 0 ELSE 1 END) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS news_share FROM spined", "news_share", "day", ctes=f"{T.VECTORS}, {_SPINE}"))
def share(s, d):
    x = G.on_spine(T.vectors(s, d).groupBy("day").agg(F.count("*").alias("articles")).withColumn("k", F.lit(1)), ["k"], "2023-12-25", "2024-03-10")
    return H.news_share(x, ["k"]).select("day", "news_share")
