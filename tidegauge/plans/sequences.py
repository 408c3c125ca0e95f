"""Queries over the training tables of sequence models and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import vectors as V
from tidegauge.operators import calendar as C
from tidegauge.operators import daily as G
from tidegauge.operators import tokens as K
from tidegauge.plans import tables as T
from tidegauge.plans.tables import tidy, tidy_sql
from tidegauge.sources.staging import staged

QUERIES, SQL = {}, {}
SPAN = ("2023-12-25", "2024-03-10")
YEARS = ("1995-01-01", "2001-08-01")
FOLDS = (("early", "2023-12-25", "2024-02-10"), ("late", "2024-01-05", "2024-02-25"))
CORES = tuple((f[0], f[1], f[2]) for f in T.FOLDS)
LAYOUT = K.Layout(others=("surprise",))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return keep


def _folds(folds) -> Column:
    return F.array(*(F.struct(F.lit(f).alias("fold"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("end")) for f, a, b in folds))


def _days(articles: DataFrame, span, folds) -> DataFrame:
    """Days of every fold with states, scaled scalars and the length of what the semantic vector has of new."""
    spined = staged(G.on_spine(G.daily_news(articles, []), [], *span), "news-spine")
    with_norms = K.states(spined, [], K.Layout()).withColumns({"surprise": V.norm("semantic_fast"), "mood_surprise": V.norm("sentiment_fast")})
    return staged(K.news_scalars(with_norms, _folds(folds)), "news-days")


def _long(rows: DataFrame, kind: str, column: str, names: list[str]) -> DataFrame:
    """(fold, kind, day, name, value), a row for each element."""
    named = F.posexplode(column).alias("_p", "value")
    x = rows.select("fold", F.lit(kind).alias("kind"), "day", named)
    return x.select("fold", "kind", "day", F.element_at(F.array(*map(F.lit, names)), F.col("_p") + 1).alias("name"), "value")


_RAW = "intensity log_sources negative_ratio log_negative max_negative negative_std max_positive entropy dispersion mean_relevance".split()


def _news_sql(vectors: str, span, folds) -> str:
    """CTEs: states (day, v, pos, slow, fast), norms by day and scaled scalars (fold, day, core, no_news, scalars)."""
    entropy = "-(" + " + ".join(f"greatest(sentiment[{i}], 1e-12) * ln(greatest(sentiment[{i}], 1e-12))" for i in (1, 2, 3)) + ")"
    filled = ", ".join(f"coalesce({c}, median({c}) FILTER (WHERE core) OVER (PARTITION BY fold)) AS {c}" for c in _RAW)
    one = lambda c: f"({c} - avg({c}) FILTER (WHERE core) OVER (PARTITION BY fold)) / greatest(stddev_pop({c}) FILTER (WHERE core) OVER (PARTITION BY fold), 1e-8)"
    scaled = ", ".join(f"CASE WHEN no_news = 1 THEN 0 ELSE {one(c)} END AS {c}" if c in K.UNDEFINED else f"{one(c)} AS {c}" for c in _RAW)
    cores = ", ".join(f"('{f}', DATE '{a}', DATE '{b}')" for f, a, b in folds)
    return f"""{vectors},
parts AS (SELECT vec_id, day, 'semantic' AS v, pos, relevance, x FROM elems UNION ALL SELECT vec_id, day, 'sentiment', generate_subscripts(sentiment, 1), relevance, unnest(sentiment) FROM vectors),
means AS (SELECT day, v, pos, sum(relevance * x) / sum(relevance) AS m FROM parts GROUP BY ALL),
spine AS (SELECT CAST(unnest(generate_series(DATE '{span[0]}', DATE '{span[1]}', INTERVAL 1 DAY)) AS DATE) AS day),
grid AS (SELECT s.day, p.v, p.pos, m.m FROM spine s CROSS JOIN (SELECT DISTINCT v, pos FROM means) p LEFT JOIN means m ON m.day = s.day AND m.v = p.v AND m.pos = p.pos),
counted AS (SELECT *, count(m) OVER (PARTITION BY v, pos ORDER BY day) AS k FROM grid),
slow AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE pow(29 / 31.0, k) * sum(CASE WHEN m IS NOT NULL THEN (CASE WHEN k = 1 THEN 1 ELSE 2 / 31.0 END) * m * pow(29 / 31.0, -k) END) OVER (PARTITION BY v, pos ORDER BY day) END AS slow FROM counted),
states AS (SELECT day, v, pos, slow, CASE WHEN m IS NULL THEN 0 ELSE m - slow END AS fast FROM slow),
norms AS (SELECT day, sqrt(sum(fast * fast) FILTER (WHERE v = 'semantic')) AS surprise, sqrt(sum(fast * fast) FILTER (WHERE v = 'sentiment')) AS mood_surprise FROM states GROUP BY 1),
apart AS (SELECT day, sum(relevance * (1 - greatest(-1, least(1, dot / (nx * nm))))) / sum(relevance) AS dispersion FROM (SELECT vec_id, e.day, any_value(relevance) AS relevance, sum(x * m) AS dot, sqrt(sum(x * x)) AS nx, sqrt(sum(m * m)) AS nm FROM parts e JOIN means m ON m.day = e.day AND m.v = e.v AND m.pos = e.pos WHERE e.v = 'semantic' GROUP BY 1, 2) GROUP BY 1),
mood AS (SELECT day, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (WHERE sentiment[1] >= greatest(sentiment[2], sentiment[3]))::DOUBLE / count(*) AS negative_ratio, count(*) FILTER (WHERE sentiment[1] > 0.7) AS strong, max(sentiment[1]) AS max_negative, stddev_pop(sentiment[1]) AS negative_std, max(sentiment[3]) AS max_positive, sum(relevance * {entropy}) / sum(relevance) AS entropy, avg(relevance) AS mean_relevance FROM vectors GROUP BY 1),
raw AS (SELECT s.day, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS no_news, ln(1 + coalesce(n, 0)) - quantile_cont(ln(1 + coalesce(n, 0)), 0.5) OVER (ORDER BY s.day ROWS BETWEEN 364 PRECEDING AND CURRENT ROW) AS intensity, ln(1 + coalesce(sources, 0)) AS log_sources, negative_ratio, ln(1 + coalesce(strong, 0)) AS log_negative, max_negative, negative_std, max_positive, entropy, dispersion, mean_relevance FROM spine s LEFT JOIN mood ON mood.day = s.day LEFT JOIN apart ON apart.day = s.day),
cores AS (SELECT * FROM (VALUES {cores}) AS t(fold, first, last)),
infold AS (SELECT fold, day BETWEEN first AND last AS core, raw.* FROM raw CROSS JOIN cores),
whole AS (SELECT fold, core, day, no_news, {filled} FROM infold),
scalars AS (SELECT fold, core, day, no_news, {scaled} FROM whole),
listed AS (SELECT fold, core, day, no_news, name, value FROM (SELECT *, no_news::DOUBLE AS mark FROM scalars) UNPIVOT (value FOR name IN ({', '.join(_RAW)}, mark))),
shared AS (SELECT fold, core, day, no_news, CASE WHEN name = 'mark' THEN 'no_news' ELSE name END AS name, value FROM listed),
extra AS (SELECT fold, core, day, no_news, 'surprise' AS name, surprise AS value FROM scalars JOIN norms USING (day))"""


def _led(kind: str, value: str, label: str | None = None) -> str:
    return f"SELECT '{kind}' AS kind, fold, core, day, no_news, v || '_{label or kind}_' || lpad(CAST(pos AS VARCHAR), 2, '0') AS name, {value} AS value FROM states JOIN scalars USING (day)"


def _rest(kind: str, table: str) -> str:
    return f"SELECT '{kind}', fold, core, day, no_news, name, value FROM {table}"


_SCALE = "(value - avg(value) FILTER (WHERE {fit}) OVER w) / CASE WHEN coalesce(stddev_pop(value) FILTER (WHERE {fit}) OVER w, 0) > 1e-12 THEN stddev_pop(value) FILTER (WHERE {fit}) OVER w ELSE 1 END"
_TOKENS = ", tokens AS (" + " UNION ALL ".join([_led("slow", "slow"), _led("fast", "fast"), *(_rest(k, t) for k in K.STATES for t in ("shared", "extra"))]) + ")"
_CHANGE = "slow - coalesce(lag(slow) OVER (PARTITION BY fold, v, pos ORDER BY day), slow)"
_UPDATES = ", tokens AS (" + " UNION ALL ".join([_led("update", _CHANGE, "change"), _led("level", "slow", "slow"), _rest("update", "shared"), _rest("update", "extra"), _rest("level", "shared")]) + ")"


@query("h19_token_matrix", tidy_sql(f"SELECT fold, kind, day, name, {_SCALE.format(fit='core')} AS value FROM tokens WINDOW w AS (PARTITION BY fold, kind, name)", "value", "day", ctes=_news_sql(T.VECTORS, SPAN, FOLDS) + _TOKENS))
def token_matrix(s, d):
    days = _days(T.vectors(s, d), SPAN, FOLDS)
    tables = [(state, *K.token_matrix(days, ["fold"], state, LAYOUT)) for state in K.STATES]
    long = [_long(table, state, "token", names) for state, table, names in tables]
    return long[0].union(long[1]).union(long[2])


@query("h11_update_tokens", tidy_sql(f"SELECT fold, kind, day, name, CASE WHEN kind = 'level' THEN {_SCALE.format(fit='core')} WHEN no_news = 1 THEN 0 ELSE {_SCALE.format(fit='core AND no_news = 0')} END AS value FROM tokens WINDOW w AS (PARTITION BY fold, kind, name)", "value", "day", ctes=_news_sql(T.VECTORS, SPAN, FOLDS) + _UPDATES))
def update_tokens(s, d):
    table, names, levels = K.update_matrix(_days(T.vectors(s, d), SPAN, FOLDS), ["fold"], LAYOUT)
    return _long(table, "update", "update", names).union(_long(table, "level", "level", levels))


_SPREAD = ("DATE '2024-01-01' + CAST(vec_id * 7 % 60 AS INTEGER)", "DATE '1995-01-01' + CAST(vec_id * 7919 % 2400 AS INTEGER)")
_MARKET = f"{T.long_days_sql(False)}, {T.HAR}, market AS (SELECT * FROM (SELECT day, log_rv, lag_1, mean_5, mean_22, lag_1 - mean_5 AS last_minus_5, mean_5 - mean_22 AS five_minus_22, lag(log_rv) OVER w - lag(log_rv, 2) OVER w AS change_1, stddev_pop(log_rv) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS std_5 FROM har WINDOW w AS (PARTITION BY series_id ORDER BY day)) WHERE lag_1 IS NOT NULL AND log_rv IS NOT NULL)"
_GATE = f"{_MARKET}, {_news_sql(T.VECTORS.replace(*_SPREAD), YEARS, CORES)}"
_WIDE = ", ".join([*K.MARKET, *(f"s.{c} AS news_{c}" for c in _RAW), "s.no_news::DOUBLE AS news_no_news", "n.surprise AS news_surprise", "n.mood_surprise AS news_mood_surprise"])
_GATE_NAMES = [*K.MARKET, *(f"news_{c}" for c in (*K.SCALARS, "surprise", "mood_surprise"))]


@query("h14_gate_matrix", tidy_sql(f"SELECT fold, m.day, s.day AS news_day, {_WIDE} FROM market m JOIN scalars s ON s.day = m.day - 1 JOIN norms n ON n.day = s.day", " ".join(_GATE_NAMES), "day news_day", ctes=_GATE))
def gate_matrix(s, d):
    day = F.date_add(F.lit(YEARS[0]).cast("date"), (F.col("vec_id") * 7919 % 2400).cast("int"))
    news = _days(T.vectors(s, d).withColumn("day", day), YEARS, CORES)
    targets = C.market_state(T.long_days(s, d, False)).filter("valid and lag_1 is not null").withColumn("fold", F.explode(F.array(*(F.lit(f[0]) for f in CORES))))
    rows, names = K.gate_matrix(targets, news, ["fold"], ("surprise", "mood_surprise"))
    return rows.select("fold", "day", "news_day", *(F.col("gate")[i].alias(n) for i, n in enumerate(names)))
