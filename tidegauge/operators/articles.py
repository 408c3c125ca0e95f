"""Articles: filtered loads with counters, duplicates, audits and day summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions import text as X
from tidegauge.functions.lexicon import DEFAULT, Lexicon
from tidegauge.sources.staging import staged


def _once(rows: DataFrame, made: Column) -> DataFrame:
    """rows with the fields of the struct `made`, in place of columns of their names.

    They are made by a generator of one row: the optimiser moves filters on its
    output no further down, and writes its rules out no second time. Of plain columns, a
    filter on `keep` repeats every regular expression for each of its uses.
    """
    each = rows.select("*", F.explode(F.array(made)).alias("_made"))
    fields = each.schema["_made"].dataType.names
    return each.select(*(c for c in rows.columns if c not in fields), *(F.col(f"_made.{c}").alias(c) for c in fields))


def scored(articles: DataFrame, lexicon: Lexicon = DEFAULT, entities: bool = True) -> DataFrame:
    """Articles with body cleaned, and keep, score, evidence, band, family and day."""
    cleaned = _once(articles, F.struct(X.clean("body", lexicon, entities).alias("body")))
    r = _once(cleaned, F.struct(X.mentions("title", "body", lexicon).alias("_m"), X.family("title", F.substring("body", 1, X.LEAD), lexicon).alias("family")))
    r = r.withColumn("_r", X.relevance_of(F.col("_m")))
    return r.select(*articles.columns, F.col("_r.keep").alias("keep"), F.col("_r.score").alias("score"), X.evidence_of(F.col("_m")).alias("evidence"), X.score_band("_r.score").alias("band"), "family", F.to_date("ts").alias("day"))


def filtered(articles: DataFrame, start, end, lexicon: Lexicon = DEFAULT, entities: bool = True) -> DataFrame:
    """The articles of the days start .. end that the rule keeps."""
    inside = articles.filter(F.col("ts").isNotNull() & F.to_date("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return scored(inside, lexicon, entities).filter("keep")


def load_counters(articles: DataFrame, start, end, lexicon: Lexicon = DEFAULT, entities: bool = True) -> DataFrame:
    """One row: scanned, invalid_timestamp, outside_range, irrelevant, retained."""
    day = F.to_date("ts")
    inside = F.coalesce(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    cleaned = _once(articles, F.struct(X.clean("body", lexicon, entities).alias("body")))
    found = _once(cleaned, F.struct(X.mentions("title", "body", lexicon).alias("_m")))
    return found.select(F.col("ts").isNull().alias("bad"), inside.alias("inside"), X.relevance_of(F.col("_m"))["keep"].alias("keep")).agg(
        F.count("*").alias("scanned"),
        F.count_if("bad").alias("invalid_timestamp"),
        F.count_if(~F.col("bad") & ~F.col("inside")).alias("outside_range"),
        F.count_if(F.col("inside") & ~F.col("keep")).alias("irrelevant"),
        F.count_if(F.col("inside") & F.col("keep")).alias("retained"),
    )


def fit_policy(review: DataFrame, holdout: DataFrame, families: tuple[str, ...] = DEFAULT.context_families, rate: float = 0.5, least: int = 10) -> DataFrame:
    """(family, sample_n, rate, enabled) from weak labels (doc_id, family, label, weight) outside the holdout."""
    train = review.join(holdout.select("doc_id"), "doc_id", "left_anti").filter(F.col("label").isin("relevant", "irrelevant"))
    w = F.coalesce(F.expr("try_cast(weight AS double)"), F.lit(1.0))
    each = train.groupBy("family").agg(F.count("*").alias("sample_n"), F.try_divide(F.sum(F.when(F.col("label") == "relevant", w).otherwise(0.0)), F.sum(w)).alias("rate"))
    every = review.sparkSession.createDataFrame([(f,) for f in families], "family string")
    out = every.join(each, "family", "left").fillna(0, ["sample_n"])
    return out.withColumn("enabled", F.coalesce((F.col("sample_n") >= least) & (F.col("rate") >= rate), F.lit(False)))


def enabled_families(policy: DataFrame) -> list[str]:
    """The enabled families, at most as many as the lexicon has."""
    return sorted(r["family"] for r in policy.filter("enabled").select("family").collect())


def decided(articles: DataFrame, enabled: list[str], lexicon: Lexicon = DEFAULT, refined: bool = False, decide=None) -> DataFrame:
    """Articles with keep, score, reason and recap; decide(title, lead, enabled) may replace the rule."""
    families = F.array(*(F.lit(x) for x in enabled)) if enabled else F.array().cast("array<string>")
    rule = decide or (lambda t, b, e: X.event_decision(t, b, e, lexicon, refined))
    out = articles.drop("keep", "score", "reason", "recap", "relevance").select("*", F.explode(F.array(rule(F.col("title"), F.col("body"), families))).alias("_d"))
    return out.select("*", *(F.col(f"_d.{c}").alias(c) for c in ("keep", "score", "reason", "recap"))).drop("_d").withColumn("relevance", F.when(F.col("keep"), F.greatest("score", F.lit(1))).otherwise(F.col("score")))


def reason_counts(decided_: DataFrame) -> DataFrame:
    return decided_.groupBy("reason").agg(F.count("*").alias("n"))


def _keyed(articles: DataFrame) -> DataFrame:
    """articles with their day and normalised title and content; empty ones are null and match nothing."""
    known = lambda c: F.nullif(c, F.lit(""))
    keys = _once(articles, F.struct(X.duplicate_key("title").alias("_title"), X.duplicate_key("body").alias("_content")))
    content = F.when(known("_content").isNotNull(), X.content_key(known("_content").alias("body")))
    return keys.withColumns({"_day": F.to_date("ts"), "_title": known("_title"), "_content": content})


def first_seen(articles: DataFrame, order: str = "scan_pos") -> DataFrame:
    """Articles with removed_by (null: kept): title, content or null, by exact first-seen rules.

    An article goes if an earlier kept one has its timestamp and title key, or
    else its day and content key. Titles and contents without a letter or digit
    match nothing. A removed article registers no keys, so articles that share a
    key are walked in order, days in parallel; all others are kept at once.
    """
    keyed = staged(_keyed(articles).select(order, "ts", "_day", "_title", "_content"), "first-seen-keys")
    many = lambda *k: F.count("*").over(Window.partitionBy(*k)) > 1
    titled = keyed.filter("_title is not null").withColumn("_m", many("ts", "_title")).filter("_m").select(order)
    filled = keyed.filter("_content is not null").withColumn("_m", many("_day", "_content")).filter("_m").select(order)
    shared = keyed.join(titled.union(filled).distinct(), order, "left_semi")
    # keys travel as digests; a title's holds for its time only
    digest = lambda c: F.unhex(F.sha2(c, 256))
    short = shared.select("_day", order, digest(F.concat_ws("|", F.unix_micros("ts").cast("string"), F.lit(""), "_title")).alias("t"), F.col("_title").isNotNull().alias("titled"), F.unhex("_content").alias("c"))
    kind = short.schema[order].dataType

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, titles, contents = None, set(), set()
        for b in batches:
            causes = []
            for d, t, titled_, c in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if d != day:
                    day, titles, contents = d, set(), set()
                cause = "title" if titled_ and t in titles else "content" if c is not None and c in contents else None
                causes.append(cause)
                if cause is None:
                    if titled_:
                        titles.add(t)
                    if c is not None:
                        contents.add(c)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(causes, pa.string())], [order, "removed_by"])

    # a task streams through its days in order and holds the kept keys of one day
    causes = short.repartition("_day").sortWithinPartitions("_day", order).mapInArrow(walk, T.StructType([T.StructField(order, kind), T.StructField("removed_by", T.StringType())]))
    return articles.join(causes, order, "left")


def strict_duplicates(articles: DataFrame, order: str = "scan_pos") -> DataFrame:
    """As first_seen, but a removed article's keys count too: stricter, and SQL windows alone."""
    n = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy(order))
    out = _keyed(articles).withColumns({"_a": n("ts", "_title"), "_b": n("_day", "_content")})
    title, content = F.col("_title").isNotNull() & (F.col("_a") > 1), F.col("_content").isNotNull() & (F.col("_b") > 1)
    return out.withColumn("removed_by", F.when(title, "title").when(content, "content")).drop("_day", "_title", "_content", "_a", "_b")


def length_audit(articles: DataFrame, by: list[str], tokens=X.words, limit: int = 512) -> DataFrame:
    """p50, p90, p99 of the words of the body and the share above the limit."""
    n = articles.withColumn("_n", F.size(tokens("body")))
    return n.groupBy(*by).agg(F.percentile("_n", F.lit(0.5)).alias("p50"), F.percentile("_n", F.lit(0.9)).alias("p90"), F.percentile("_n", F.lit(0.99)).alias("p99"), (F.count_if(F.col("_n") > limit) / F.count("*")).alias("over"))


def named_source(c: str = "source") -> Column:
    return F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", "__unknown_source__").otherwise(F.col(c))


def source_concentration(articles: DataFrame) -> DataFrame:
    """Per year: articles, distinct sources, the largest and its share, and the Herfindahl index."""
    each = articles.groupBy(F.year("ts").alias("year"), named_source().alias("source")).agg(F.count("*").alias("n"))
    out = each.groupBy("year").agg(F.sum("n").alias("articles"), F.count("*").alias("sources"), F.min_by("source", F.struct(-F.col("n"), "source")).alias("largest"), F.max("n").alias("_m"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    return out.select("year", "articles", "sources", "largest", (F.col("_m") / F.col("articles")).alias("largest_share"), (F.col("_q") / (F.col("articles") * F.col("articles"))).alias("hhi"))


def source_shares(articles: DataFrame, unit: str = "month") -> DataFrame:
    """Articles of each source in each period, its share, and the period's number of sources."""
    each = articles.groupBy(F.trunc(F.to_date("ts"), unit).alias("period"), named_source().alias("source")).agg(F.count("*").alias("n"))
    whole = each.groupBy("period").agg(F.sum("n").alias("_all"), F.count("*").alias("sources"))
    return each.join(whole, "period").select("period", "source", "n", (F.col("n") / F.col("_all")).alias("share"), "sources")


def count_rollup(daily: DataFrame, unit: str = "month", n: str = "articles") -> DataFrame:
    """Median, mean, p90, maximum, rate of empty days and sum of daily counts, per period."""
    return daily.groupBy(F.trunc("day", unit).alias("period")).agg(F.percentile(n, F.lit(0.5)).alias("median"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.9)).alias("p90"), F.max(n).alias("maximum"), (F.count_if(F.col(n) == 0) / F.count("*")).alias("empty_rate"), F.sum(n).alias("total"))


def first_examples(decided_: DataFrame, k: int = 100, by: str = "keep", order: str = "scan_pos") -> DataFrame:
    """The first k rows of each decision in scan order."""
    return decided_.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= k).drop("_n")


def date_only(articles: DataFrame, raw: str = "raw_ts") -> DataFrame:
    """Articles whose timestamp is a bare date: midnight, and written in ten characters at most."""
    midnight = F.date_format("ts", "HH:mm:ss.SSS") == "00:00:00.000"
    return articles.filter(midnight & (F.length(F.trim(raw)) <= 10))


def order_audit(articles: DataFrame, order: str = "scan_pos", by: list[str] | None = None) -> DataFrame:
    """Rows that are earlier than the row scanned before them, and whether there is none.

    `by` names what was scanned together (a file, a source); without it the scan
    is one sequence, audited in parts that overlap by a row.
    """
    if by:
        late = articles.withColumn("_p", F.lag("ts").over(Window.partitionBy(*by).orderBy(order)))
        return late.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col("ts") < F.col("_p")).alias("out_of_order"), F.bool_and(F.coalesce(F.col("ts") >= F.col("_p"), F.lit(True))).alias("ordered"))
    before = articles.select((F.col(order) + 1).alias(order), F.col("ts").alias("_p"))
    late = articles.select(order, "ts").join(before, order, "left")
    return late.agg(F.count("*").alias("rows"), F.count_if(F.col("ts") < F.col("_p")).alias("out_of_order"), F.bool_and(F.coalesce(F.col("ts") >= F.col("_p"), F.lit(True))).alias("ordered"))


def day_summary(articles: DataFrame, titles: int = 5) -> DataFrame:
    """Per day: articles, sources, first and last time, articles of each family, the first titles."""
    fams = articles.groupBy("day", "family").agg(F.count("*").alias("n")).groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "n")))).alias("families"))
    ranked = articles.withColumn("_n", F.row_number().over(Window.partitionBy("day").orderBy("ts", "title"))).filter(F.col("_n") <= titles)
    first = ranked.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda x: x["title"]).alias("titles"))
    base = articles.groupBy("day").agg(F.count("*").alias("articles"), F.count_distinct(named_source()).alias("sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return base.join(fams, "day").join(first, "day")


def chunked(articles: DataFrame, budget: int) -> DataFrame:
    """One row for each piece of an article's body: doc_id, chunk, chunk_text."""
    return articles.select("doc_id", F.posexplode(X.chunks("body", budget)).alias("chunk", "chunk_text"))


def chunk_hook(generate: Callable[[str], Iterable[tuple]], schema: str) -> Callable[..., DataFrame]:
    """A table function of a user's generator: for a text (null: empty) it yields rows of schema, in Arrow batches."""

    class Chunks:
        def eval(self, text: str):
            yield from generate(text or "")

    return F.udtf(Chunks, returnType=schema, useArrow=True)


def generated(articles: DataFrame, generate: Callable[[str], Iterable[tuple]], schema: str, text: str = "body") -> DataFrame:
    """articles with the rows that generate makes of each text; an article it makes none of has none.

    A generator holds one text at a time; what it yields is streamed.
    """
    return articles.lateralJoin(chunk_hook(generate, schema)(F.col(text).outer()))


def quality_report(articles: DataFrame, start, end, lexicon: Lexicon = DEFAULT, entities: bool = True) -> DataFrame:
    """One row: load counters, duplicates removed, largest source's share and length quantiles of what is kept."""
    kept = filtered(articles, start, end, lexicon, entities)
    dup = strict_duplicates(kept).agg(F.count_if(F.col("removed_by").isNotNull()).alias("duplicates"))
    top = source_concentration(kept).agg(F.max("largest_share").alias("largest_source_share"))
    length = kept.select(F.size(X.words("body")).alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("p50_words"), F.percentile("n", F.lit(0.99)).alias("p99_words"))
    one = load_counters(articles, start, end, lexicon, entities)
    for part in (dup, top, length):  # single rows each
        one = one.crossJoin(part)
    return one
