"""Stratified review samples, weak labels, agreement and weighted confusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.schemas import EVENT_TYPES, RELEVANCE

STRATA = ["decision", "year", "evidence", "band"]


def hash_rank(*columns) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]), 256)


def stratified_sample(rows: DataFrame, k: int, strata: list[str] = STRATA, key: str = "doc_id") -> DataFrame:
    """The k rows of each stratum with the smallest SHA-256 of their key."""
    w = Window.partitionBy(*strata).orderBy(hash_rank(key), key)
    return rows.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= k)


def population(rows: DataFrame, strata: list[str] = STRATA) -> DataFrame:
    return rows.groupBy(*strata).agg(F.count("*").alias("population_n"))


def choose_quotas(counts: DataFrame, target: int, least: int = 4, most: int = 100) -> DataFrame:
    """One row (retained_quota, removed_quota, total): the grid cell nearest to the target.

    Ties by the balance of the two decisions, then the smaller quotas, then the
    first cell of the grid. Each decision's totals are summed once per quota, for
    both decisions in one pass over counts, and the grid is made of those few totals.
    """
    q = counts.sparkSession.range(least, most + 1).withColumnRenamed("id", "q")
    mine = counts.groupBy("decision", "population_n").agg(F.count("*").alias("m"))
    each = mine.crossJoin(F.broadcast(q))  # a row for each quota of the grid
    taken = lambda d: F.sum(F.when(F.col("decision") == d, F.col("m") * F.least("population_n", "q")))
    totals = q.join(each.groupBy("q").agg(taken("retained").alias("_a"), taken("removed").alias("_b")), "q", "left").fillna(0, ["_a", "_b"])
    line = totals.agg(F.collect_list(F.struct("q", "_a", "_b")).alias("_l"))  # most - least + 1 entries
    grid = line.select("_l", F.explode("_l").alias("_x")).select("_x", F.explode("_l").alias("_y"))
    grid = grid.select(F.col("_x.q").alias("retained_quota"), F.col("_x._a").alias("_a"), F.col("_y.q").alias("removed_quota"), F.col("_y._b").alias("_b"))
    total = F.col("_a") + F.col("_b")
    order = [F.abs(total - target), F.abs(F.col("_a") - F.col("_b")), F.col("retained_quota") + F.col("removed_quota"), F.col("retained_quota"), F.col("removed_quota")]
    return grid.orderBy(*order).limit(1).select("retained_quota", "removed_quota", total.alias("total"))


def quota_sample(rows: DataFrame, quotas: DataFrame, strata: list[str] = STRATA, key: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """The quota's rows of each stratum, with the sampling weight population / sample.

    counts: the population of rows, if it is known. The two quotas are fetched, so
    that each partition keeps only as many rows of a stratum as the larger one.
    """
    w = Window.partitionBy(*strata).orderBy(hash_rank(key), key)
    found = quotas.first()
    a, b = (found["retained_quota"], found["removed_quota"]) if found else (0, 0)
    picked = rows.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= max(a, b)).filter(F.col("sample_rank") <= F.when(F.col("decision") == "retained", a).otherwise(b))
    return sampling_weights(picked, population(rows, strata) if counts is None else counts, strata)


def sampling_weights(sample: DataFrame, counts: DataFrame, strata: list[str] = STRATA) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*strata))
    return sample.withColumn("sample_n", n).join(counts, strata).withColumn("sampling_weight", F.col("population_n") / F.col("sample_n"))


def carry_over(sample: DataFrame, old: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """sample with an origin flag and, where the old review has them, its values that aren't blank."""
    was = old.select(key, F.lit(True).alias("_was"), *(F.col(f).alias(f"_{f}") for f in fields))
    out = sample.join(was, key, "left").withColumn("origin", F.when(F.col("_was"), "original").otherwise("expanded"))
    for f in fields:
        now = F.col(f) if f in sample.columns else F.lit("")
        out = out.withColumn(f, F.coalesce(F.nullif(F.trim(f"_{f}"), F.lit("")), now))
    return out.drop("_was", *(f"_{f}" for f in fields))


def label_violations(labels: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, violation): ids missing, unexpected or repeated; unknown values; 'none' with others; ranges."""
    per = labels.groupBy(key).agg(F.count("*").alias("_n"))
    ids = per.join(expected.select(key).distinct().withColumn("_e", F.lit(True)), key, "full_outer")
    by_id = ids.select(key, F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "repeated").alias("violation"))
    types = F.array(*(F.lit(x) for x in EVENT_TYPES))
    e = F.coalesce("event_types", F.array().cast("array<string>"))
    checks = {
        "unknown_label": ~F.coalesce(F.col("label").isin(*RELEVANCE), F.lit(False)),
        "unknown_event": F.size(F.array_except(e, types)) > 0,
        "no_event": F.size(e) == 0,
        "none_with_others": F.array_contains(e, "none") & (F.size(e) > 1),
        "confidence_range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "reason_length": ~F.coalesce(F.length("reason").between(1, 240), F.lit(False)),
    }
    found = labels.select(key, F.explode(F.array_compact(F.array(*(F.when(test, name) for name, test in checks.items())))).alias("violation"))
    return by_id.filter("violation is not null").union(found)


def vote(first: DataFrame, second: DataFrame, third: DataFrame, key: str = "doc_id") -> DataFrame:
    """Two passes, and a third where they disagree: the label of two votes at least, else uncertain.

    chosen says which pass carries the winning label.
    """
    p = lambda df, n: df.select(key, F.col("label").alias(f"pass_{n}"))
    out = p(first, 1).join(p(second, 2), key).join(p(third, 3), key, "left")
    a, b, c = F.col("pass_1"), F.col("pass_2"), F.col("pass_3")
    out = out.withColumn("agreed", a == b).withColumn("label", F.when(a == b, a).when(a == c, a).when(b == c, b).otherwise("uncertain"))
    out = out.withColumn("resolved", F.coalesce(F.col("agreed"), F.lit(False)) | F.coalesce(a == c, F.lit(False)) | F.coalesce(b == c, F.lit(False)))
    return out.withColumn("chosen", F.when(F.col("resolved"), F.when(a == F.col("label"), 1).when(b == F.col("label"), 2)))


def agreement(pairs: DataFrame, a: str = "pass_1", b: str = "pass_2") -> DataFrame:
    """One row: n, agreement and Cohen's kappa (null where chance agreement is 1)."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("x"))
    cols = cells.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, "v").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("total"), F.coalesce("xy", F.lit(0)) / (F.col("total") * F.col("total"))
    return total.crossJoin(chance).select(F.col("total").alias("n"), po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def confusion(rows: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None, weight: str = "sampling_weight") -> DataFrame:
    """Weighted cells, precision, recall and specificity (null on a zero denominator)."""
    w = lambda test: F.coalesce(F.sum(F.when(test, F.col(weight))), F.lit(0.0))
    x = rows.withColumns({"_p": predicted, "_a": actual}).filter("_p is not null and _a is not null")
    p, a = F.col("_p"), F.col("_a")
    cells = x.groupBy(*(by or [])).agg(w(p & a).alias("tp"), w(p & ~a).alias("fp"), w(~p & a).alias("fn"), w(~p & ~a).alias("tn"))
    return cells.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "specificity": F.try_divide("tn", F.col("tn") + F.col("fp"))})


def cross_tab(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(by).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def metrics_by_groups(rows: DataFrame, filters: dict[str, Column], actual: Column, groups: list[str], weight: str = "sampling_weight") -> DataFrame:
    """Confusion of each filter for every value of each grouping column: one pass with grouping sets."""
    names = list(filters)
    wide = rows.select(*groups, weight, actual.alias("_a"), *(filters[n].alias(f"_f_{i}") for i, n in enumerate(names)))
    pairs = ", ".join(f"'{n}', _f_{i}" for i, n in enumerate(names))
    long = wide.select(*groups, weight, "_a", F.expr(f"stack({len(names)}, {pairs}) AS (filter, _p)"))
    sets = ", ".join(f"(filter, {g})" for g in groups)
    case = " ".join(f"WHEN grouping({g}) = 0 THEN '{g}'" for g in groups)
    value = " ".join(f"WHEN grouping({g}) = 0 THEN CAST({g} AS string)" for g in groups)
    cell = lambda p, a: f"coalesce(sum({weight}) FILTER (WHERE {p} AND {a}), 0D)"
    cells = long.sparkSession.sql(
        f"SELECT filter, CASE {case} END AS grouping_column, CASE {value} END AS value, count(*) AS n, {cell('_p', '_a')} AS tp, {cell('_p', 'NOT _a')} AS fp, {cell('NOT _p', '_a')} AS fn, {cell('NOT _p', 'NOT _a')} AS tn FROM {{long}} GROUP BY {', '.join(['filter', *groups])} GROUPING SETS ({sets})",
        long=long,
    )
    return cells.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "specificity": F.try_divide("tn", F.col("tn") + F.col("fp"))})


def holdout_problems(holdout: DataFrame, labels: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """One row of tests: rows as many as expected, ids unique, all labelled, no blank label."""
    joined = holdout.join(labels.select(key, "label"), key, "left")
    return joined.agg((F.count("*") == rows).alias("row_count_ok"), (F.count_distinct(key) == F.count("*")).alias("unique_ok"), (F.count_if(F.col("label").isNull()) == 0).alias("present_ok"), (F.count_if(F.trim("label") == "") == 0).alias("not_blank_ok"))


def disagreements(voted: DataFrame) -> DataFrame:
    return voted.filter(~F.col("agreed") | (F.col("label") == "uncertain"))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of each column."""
    each = [rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "value", "n") for c in columns]
    return reduce(DataFrame.union, each)
