"""Column contracts of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "date": T.DateType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType())}


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in spec.split(", "))])


BARS = _struct("series_id string, ts timestamp, open double, high double, low double, close double, volume double, quote_volume double, trades double, taker_base double, taker_quote double")
ARTICLES = _struct("doc_id string, ts timestamp, title string, body string, source string")
#: Known only after the fact, so never read as features.
FORBIDDEN_ARTICLE_FIELDS = frozenset({"source_count", "member_count", "republication_offsets_minutes", "all_sources", "all_urls", "all_source_urls", "all_title_variants", "member_original_row_ids"})
FOLDS = _struct("fold string, block string, start date, end date")
VECTORS = _struct("content_hash string, model string, representation string, dimension int, vector array<float>, created timestamp")
LABELS = _struct("doc_id string, label string, event_types array<string>, confidence double, reason string")
PREDICTIONS = _struct("fold string, model string, seed int, target_date date, true_rv double, predicted_rv double")

EVENT_TYPES = ("none", "security", "regulation", "exchange", "macro", "mining", "stablecoin", "price", "adoption", "other")
RELEVANCE = ("relevant", "irrelevant", "uncertain")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error naming the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def refuse_forbidden(df: DataFrame) -> DataFrame:
    """df, or an error naming columns that hold knowledge from after the fact."""
    if found := sorted(FORBIDDEN_ARTICLE_FIELDS & set(df.columns)):
        raise ValueError(f"retrospective columns: {', '.join(found)}")
    return df
