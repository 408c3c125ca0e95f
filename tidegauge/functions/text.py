"""Text rules as column expressions over a lexicon: they run in the JVM, inside code generation."""

from __future__ import annotations

import html
import sys
import unicodedata
from functools import cache, reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidegauge.functions.lexicon import DEFAULT, Lexicon
from tidegauge.functions.vectors import let

#: Java's flags for what Python's regular expressions do by themselves: fold case and read \b and \s as Unicode.
FLAGS = "(?iuU)"
LEAD, SHORT_LEAD = 2000, 500


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def _unescape(text):
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _ascii(text):
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def clean(text, lexicon: Lexicon = DEFAULT, entities: bool = True) -> Column:
    """Unescape entities, cut at the earliest footer, strip tags and control characters, collapse space.

    Null becomes the empty string. With entities=False the text is taken to hold
    none and the whole rule stays in the JVM.
    """
    value = F.coalesce(_c(text), F.lit(""))
    if entities:
        # only texts with an ampersand have anything to unescape
        value = F.when(F.contains(value, F.lit("&")), _unescape(value)).otherwise(value)
    value = F.regexp_replace(value, "(?s)" + FLAGS + "(" + "|".join(lexicon.footers) + ").*$", "")
    value = F.regexp_replace(value, "<[^>]+>", " ")
    value = F.regexp_replace(value, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]+", " ")
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """Number of matches of all patterns."""
    return reduce(add, (F.regexp_count(text, F.lit(FLAGS + p)) for p in patterns), F.lit(0))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike(FLAGS + "(?:" + "|".join(patterns) + ")") if patterns else F.lit(False)


def mentions(title, body, lexicon: Lexicon = DEFAULT) -> Column:
    """struct of what relevance and evidence look at in a title and a cleaned body; each pattern is matched once."""
    title, body = F.coalesce(_c(title), F.lit("")), F.coalesce(_c(body), F.lit(""))
    lead = F.substring(body, 1, LEAD)
    return F.struct(
        hits(title, lexicon.primary).alias("in_title"),
        hits(lead, lexicon.primary).alias("in_lead"),
        any_of(F.substring(body, 1, SHORT_LEAD), lexicon.primary).alias("in_short_lead"),
        any_of(title, lexicon.specific).alias("title_specific"),
        any_of(lead, lexicon.specific).alias("lead_specific"),
        any_of(F.concat_ws(" ", title, lead), lexicon.lookalike).alias("lookalike"),
    )


def relevance_of(m: Column) -> Column:
    """struct(keep, score) of mentions."""
    lookalike = m["lookalike"] & (m["in_title"] + m["in_lead"] == 0) & ~m["title_specific"] & ~m["lead_specific"]
    points = F.when(m["in_title"] > 0, 3).otherwise(0) + F.when(m["in_short_lead"], 2).otherwise(0) + F.when(m["title_specific"] | m["lead_specific"], 2).otherwise(0) + F.when(m["in_title"] + m["in_lead"] >= 3, 1).otherwise(0)
    rule = (m["in_title"] > 0) | m["title_specific"] | (m["in_lead"] >= 2) | m["lead_specific"]
    score = F.when(lookalike, 0).otherwise(points)
    return F.struct((rule & (score >= 2)).alias("keep"), score.cast("int").alias("score"))


def evidence_of(m: Column) -> Column:
    """The first class of evidence that holds, of mentions."""
    return (
        F.when(m["in_title"] > 0, "title_primary")
        .when(m["title_specific"], "title_specific")
        .when(m["lead_specific"], "content_specific")
        .when(m["in_lead"] >= 2, "content_repeated")
        .when(m["in_lead"] == 1, "content_single")
        .otherwise("no_evidence")
    )


def relevance(title, body, lexicon: Lexicon = DEFAULT) -> Column:
    """struct(keep, score) of a title and a cleaned body.

    Title mention 3, mention among the first 500 characters 2, specific term 2,
    three mentions or more 1. A look-alike without other evidence scores 0.
    """
    return let(mentions(title, body, lexicon), relevance_of)


def evidence(title, body, lexicon: Lexicon = DEFAULT) -> Column:
    """The first class of evidence that holds."""
    return let(mentions(title, body, lexicon), evidence_of)


def score_band(score) -> Column:
    s = _c(score)
    return F.when(s < 2, "below_threshold").when(s == 2, "threshold_2").when(s == 3, "score_3").otherwise("score_4_plus")


def family(title, lead, lexicon: Lexicon = DEFAULT) -> Column:
    """The first family of which the text has a substring, else 'other'."""
    text = F.lower(F.concat(F.lit(" "), F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(lead), F.lit("")), F.lit(" ")))
    out = F
    for name, needles in lexicon.families:
        out = out.when(reduce(or_, (F.contains(text, F.lit(x)) for x in needles)), name)
    return out.otherwise("other") if lexicon.families else F.lit("other")


def event_decision(title, lead, enabled: Column, lexicon: Lexicon = DEFAULT, refined: bool = False) -> Column:
    """struct(keep, score, reason, recap) of a cleaned title and lead.

    enabled: ARRAY<STRING> of the context families that count. refined: a single
    direct mention with a concrete event is kept too.
    """
    title = F.coalesce(_c(title), F.lit(""))
    lead = F.substring(F.coalesce(_c(lead), F.lit("")), 1, SHORT_LEAD)
    direct, kind = relevance(title, lead, lexicon), family(title, lead, lexicon)
    text = F.concat_ws(" ", title, lead)
    recap = kind == lexicon.recap_family
    concrete = text.rlike(FLAGS + lexicon.concrete)
    context = F.array_contains(enabled, kind) & text.rlike(FLAGS + lexicon.anchor) & ((kind != lexicon.vague_family) | concrete)

    def answer(keep, score, reason):
        return F.struct(F.lit(keep).alias("keep"), (score if isinstance(score, Column) else F.lit(score)).cast("int").alias("score"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), recap.alias("recap"))

    out = F.when(any_of(title, lexicon.lookalike) & ~any_of(title, lexicon.primary) & recap, answer(False, 0, "lookalike_price_recap"))
    out = out.when(direct["keep"], answer(True, F.when(recap, 1).otherwise(F.greatest(direct["score"], F.lit(1))), "direct_rule"))
    out = out.when(context, answer(True, 2, F.concat(F.lit("context_event:"), kind)))
    if refined:
        out = out.when((kind == lexicon.direct_family) & concrete, answer(True, 2, "direct_concrete_repair"))
    return out.otherwise(answer(False, 0, F.concat(F.lit("no_enabled_event:"), kind)))


@cache
def _folds() -> tuple[str, str, str]:
    """(from, to, several): characters whose NFKD has one ASCII character, and that; those with several."""
    one, several = [], []
    for i in [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)]:
        folded = unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            one.append((chr(i), folded))
        elif folded:
            several.append(chr(i))
    return "".join(a for a, _ in one), "".join(b for _, b in one), "".join(several)


def duplicate_key(text) -> Column:
    """NFKD, ASCII, lower case, runs of anything but letters and digits as one space.

    Characters are folded one by one, which gives the same ASCII, as NFKD moves
    none of it. Python sees only texts with a character that becomes several (such as
    an ellipsis or a ligature); a null stands for every other one.
    """
    value = F.coalesce(_c(text), F.lit(""))
    source, to, several = _folds()
    letters = lambda v: F.regexp_replace(v, r"[^\x00-\x7F]+", "")
    others = F.regexp_replace(value, r"[\x00-\x7F]+", "")
    hard = F.translate(others, several, "") != others  # looked up by hash
    folded = F.when(others == "", value).when(hard, _ascii(F.when(hard, value))).otherwise(letters(F.translate(value, source, to)))
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def content_key(*columns) -> Column:
    """A stable key of the values of columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def words(text) -> Column:
    """White-space words; the empty array for a text without words."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def budgeted(title, body, budget: int, with_title: bool = True) -> Column:
    """'Title: … Content: …' of at most budget words less two, the title first."""
    prefix = words(F.concat(F.lit("Title: "), F.coalesce(_c(title), F.lit("")), F.lit(" Content:"))) if with_title else F.array().cast("array<string>")
    head = F.slice(prefix, 1, budget - 2)
    room = F.greatest(F.lit(0), F.lit(budget - 2) - F.size(head))
    return F.array_join(F.concat(head, F.slice(words(body), F.lit(1), room)), " ")


def chunks(body, budget: int) -> Column:
    """The body in pieces of budget words that don't overlap; one piece at least."""
    cut = lambda w, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * budget + 1, F.lit(budget)), " "))
    return let(words(body), lambda w: cut(w, F.greatest(F.lit(1), F.ceil(F.size(w) / budget)).cast("int")))
