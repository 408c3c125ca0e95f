"""Small-vector expressions over ARRAY columns; aggregates over vectors are in operators.daily."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") * b.cast("double")))


def norm(x) -> Column:
    return F.sqrt(dot(x, x))


def minus(x, y) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") - b.cast("double"))


def let(value, body) -> Column:
    """body(value) with value computed once, where body uses it for each element of an array."""
    return F.element_at(F.transform(F.array(_c(value)), body), 1)


def scaled(x, by) -> Column:
    return let(by, lambda b: F.transform(_c(x), lambda v: v.cast("double") * b))


def unit(x) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return let(x, lambda v: let(norm(v), lambda n: F.transform(v, lambda e: F.when(n > 0, e.cast("double") / n).otherwise(e.cast("double")))))


def cosine(x, y) -> Column:
    """Cosine, clipped to -1 .. 1; null for a zero vector."""
    return let(F.struct(_c(x).alias("x"), _c(y).alias("y")), lambda p: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(p["x"], p["y"]), norm(p["x"]) * norm(p["y"])))))


def argmax(x) -> Column:
    """0-based place of the largest element; the first of equals."""
    return F.array_position(_c(x), F.array_max(_c(x))) - 1


def entropy(p) -> Column:
    """-sum p ln p with probabilities clipped at 1e-12."""
    return -total(F.transform(_c(p), lambda v: F.greatest(v.cast("double"), F.lit(1e-12)) * F.ln(F.greatest(v.cast("double"), F.lit(1e-12)))))


def softmax(x) -> Column:
    return let(F.transform(_c(x), lambda v: F.exp(v.cast("double"))), lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def checked(x, size: int) -> Column:
    """x, or an error if it has another size or an element that is not finite."""
    ok = (F.size(_c(x)) == size) & F.forall(_c(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(ok, F.lit(False)), _c(x)).otherwise(F.raise_error(F.lit(f"a vector must have {size} finite elements")))
