"""Vector expressions over ARRAY<DOUBLE>, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

TINY = 1e-12  # fixed value: shorter vectors have no direction


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, also where the body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column, when_short: str = "keep") -> Column:
    """Unit vector; one without direction stays as it is (`keep`) or becomes zeros (`zero`)."""
    def scaled(x):
        short = x if when_short == "keep" else F.transform(x, lambda e: F.lit(0.0))
        return let(norm(x), lambda n: F.when(n < TINY, short).otherwise(F.transform(x, lambda e: e / n)))

    return let(v, scaled)


def cosine(u: Column, v: Column, clip: bool = False) -> Column:
    lu, lv = norm(u), norm(v)
    value = F.when((lu < TINY) | (lv < TINY), 0.0).otherwise(dot(u, v) / (lu * lv))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)) if clip else value


def dimension_error(v: Column, dimension: int) -> Column:
    return F.when(
        v.isNull() | (F.size(v) != dimension),
        F.concat(F.lit(f"expected {dimension} values, got "), F.coalesce(F.size(v), F.lit(0)).cast("string")),
    )
