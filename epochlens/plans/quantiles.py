"""Exact quantiles for groups of any size and any distribution.

A mergeable sketch brackets each wanted rank; values below a bracket are only counted, and the few values
inside it are ordered. No task sees a whole group, and outliers or repeated values do not widen a bracket,
because it is narrow in rank, not in value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

ACCURACY = 10_000  # the sketch is off by at most one part in this many of the ranks


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """One row per key with the linearly interpolated quantiles named in `probs`; NULL values are left out.

    One method for groups of any size, so that a group's result doesn't depend on what else is in the table.
    """
    keys = list(keys)
    held = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    names = list(probs)
    slack = 2.0 / accuracy
    ends = [e for p in probs.values() for e in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = held.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), accuracy).alias("_e"), F.count(F.lit(1)).alias("_total")
    )
    # The interpolated quantile may need the value one rank beyond a bracket; the ends leave room for it, except
    # in groups so small that one rank is more than the slack, which are kept whole.
    small = F.col("_total") <= accuracy
    bounds = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.when(~small, F.get("_e", F.lit(2 * i))).alias("low"), F.when(~small, F.get("_e", F.lit(2 * i + 1))).alias("high")
        )
        for i in range(len(names))
    ])
    brackets = sketch.select(*keys, F.struct("_total", bounds.alias("_b")).alias("_s"))
    # NaN sorts last and never lies below a bound, as in the built-in aggregate.
    if keys:
        known = held.join(brackets, keys)
    else:  # one row of brackets for the whole table, as a scalar subquery
        known = held.withColumn("_s", brackets.select("_s").scalar())
    placed = known.select(*keys, F.col("_s._total").alias("_total"), "_v", F.explode("_s._b").alias("_b"))
    below = F.col("_b.low").isNotNull() & (F.col("_v") < F.col("_b.low"))
    above = F.col("_b.high").isNotNull() & (F.col("_v") > F.col("_b.high"))
    counted = (
        placed.where(~above)
        .groupBy(*keys, F.col("_b.i").alias("_i"), F.when(~below, F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_total").alias("_total"))
    )
    # NULL stands for everything below and sorts first, so the running sum starts at the right rank.
    inside = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    located = counted.withColumn("_end", F.sum("_n").over(inside)).withColumn("_start", F.col("_end") - F.col("_n"))
    aggs = []
    for i, (name, p) in enumerate(probs.items()):
        rank = F.lit(float(p)) * (F.col("_total") - 1)

        def at(r, i=i):
            return F.max(F.when((F.col("_i") == i) & (r >= F.col("_start")) & (r < F.col("_end")), F.col("_v")))

        low, high = at(F.floor(rank)), at(F.ceil(rank))
        aggs.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    return located.groupBy(*keys).agg(*aggs).select(*keys, *names)
