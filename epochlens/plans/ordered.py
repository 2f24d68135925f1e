"""Ordered windows over keys of any size.

A plain window puts every row of a key into one task. Here the rows of a key are first split into time
chunks; rank, neighbours and running values are computed inside a chunk and completed with a small
per-chunk summary (one row per key and chunk, aggregated before it is shuffled). The rows themselves are
shuffled once, on (key, chunk), and the summary joins on the same columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = 86_400_000_000


_BEFORE_ALL = -(2**62)


def chunk_of(ts: Column, width_us: int) -> Column:
    """Time chunk of a row; rows without a time come first and share one chunk."""
    return F.coalesce(F.floor(F.unix_micros(ts) / F.lit(width_us)), F.lit(_BEFORE_ALL))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    *,
    rank: str | None = None,
    prev: str | None = None,
    next: str | None = None,
    first: str | None = None,
    payload: Sequence[str] = (),
    width_us: int = DAY,
    chunk: Column | None = None,
) -> DataFrame:
    """Add rank / previous / next / first row of the key in (ts, tie) order.

    `prev`, `next` and `first` name STRUCT columns holding (ts, tie, *payload). `ts` may be any orderable
    column when `chunk`, a non-decreasing function of it, is given.
    """
    keys = list(keys)
    fields = [c for c in dict.fromkeys([ts, tie, *payload])]
    base = df.withColumn("_o_chunk", chunk if chunk is not None else chunk_of(F.col(ts), width_us))
    row = F.struct(*fields)

    summary_aggs = [F.count(F.lit(1)).alias("_o_n")]
    if next or first:
        summary_aggs.append(F.min(row).alias("_o_head"))
    if prev:
        summary_aggs.append(F.max(row).alias("_o_tail"))
    chunks = base.groupBy(*keys, "_o_chunk").agg(*summary_aggs)
    over = Window.partitionBy(*keys).orderBy("_o_chunk") if keys else Window.orderBy("_o_chunk")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    picked = [*keys, "_o_chunk"]
    if rank:
        picked.append(F.coalesce(F.sum("_o_n").over(before), F.lit(0)).alias("_o_before"))
    if next:
        picked.append(F.lead("_o_head").over(over).alias("_o_next_head"))
    if prev:
        picked.append(F.lag("_o_tail").over(over).alias("_o_prev_tail"))
    if first:
        picked.append(F.first("_o_head").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("_o_first"))
    chunks = chunks.select(*picked)

    inner = Window.partitionBy(*keys, "_o_chunk").orderBy(ts, tie)
    out = base
    if rank:
        out = out.withColumn("_o_rn", F.row_number().over(inner))
    if next:
        out = out.withColumn("_o_next", F.lead(row).over(inner))
    if prev:
        out = out.withColumn("_o_prev", F.lag(row).over(inner))
    out = out.join(chunks, [*keys, "_o_chunk"])
    result = [F.col(c) for c in df.columns]
    if rank:
        result.append((F.col("_o_rn") + F.col("_o_before")).alias(rank))
    if next:
        result.append(F.coalesce("_o_next", "_o_next_head").alias(next))
    if prev:
        result.append(F.coalesce("_o_prev", "_o_prev_tail").alias(prev))
    if first:
        result.append(F.col("_o_first").alias(first))
    return out.select(*result)


def keyed(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Per-key aggregates joined back to the rows; the aggregate combines map-side and the join can split hot keys."""
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys))
