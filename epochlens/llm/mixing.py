"""Mixtures of sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from epochlens.session import cut

PLAIN_WORD = r"[^\x20\x09-\x0D]+"
#: Equal parts of the rank scale in which words are summed before any rows are ordered.
BINS = 4_096
#: Sources whose plan, a few numbers each, may be sent to every task.
BROADCAST = 10_000


def _draw(seed: int) -> Column:
    """A number in (0, 1) from a document's id and text: the upper 52 bits of a hash, so that the double is exact."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 12).cast("double") + 0.5) / float(1 << 52)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, u): words of each text, and its draw."""
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(PLAIN_WORD)), F.lit(0)).cast("bigint").alias("size"),
        _draw(seed).alias("u"),
    )


def targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): `share` of all sizes split by weight, no source above `most` times its size.

    Sources by code point, null last, take the weights in turn. What a capped source leaves is shared again by
    weight until none is above: the level at which the targets of uncapped sources stand is found in one pass over
    the sources, ordered by the level at which each is capped. One row per source passes one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    every = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0.0)
    levels = weighted.withColumn("cap", cap).withColumn(
        # The level if exactly the sources before this one are capped.
        "level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), zero)) / F.sum("weight").over(after)
    )
    # It falls once a source is taken for capped that isn't, so the right one is the largest that caps no other.
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return levels.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _rank(u: Column, odds: Column) -> Column:
    """Rank in (0, 1), rising with the ratio of a document's random odds to its inclusion odds."""
    ratio = (u / (1 - u)) / odds
    return ratio / (1 + ratio)


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> tuple[DataFrame, DataFrame, int]:
    """The sized documents, per source (and the number of sources): source, source_size, target, copies, odds, last_rank, extra_rank.

    Every document of a source is taken `copies` times, for certain. For the rest of the target each is included
    with the same remaining probability; documents of the smallest ranks are taken once more, up to `last_rank`,
    until the next would pass the target, and then the one of rank `extra_rank` whose size comes nearest to what is
    left, if that helps. Ranks are cut in bins of which only the last needs its rows in order.
    """
    sized = cut(_sized(docs, seed))
    goal = cut(
        targets(sized, weights, share, most).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("copies", F.least(F.floor(F.col("ratio") + 1e-12), F.lit(int(most))).cast("bigint"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
        .withColumn("chance", F.greatest(F.lit(0.0), F.col("ratio") - F.col("copies")))
        .withColumn("odds", F.when((F.col("chance") > 1e-12) & (F.col("copies") < most), F.col("chance") / (1 - F.col("chance"))))
    )
    sources = goal.count()
    ranked = cut(
        _with_source(sized, goal.where("odds IS NOT NULL").select("source", "odds", "rest"), sources=sources)
        .withColumn("rank", _rank(F.col("u"), F.col("odds"))).withColumn("bin", F.floor(F.col("rank") * BINS))
        .select("source", "size", "rank", "bin", "rest")
    )
    in_order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        ranked.groupBy("source", "bin", "rest").agg(F.sum("size").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    )
    last = bins.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))).select(
        F.col("source").alias("_source"), F.col("bin").alias("_bin"), "before"
    )
    by_rank = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        ranked.join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin")))
        .withColumn("upto", F.col("before") + F.sum("size").over(by_rank))
        .groupBy("source").agg(
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("rank"))).alias("in_last"),
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("in_upto"),
            F.min("before").alias("before"), F.min("bin").alias("bin"),
        )
    )
    cuts = cut(
        inside.select(
            "source",
            # Without a fitting row in the last bin, the rank where that bin begins.
            F.coalesce("in_last", F.col("bin") / BINS).alias("last_rank"), F.coalesce("in_upto", "before").alias("upto"),
        )
    )
    spare = _with_source(ranked, cuts, sources=sources).where("rank > last_rank").withColumn("off", F.abs(F.col("rest") - F.col("upto") - F.col("size")))
    extra = spare.where(F.col("off") < F.col("rest") - F.col("upto")).groupBy("source").agg(
        F.min_by("rank", F.struct("off", "rank")).alias("extra_rank")
    )
    full = goal.select("source", "source_size", "target", "copies", "odds")
    return sized, _with_source(_with_source(full, cuts.select("source", "last_rank"), "left"), extra, "left"), sources


def _with_source(rows: DataFrame, by_source: DataFrame, how: str = "inner", sources: int | None = None) -> DataFrame:
    """Join on the source, null with null. A counted number of `sources` up to BROADCAST travels to the tasks, so that
    rows of a large source stay where they are; more are joined by a shuffle, where the adaptive planner splits them."""
    other = by_source.withColumnRenamed("source", "_source")
    if sources is not None and sources <= BROADCAST:
        other = F.broadcast(other)
    return rows.join(other, rows["source"].eqNullSafe(F.col("_source")), how).drop("_source")


def _taken(planned: DataFrame) -> DataFrame:
    """Copies of each row, given its draw and the plan of its source."""
    rank = _rank(F.col("u"), F.col("odds"))
    # Every rank is below the last one where the whole source fits.
    more = F.col("odds").isNotNull() & ((rank <= F.coalesce("last_rank", F.lit(1.0))) | (rank == F.col("extra_rank")))
    return planned.withColumn("copies", F.col("copies") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    Null texts have size 0; a null source is a source. Equal rows (id and text) share one draw, and so are taken
    equally often. An empty table gives no rows. Only doc_id, text and source are read.
    """
    sized, by_source, sources = plan(docs, **options)
    return _taken(_with_source(sized, by_source, sources=sources)).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, seed: int = 11, **options) -> DataFrame:
    """The documents, each as many times as the mixture takes it; columns as given.

    Every row is judged by its own draw and the plan of its source, so texts need not be shuffled.
    """
    _, by_source, sources = plan(docs, seed=seed, **options)
    # The row travels as one column, so that no other column of it can clash.
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("source").cast("string").alias("source"), _draw(seed).alias("u"))
    counted = _taken(_with_source(held, by_source, sources=sources)).where("copies > 0")
    return counted.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
