"""Observation pairs and their compatibility.

A pair is a row with STRUCT columns `earlier` and `later` next to its series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epochlens.config import PairingConfig
from epochlens.functions import geo, text, times
from epochlens.plans.ordered import DAY, ordered

OBSERVATION = ("acquisition_time", "observation_id", "sensor", "platform", "min_lon", "min_lat", "max_lon", "max_lat")


def _payload(obs: DataFrame, extra: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    fields = [*OBSERVATION, *extra]
    return obs.select("series_id", *fields), fields


def _name(pairs: DataFrame, method: str) -> DataFrame:
    return pairs.select(
        "series_id",
        text.pair_id(F.col("earlier.observation_id"), F.col("later.observation_id")).alias("pair_id"),
        F.lit(method).alias("method"),
        "earlier",
        "later",
    )


def pairs_adjacent(obs: DataFrame, extra: tuple[str, ...] = (), width_us: int = DAY) -> DataFrame:
    """Each observation with the next one of its series."""
    rows, fields = _payload(obs, extra)
    out = ordered(rows, ["series_id"], "acquisition_time", "observation_id", next="later", payload=fields, width_us=width_us)
    return _name(out.where(F.col("later").isNotNull()).withColumn("earlier", F.struct(*fields)), "adjacent")


def pairs_baseline(obs: DataFrame, extra: tuple[str, ...] = (), width_us: int = DAY) -> DataFrame:
    """The first observation of a series with every later one."""
    rows, fields = _payload(obs, extra)
    out = ordered(rows, ["series_id"], "acquisition_time", "observation_id", first="earlier", payload=fields, width_us=width_us)
    later = out.where(F.col("earlier.observation_id") != F.col("observation_id"))
    return _name(later.withColumn("later", F.struct(*fields)), "baseline")


def pairs_within(obs: DataFrame, max_separation_s: float | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every ordered pair of a series at most `max_separation_s` apart.

    Times fall into bands as wide as the limit, so a row meets only its own and the next band and the join key
    is (series, band). Without a limit the number of pairs is quadratic in the longest series; that is refused,
    and `pair_counts` gives the exact number of pairs beyond the limit.
    """
    if max_separation_s is None or max_separation_s <= 0:
        raise ValueError("pairing all combinations needs a positive maximum separation")
    rows, fields = _payload(obs, extra)
    band = F.floor(F.unix_micros("acquisition_time") / F.lit(int(max_separation_s * 1_000_000)))
    early = rows.select("series_id", F.struct(*fields).alias("earlier"), F.explode(F.array(band, band + 1)).alias("_band"))
    late = rows.select("series_id", F.struct(*fields).alias("later"), band.alias("_band"))
    e, l = F.col("earlier"), F.col("later")
    in_order = (e["acquisition_time"] < l["acquisition_time"]) | (
        (e["acquisition_time"] == l["acquisition_time"]) & (e["observation_id"] < l["observation_id"])
    )
    near = times.seconds_between(e["acquisition_time"], l["acquisition_time"]) <= max_separation_s
    return _name(early.join(late, ["series_id", "_band"]).where(in_order & near), "all_pairwise")


def pair_counts(obs: DataFrame) -> DataFrame:
    """Number of pairs each strategy has per series, by arithmetic."""
    n = F.col("n")
    return obs.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).select(
        "series_id", (n - 1).alias("adjacent"), (n - 1).alias("baseline"), F.floor(n * (n - 1) / 2).alias("all_pairwise")
    )


STRATEGIES = {"adjacent": pairs_adjacent, "baseline": pairs_baseline}


def make_pairs(obs: DataFrame, strategy: str = "adjacent", config: PairingConfig = PairingConfig(), extra: tuple[str, ...] = ()) -> DataFrame:
    if strategy == "all_pairwise":
        return pairs_within(obs, config.max_separation_s, extra)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown pairing strategy {strategy!r}")
    return STRATEGIES[strategy](obs, extra)


def pair_status(earlier: Column, later: Column, config: PairingConfig = PairingConfig()) -> Column:
    """STRUCT<status, compatible, cross_sensor, cross_platform, seconds, days, overlap>."""
    gap = times.seconds_between(earlier["acquisition_time"], later["acquisition_time"])
    overlap = geo.bbox_overlap(earlier, later)
    metric = config.overlap_metric.lower()
    ratio = overlap["ratio_" + (metric if metric in ("iou", "min", "earlier", "later") else "iou")]
    cross_sensor = F.lower(earlier["sensor"]) != F.lower(later["sensor"])
    cross_platform = F.lower(earlier["platform"]) != F.lower(later["platform"])

    status = F.when(gap < 0, "INVALID_TEMPORAL_ORDER").when(gap == 0, "IDENTICAL_TIMESTAMPS")
    status = status.when(gap < config.min_separation_s, "BELOW_MIN_INTERVAL")
    if config.max_separation_s is not None:
        status = status.when(gap > config.max_separation_s, "EXCEEDS_MAX_INTERVAL")
    status = status.when(~overlap["overlapping"] | (ratio < config.min_overlap), "INSUFFICIENT_OVERLAP")
    if config.require_same_sensor:
        status = status.when(cross_sensor, "INCOMPATIBLE_SENSOR")
    if config.require_same_platform:
        status = status.when(cross_platform, "INCOMPATIBLE_PLATFORM")
    status = status.otherwise("COMPATIBLE")
    gaps = times.separation(earlier["acquisition_time"], later["acquisition_time"])
    return F.struct(
        status.alias("status"),
        (status == "COMPATIBLE").alias("compatible"),
        cross_sensor.alias("cross_sensor"),
        cross_platform.alias("cross_platform"),
        gaps["seconds"].alias("seconds"),
        gaps["days"].alias("days"),
        overlap.alias("overlap"),
    )


def evaluate(pairs: DataFrame, config: PairingConfig = PairingConfig()) -> DataFrame:
    return pairs.withColumn("check", pair_status(F.col("earlier"), F.col("later"), config))


def reasons(check: Column, earlier: Column, later: Column) -> Column:
    """Why a pair failed, or what is worth noting about one that did not."""
    crossing = F.array_compact(
        F.array(
            F.when(check["cross_sensor"], F.concat(F.lit("sensor "), earlier["sensor"], F.lit(" -> "), later["sensor"])),
            F.when(check["cross_platform"], F.concat(F.lit("platform "), earlier["platform"], F.lit(" -> "), later["platform"])),
        )
    )
    return F.when(check["compatible"], crossing).otherwise(F.array(check["status"]))


def split_pairs(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return evaluated.where("check.compatible"), evaluated.where("NOT check.compatible")


def order_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("earlier.acquisition_time", "later.acquisition_time", "pair_id")


def duplicate_pairs(pairs: DataFrame) -> DataFrame:
    """Pair ids supplied more than once."""
    return pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
