"""Scene and tile catalog: joins to scenes, de-duplication, series and their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from epochlens.functions import text, times
from epochlens.plans.ordered import DAY, ordered
from epochlens.session import cut

SERIES = ("series_id",)


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `errors`: the message of every rule that does not hold (an undecided rule does not hold)."""
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def box_rules(prefix: str = "") -> dict[str, Column]:
    lon0, lat0, lon1, lat1 = (F.col(prefix + c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    return {
        "longitude outside -180..180": lon0.between(-180, 180) & lon1.between(-180, 180),
        "latitude outside -90..90": lat0.between(-90, 90) & lat1.between(-90, 90),
        "max_lon below min_lon": lon1 >= lon0,
        "max_lat below min_lat": lat1 >= lat0,
    }


def tile_rules() -> dict[str, Column]:
    return {
        "tile_id too short": F.length("tile_id") >= 3,
        "source_scene_id too short": F.length("source_scene_id") >= 3,
        "negative grid position": (F.col("tile_col") >= 0) & (F.col("tile_row") >= 0),
        "sha256_hash is not 64 characters": F.length("sha256_hash") == 64,
        "valid_pixel_ratio outside 0..1": F.col("valid_pixel_ratio").isNull() | F.col("valid_pixel_ratio").between(0, 1),
        **box_rules(),
    }


def scene_rules() -> dict[str, Column]:
    cloud = F.col("cloud_cover_percentage")
    return {"scene_id too short": F.length("scene_id") >= 3, "cloud cover outside 0..100": cloud.isNull() | cloud.between(0, 100)}


def tiles_with_scene(tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Tiles completed from their scene; `errors` tells which have no acquisition time from either.

    The join carries no hint: a small scene table is broadcast by its size, otherwise a scene with very many
    tiles is split by the adaptive skew join.
    """
    parent = scenes.select(
        F.col("scene_id").alias("source_scene_id"),
        F.col("acquisition_time").alias("scene_time"),
        F.col("sensor").alias("scene_sensor"),
        F.col("platform").alias("scene_platform"),
        F.col("cloud_cover_percentage").alias("scene_cloud"),
        F.lit(True).alias("has_scene"),
    )
    unknown = F.lit("unknown")
    joined = tiles.join(parent, "source_scene_id", "left")
    complete = joined.select(
        text.observation_id(F.col("tile_id"), F.col("sha256_hash")).alias("observation_id"),
        F.col("source_scene_id").alias("scene_id"),
        "tile_id",
        times.to_utc(F.coalesce("acquisition_time", "scene_time")).alias("acquisition_time"),
        F.when(F.col("sensor") != "unknown", F.col("sensor")).otherwise(F.coalesce("scene_sensor", unknown)).alias("sensor"),
        F.coalesce("scene_platform", unknown).alias("platform"),
        F.coalesce("valid_pixel_ratio", F.lit(1.0)).alias("valid_pixel_ratio"),
        F.coalesce(F.col("scene_cloud") / 100.0, F.lit(0.0)).alias("cloud_fraction"),
        F.coalesce("has_scene", F.lit(False)).alias("has_scene"),
        *[c for c in ("tile_col", "tile_row", "zoom_level", "min_lon", "min_lat", "max_lon", "max_lat", "sha256_hash") if c in tiles.columns],
    )
    return validate(complete, {"acquisition_time is missing": F.col("acquisition_time").isNotNull()})


def dedup_observations(obs: DataFrame, key: str = "observation_id", order: Sequence[str] = ()) -> DataFrame:
    """First row per key in the given order, with `copies`, the number of rows it stands for.

    An aggregate, so copies collapse before the shuffle and a very frequent key costs no more than a rare one.
    """
    rest = [c for c in obs.columns if c != key and c not in order]
    first = obs.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return first.select(*[F.col(f"_first.{c}").alias(c) if c != key else F.col(key) for c in obs.columns], "copies")


def series_key(obs: DataFrame) -> DataFrame:
    key = text.grid_key(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat", "tile_col", "tile_row", "zoom_level", "tile_id")])
    return obs.withColumn("target_id", key).withColumn("series_id", F.concat(F.lit("series_"), "target_id"))


def build_series(obs: DataFrame, key: str = "series_id") -> DataFrame:
    """One row per series: covering box, number of observations, first and last time."""
    return obs.groupBy(key).agg(
        F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"),
        F.count(F.lit(1)).alias("observation_count"),
        F.min("acquisition_time").alias("earliest"), F.max("acquisition_time").alias("latest"),
    )


def series_pages(obs: DataFrame, page_size: int = 1000, fields: Sequence[str] = ("observation_id", "acquisition_time")) -> DataFrame:
    """The nested view of a series in pages of bounded size, in chronological order."""
    ranked = chronological_rank(obs)
    page = F.floor((F.col("chronological_rank") - 1) / page_size).cast("int")
    return ranked.groupBy("series_id", page.alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("chronological_rank", *fields))).alias("observations")
    )


def series_summary(obs: DataFrame) -> DataFrame:
    days = times.seconds_between(F.min("acquisition_time"), F.max("acquisition_time")) / 86400.0
    return obs.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.array_sort(F.collect_set("sensor")).alias("sensors"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
        F.round(days, 1).alias("timespan_days"),
    )


def search_series(summary: DataFrame, term: str, multi_epoch: bool = False) -> DataFrame:
    """Series whose id, or any sensor or platform, holds the term (ignoring case)."""
    needle = F.lit(term.lower())

    def has(c):
        return F.contains(F.lower(c), needle)

    hit = has(F.col("series_id")) | F.exists("sensors", has) | F.exists("platforms", has)
    if "target_id" in summary.columns:
        hit = hit | has(F.col("target_id"))
    return summary.where(hit & (F.col("observation_count") >= (2 if multi_epoch else 0)))


def catalog_metrics(scenes: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row: scenes, accepted and rejected observations, series.

    Only tiles without a time of their own are joined to scenes, as ids. A scene that is listed several times counts its
    tiles as often; such scenes are found by themselves.
    """
    rows = series_key(tiles).select(
        "source_scene_id", F.col("acquisition_time").isNotNull().alias("_own"),
        text.observation_id(F.col("tile_id"), F.col("sha256_hash")).alias("observation_id"), "series_id",
    )
    own = rows.where("_own").drop("_own")
    timed = scenes.select(F.col("scene_id").alias("source_scene_id"), F.col("acquisition_time").isNotNull().alias("_ok"))
    others = rows.where("NOT _own").join(timed, "source_scene_id", "left")
    ids = own.withColumn("_ok", F.lit(True)).unionByName(others.drop("_own"))
    valid = F.col("_ok").eqNullSafe(True)
    observed = ids.agg(
        F.count_if(valid).alias("accepted_rows"), F.count_if(~valid).alias("invalid_observations"),
        F.count_distinct(F.when(valid, F.col("observation_id"))).alias("valid_observations"),
        F.count_distinct(F.when(valid, F.col("series_id"))).alias("series"),
    )
    copies = cut(scenes.groupBy(F.col("scene_id").alias("source_scene_id")).agg((F.count(F.lit(1)) - 1).alias("_more")).where("_more > 0"))
    again = own.join(copies, "source_scene_id").agg(F.sum("_more").alias("accepted_rows"))
    parts = scenes.agg(F.count(F.lit(1)).alias("scenes")).unionByName(observed, allowMissingColumns=True).unionByName(again, allowMissingColumns=True)
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


def count_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.count(F.lit(1)).alias("tiles"), F.count_distinct("source_scene_id").alias("scenes"))


def chronological_rank(obs: DataFrame, width_us: int = DAY) -> DataFrame:
    return ordered(obs, SERIES, "acquisition_time", "observation_id", rank="chronological_rank", width_us=width_us)


def mark_simultaneous(obs: DataFrame, width_us: int = DAY) -> DataFrame:
    """The first observation of a moment is kept, the others of the same series and moment are flagged."""
    out = ordered(obs, SERIES, "acquisition_time", "observation_id", prev="_before", width_us=width_us)
    same = F.col("_before.acquisition_time") == F.col("acquisition_time")
    return out.withColumn("is_simultaneous", F.coalesce(same, F.lit(False))).drop("_before")


def temporal_gaps(obs: DataFrame, max_days: float = 90.0, width_us: int = DAY) -> DataFrame:
    """Neighbouring observations further apart than `max_days` (days to 1 dp)."""
    out = ordered(obs, SERIES, "acquisition_time", "observation_id", prev="_before", width_us=width_us)
    days = F.round(times.seconds_between(F.col("_before.acquisition_time"), F.col("acquisition_time")) / 86400.0, 1)
    return (
        out.withColumn("gap_days", days)
        .where(F.col("gap_days") > max_days)
        .select("series_id", F.col("_before.observation_id").alias("earlier_id"), F.col("observation_id").alias("later_id"), "gap_days")
    )


def order_series(series: DataFrame) -> DataFrame:
    return series.orderBy("series_id")
