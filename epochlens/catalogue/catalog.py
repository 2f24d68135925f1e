"""Catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalogue.registry import query
from epochlens.operators import catalog

US = F.unix_micros


@query("a03_validate", """
    SELECT tile_id, sha256_hash, concat_ws('; ', CASE WHEN NOT coalesce(valid_pixel_ratio IS NULL OR valid_pixel_ratio BETWEEN 0 AND 1, false) THEN 'valid_pixel_ratio outside 0..1' END, CASE WHEN max_lat < min_lat THEN 'max_lat below min_lat' END) AS errors
    FROM (SELECT tile_id, sha256_hash, min_lat, CASE WHEN l_partkey % 5 = 0 THEN min_lat - 1 ELSE max_lat END AS max_lat, valid_pixel_ratio * 2 AS valid_pixel_ratio FROM fx_tiles)""")
def validate(t):
    broken = t.fx_tiles.withColumn("max_lat", F.when(F.col("l_partkey") % 5 == 0, F.col("min_lat") - 1).otherwise(F.col("max_lat"))).withColumn(
        "valid_pixel_ratio", F.col("valid_pixel_ratio") * 2
    )
    return catalog.validate(broken, catalog.tile_rules()).select("tile_id", "sha256_hash", F.array_join("errors", "; ").alias("errors"))


@query("d01_tiles_with_scene", """
    SELECT concat('obs_', tile_id, '_', substring(sha256_hash, 1, 8)) AS observation_id, epoch_us(coalesce(t.acquisition_time, s.acquisition_time)) AS us,
      CASE WHEN t.sensor <> 'unknown' THEN t.sensor ELSE coalesce(s.sensor, 'unknown') END AS sensor, coalesce(s.platform, 'unknown') AS platform,
      coalesce(s.cloud_cover_percentage / 100e0, 0e0) AS cloud_fraction, coalesce(valid_pixel_ratio, 1e0) AS valid_pixel_ratio,
      coalesce(t.acquisition_time, s.acquisition_time) IS NOT NULL AS accepted
    FROM fx_tiles t LEFT JOIN fx_scenes s ON t.source_scene_id = s.scene_id""")
def tiles_with_scene(t):
    return catalog.tiles_with_scene(t.fx_tiles, t.fx_scenes).select(
        "observation_id", US("acquisition_time").alias("us"), "sensor", "platform", "cloud_fraction", "valid_pixel_ratio",
        (F.size("errors") == 0).alias("accepted"),
    )


@query("h03_dedup_observations", """
    SELECT tile_id, min(l_extendedprice) AS l_extendedprice, arg_min(l_partkey, (l_extendedprice, l_partkey)) AS l_partkey, CAST(count(*) AS BIGINT) AS copies FROM fx_tiles GROUP BY tile_id""")
def dedup(t):
    rows = t.fx_tiles.select("tile_id", "l_extendedprice", "l_partkey")
    return catalog.dedup_observations(rows, "tile_id", ["l_extendedprice", "l_partkey"])


@query("e01_build_series", """
    SELECT series_id, min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat, count(*) AS observation_count,
      epoch_us(min(acquisition_time)) AS earliest, epoch_us(max(acquisition_time)) AS latest FROM fx_observations GROUP BY series_id""")
def series(t):
    return catalog.build_series(t.fx_observations).withColumn("earliest", US("earliest")).withColumn("latest", US("latest"))


@query("e01_series_pages", """
    WITH r AS (SELECT series_id, observation_id, row_number() OVER (PARTITION BY series_id ORDER BY acquisition_time, observation_id) AS rn FROM fx_observations)
    SELECT series_id, CAST(floor((rn - 1) / 25) AS INT) AS page, string_agg(observation_id, ',' ORDER BY rn) AS observations FROM r GROUP BY ALL""")
def pages(t):
    return catalog.series_pages(t.fx_observations, 25).select(
        "series_id", "page", F.array_join(F.col("observations.observation_id"), ",").alias("observations")
    )


@query("e02_series_summary", """
    SELECT series_id, count(*) AS observation_count, string_agg(DISTINCT sensor, ',' ORDER BY sensor) AS sensors, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms,
      round((epoch_us(max(acquisition_time)) - epoch_us(min(acquisition_time))) / 1e6 / 86400e0, 1) AS timespan_days FROM fx_observations GROUP BY series_id""")
def summary(t):
    return catalog.series_summary(t.fx_observations).withColumn("sensors", F.array_join("sensors", ",")).withColumn("platforms", F.array_join("platforms", ","))


@query("c05_search_series", """
    SELECT series_id, count(*) AS observation_count FROM fx_observations GROUP BY series_id HAVING count(*) >= 2 AND (contains(lower(series_id), 'series_1') OR bool_or(contains(lower(sensor), 'series_1')))""")
def search(t):
    return catalog.search_series(catalog.series_summary(t.fx_observations), "Series_1", True).select("series_id", "observation_count")


@query("e03_catalog_metrics", """
    WITH o AS (SELECT t.*, coalesce(t.acquisition_time, s.acquisition_time) IS NOT NULL AS ok FROM fx_tiles t LEFT JOIN fx_scenes s ON t.source_scene_id = s.scene_id)
    SELECT (SELECT count(*) FROM fx_scenes) AS scenes, CAST(count(*) FILTER (ok) AS BIGINT) AS accepted_rows, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS invalid_observations,
      count(DISTINCT CASE WHEN ok THEN tile_id || sha256_hash END) AS valid_observations,
      count(DISTINCT CASE WHEN ok THEN printf('%.2f_%.2f_%d_%d', round((min_lon + max_lon) / 2, 2), round((min_lat + max_lat) / 2, 2), tile_col, tile_row) END) AS series FROM o""")
def metrics(t):
    return catalog.catalog_metrics(t.fx_scenes, t.fx_tiles)


@query("e04_count_tiles", "SELECT count(*) AS tiles, count(DISTINCT source_scene_id) AS scenes FROM fx_tiles")
def counts(t):
    return catalog.count_tiles(t.fx_tiles)


@query("f01_chronological_rank", """
    SELECT series_id, observation_id, row_number() OVER (PARTITION BY series_id ORDER BY acquisition_time, observation_id) AS chronological_rank FROM fx_observations""")
def rank(t):
    return catalog.chronological_rank(t.fx_observations).select("series_id", "observation_id", "chronological_rank")


@query("f02_mark_simultaneous", """
    SELECT observation_id, row_number() OVER (PARTITION BY series_id, date_trunc('hour', acquisition_time) ORDER BY observation_id) > 1 AS is_simultaneous FROM fx_observations""")
def simultaneous(t):
    hourly = t.fx_observations.withColumn("acquisition_time", F.date_trunc("hour", "acquisition_time"))
    return catalog.mark_simultaneous(hourly).select("observation_id", "is_simultaneous")


@query("f03_temporal_gaps", """
    WITH g AS (SELECT series_id, observation_id AS later_id, lag(observation_id) OVER w AS earlier_id, round((epoch_us(acquisition_time) - epoch_us(lag(acquisition_time) OVER w)) / 1e6 / 86400e0, 1) AS gap_days
      FROM fx_observations WINDOW w AS (PARTITION BY series_id ORDER BY acquisition_time, observation_id))
    SELECT series_id, earlier_id, later_id, gap_days FROM g WHERE gap_days > 0.55e0""")
def gaps(t):
    return catalog.temporal_gaps(t.fx_observations, 0.55)


@query("g02_order_series", "SELECT series_id, count(*) AS observation_count FROM fx_observations GROUP BY series_id ORDER BY series_id")
def ordered_series(t):
    return catalog.order_series(catalog.build_series(t.fx_observations).select("series_id", "observation_count"))
