"""Scalar projections over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalogue.registry import query
from epochlens.functions import geo, text, times

def no_tags():
    return F.create_map().cast("map<string,string>")


def obs_box():
    return geo.box(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))


@query("b01_parse_acquisition_time", """
    WITH p AS (SELECT o_orderkey, stem,
        regexp_extract(stem, '(\\d{4})[_-]?(\\d{2})[_-]?(\\d{2})(?:[T_](\\d{2})(\\d{2})(\\d{2}))?', 1) AS y,
        regexp_extract(stem, '(\\d{4})[_-]?(\\d{2})[_-]?(\\d{2})(?:[T_](\\d{2})(\\d{2})(\\d{2}))?', 2) AS m,
        regexp_extract(stem, '(\\d{4})[_-]?(\\d{2})[_-]?(\\d{2})(?:[T_](\\d{2})(\\d{2})(\\d{2}))?', 3) AS d,
        regexp_extract(stem, '(\\d{4})[_-]?(\\d{2})[_-]?(\\d{2})(?:[T_](\\d{2})(\\d{2})(\\d{2}))?', 4) AS h,
        regexp_extract(stem, '(\\d{4})[_-]?(\\d{2})[_-]?(\\d{2})(?:[T_](\\d{2})(\\d{2})(\\d{2}))?', 5) AS mi,
        regexp_extract(stem, '(\\d{4})[_-]?(\\d{2})[_-]?(\\d{2})(?:[T_](\\d{2})(\\d{2})(\\d{2}))?', 6) AS s
      FROM fx_scene_names)
    SELECT o_orderkey,
      epoch_us(make_timestamp(CAST(y AS BIGINT), CAST(m AS BIGINT), CAST(d AS BIGINT),
        coalesce(try_cast(h AS BIGINT), 0), coalesce(try_cast(mi AS BIGINT), 0), coalesce(try_cast(s AS BIGINT), 0) * 1e0)) AS name_us,
      epoch_us(make_timestamp(2000 + o_orderkey % 20, 1 + o_orderkey % 12, 1 + o_orderkey % 28, o_orderkey % 24, 0, 0)) AS tag_us
    FROM p""")
def parse_time(t):
    key = F.col("o_orderkey")
    tag = F.format_string("%04d:%02d:%02d %02d:00:00", 2000 + key % 20, 1 + key % 12, 1 + key % 28, key % 24)
    return t.fx_scene_names.select(
        "o_orderkey",
        F.unix_micros(text.parse_acquisition_time(no_tags(), F.col("stem"))).alias("name_us"),
        F.unix_micros(text.parse_acquisition_time(F.create_map(F.lit("DATETIME"), tag), F.col("stem"))).alias("tag_us"),
    )


@query("b02_detect_sensor_platform", """
    SELECT o_orderkey,
      CASE WHEN o_orderkey % 7 = 0 THEN 'TagSensor' WHEN contains(upper(stem), 'S2A') THEN 'Sentinel-2A MSI' WHEN contains(upper(stem), 'LC08') THEN 'Landsat-8 OLI/TIRS' ELSE 'unknown' END AS sensor,
      CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN contains(upper(stem), 'S2A') THEN 'Sentinel-2' WHEN contains(upper(stem), 'LC08') THEN 'Landsat-8' ELSE 'unknown' END AS platform
    FROM fx_scene_names""")
def sensor_platform(t):
    tags = F.when(F.col("o_orderkey") % 7 == 0, F.create_map(F.lit("instrument"), F.lit("TagSensor"))).otherwise(no_tags())
    found = text.detect_sensor_platform(tags, F.col("stem"))
    return t.fx_scene_names.select("o_orderkey", found["sensor"].alias("sensor"), found["platform"].alias("platform"))


@query("b03_scene_id", """
    SELECT o_orderkey, concat(regexp_replace(concat(stem, '.v 1'), '[^a-zA-Z0-9_-]', '_', 'g'), '_', substring(file_hash, 1, 8)) AS scene_id FROM fx_scene_names""")
def scene_ids(t):
    return t.fx_scene_names.select(
        "o_orderkey", text.scene_id(F.concat("stem", F.lit(".v 1")), F.col("file_hash")).alias("scene_id")
    )


@query("b04_is_synthetic", """
    SELECT o_orderkey, contains(lower(stem), 'demo') OR o_orderkey % 5 = 0 AS synthetic FROM fx_scene_names""")
def synthetic(t):
    tags = F.create_map(F.lit("IS_SYNTHETIC"), F.when(F.col("o_orderkey") % 5 == 0, "True").otherwise("0"))
    return t.fx_scene_names.select("o_orderkey", text.is_synthetic(F.col("stem"), tags).alias("synthetic"))


@query("b05_cloud_pct", """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 100) * 1e0 WHEN 1 THEN (o_orderkey % 90) * 1e0 ELSE NULL END AS cloud FROM fx_scene_names""")
def cloud(t):
    key = F.col("o_orderkey")
    tags = (
        F.when(key % 3 == 0, F.create_map(F.lit("CLOUD_COVER"), (key % 100).cast("string")))
        .when(key % 3 == 1, F.create_map(F.lit("cloud_cover"), (key % 90).cast("string")))
        .otherwise(F.create_map(F.lit("CLOUD_COVER"), F.lit("n/a")))
    )
    return t.fx_scene_names.select("o_orderkey", text.cloud_pct(tags).alias("cloud"))


@query("b06_tile_id", """
    SELECT l_orderkey, l_linenumber, l_suppkey, printf('tile_s%d_c%04d_r%04d_z%02d', l_orderkey, l_linenumber, l_suppkey, 14) AS tile_id FROM lineitem""")
def tile_ids(t):
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        text.tile_id(F.concat(F.lit("s"), F.col("l_orderkey")), F.col("l_linenumber"), F.col("l_suppkey"), F.lit(14)).alias("tile_id"),
    )


@query("b07_observation_id", """
    SELECT tile_id, concat('obs_', tile_id, '_', substring(sha256_hash, 1, 8)) AS observation_id FROM fx_tiles""")
def observation_ids(t):
    return t.fx_tiles.select("tile_id", text.observation_id(F.col("tile_id"), F.col("sha256_hash")).alias("observation_id"))


@query("b08_grid_key", """
    SELECT tile_id, printf('grid_lon%.2f_lat%.2f_c%04d_r%04d_z%d', round((min_lon + max_lon) / 2, 2), round((min_lat + max_lat) / 2, 2), tile_col, tile_row, 14) AS by_column,
      printf('grid_lon%.2f_lat%.2f_c%04d_r%04d_z%d', round((min_lon + max_lon) / 2, 2), round((min_lat + max_lat) / 2, 2), l_partkey, tile_row, 15) AS by_name,
      concat('geo_lon', CAST(round((min_lon + max_lon) / 2, 4) AS VARCHAR), '_lat', CAST(round((min_lat + max_lat) / 2, 4) AS VARCHAR)) AS by_center
    FROM fx_tiles""")
def grid_keys(t):
    none = F.lit(None).cast("bigint")
    corners = [F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    name = F.concat(F.lit("tile_x_c"), F.col("l_partkey"), F.lit("_r"), F.col("tile_row"), F.lit("_z15"))
    return t.fx_tiles.select(
        "tile_id",
        text.grid_key(*corners, F.col("tile_col"), F.col("tile_row"), F.col("zoom_level"), F.col("tile_id")).alias("by_column"),
        text.grid_key(*corners, none, none, none, name).alias("by_name"),
        text.grid_key(*corners, none, none, none, F.col("tile_id")).alias("by_center"),
    )


@query("b09_pair_id", """
    SELECT event_id, concat('pair_', observation_id, '__', series_id) AS pair_id, observation_id AS earlier, series_id AS later FROM fx_observations""")
def pair_ids(t):
    pair = text.pair_id(F.col("observation_id"), F.col("series_id"))
    parts = text.split_pair_id(F.col("pair_id"))
    return t.fx_observations.select("event_id", pair.alias("pair_id")).select(
        "event_id", "pair_id", parts["earlier"].alias("earlier"), parts["later"].alias("later")
    )


@query("b10_to_utc", "SELECT event_id, epoch_us(ts) AS us FROM events")
def utc(t):
    return t.table("events").select("event_id", times.micros(times.to_utc(F.col("ts"))).alias("us"))


@query("b11_separation", """
    SELECT o_orderkey, round(greatest(0e0, (epoch_us(TIMESTAMP '1996-01-01 00:00:30.5') - epoch_us(o_orderdate)) / 1e6), 2) AS seconds,
      round(greatest(0e0, (epoch_us(TIMESTAMP '1996-01-01 00:00:30.5') - epoch_us(o_orderdate)) / 1e6) / 3600e0, 2) AS hours,
      round(greatest(0e0, (epoch_us(TIMESTAMP '1996-01-01 00:00:30.5') - epoch_us(o_orderdate)) / 1e6) / 86400e0, 4) AS days FROM orders""")
def separations(t):
    gap = times.separation(times.to_utc(F.col("o_orderdate")), F.lit("1996-01-01 00:00:30.5").cast("timestamp"))
    return t.table("orders").select("o_orderkey", gap["seconds"].alias("seconds"), gap["hours"].alias("hours"), gap["days"].alias("days"))


def _second_box():
    shift = (F.col("event_id") % 15) * F.lit(0.01)
    return geo.box(F.col("min_lon") + shift, F.col("min_lat") + shift, F.col("max_lon") + shift, F.col("max_lat") + shift)


@query("b12_bbox_overlap", """
    WITH b AS (SELECT event_id, min_lon AS ax0, min_lat AS ay0, max_lon AS ax1, max_lat AS ay1,
        min_lon + (event_id % 15) * 0.01e0 AS bx0, min_lat + (event_id % 15) * 0.01e0 AS by0, max_lon + (event_id % 15) * 0.01e0 AS bx1, max_lat + (event_id % 15) * 0.01e0 AS by1 FROM fx_observations),
    i AS (SELECT *, greatest(ax0, bx0) AS x0, greatest(ay0, by0) AS y0, least(ax1, bx1) AS x1, least(ay1, by1) AS y1, (ax1 - ax0) * (ay1 - ay0) AS aa, (bx1 - bx0) * (by1 - by0) AS ba FROM b),
    j AS (SELECT *, x0 < x1 AND y0 < y1 AS ov, (x1 - x0) * (y1 - y0) AS ia FROM i)
    SELECT event_id, ov AS overlapping, CASE WHEN ov THEN round(ia, 8) ELSE 0e0 END AS area,
      CASE WHEN ov THEN round(least(1e0, ia / aa), 4) ELSE 0e0 END AS ratio_earlier, CASE WHEN ov THEN round(least(1e0, ia / ba), 4) ELSE 0e0 END AS ratio_later,
      CASE WHEN ov THEN round(least(1e0, ia / (aa + ba - ia)), 4) ELSE 0e0 END AS ratio_iou, CASE WHEN ov THEN round(least(1e0, ia / least(aa, ba)), 4) ELSE 0e0 END AS ratio_min,
      CASE WHEN ov THEN round(x0, 6) END AS shared_min_lon FROM j""")
def overlaps(t):
    o = geo.bbox_overlap(obs_box(), _second_box())
    return t.fx_observations.select("event_id", o.alias("o")).select(
        "event_id", "o.overlapping", "o.area", "o.ratio_earlier", "o.ratio_later", "o.ratio_iou", "o.ratio_min",
        F.col("o.bounds.min_lon").alias("shared_min_lon"),
    )


HAVERSINE = """round(6371000e0 * 2e0 * atan2(sqrt(sin(radians({lat2} - {lat1}) / 2e0) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2e0) ** 2),
      sqrt(1e0 - (sin(radians({lat2} - {lat1}) / 2e0) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2e0) ** 2))), 2)"""


@query("b13_haversine_m", "SELECT event_id, " + HAVERSINE.format(lon1="min_lon", lat1="min_lat", lon2="max_lon", lat2="(max_lat + (event_id % 9) * 0.3e0)") + " AS meters FROM fx_observations")
def distances(t):
    return t.fx_observations.select(
        "event_id",
        geo.haversine_m(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat") + (F.col("event_id") % 9) * F.lit(0.3)).alias("meters"),
    )


@query("b14_metric_bbox", """
    SELECT event_id, round((min_lon - 76e0) * 111320e0 * greatest(0.01e0, cos(radians(12e0))), 4) AS x0, round((min_lat - 12e0) * 110540e0, 4) AS y0,
      round((max_lon - 76e0) * 111320e0 * greatest(0.01e0, cos(radians(12e0))), 4) AS x1, round((max_lat - 12e0) * 110540e0, 4) AS y1 FROM fx_observations""")
def metric_boxes(t):
    m = geo.metric_bbox(obs_box(), F.lit(76.0), F.lit(12.0))
    return t.fx_observations.select("event_id", *[F.round(m[k], 4).alias(k) for k in ("x0", "y0", "x1", "y1")])


METRIC_IOU = """CASE WHEN greatest({a}.min_lon, {b}.min_lon) < least({a}.max_lon, {b}.max_lon) AND greatest({a}.min_lat, {b}.min_lat) < least({a}.max_lat, {b}.max_lat) THEN
      round(least(1e0, (least({a}.max_lon, {b}.max_lon) - greatest({a}.min_lon, {b}.min_lon)) * (least({a}.max_lat, {b}.max_lat) - greatest({a}.min_lat, {b}.min_lat)) /
        (({a}.max_lon - {a}.min_lon) * ({a}.max_lat - {a}.min_lat) + ({b}.max_lon - {b}.min_lon) * ({b}.max_lat - {b}.min_lat)
          - (least({a}.max_lon, {b}.max_lon) - greatest({a}.min_lon, {b}.min_lon)) * (least({a}.max_lat, {b}.max_lat) - greatest({a}.min_lat, {b}.min_lat)))), 4) ELSE 0e0 END"""


@query("b15_metric_iou", """
    WITH b AS (SELECT event_id, min_lon + (event_id % 15) * 0.01e0 AS min_lon, min_lat + (event_id % 15) * 0.01e0 AS min_lat, max_lon + (event_id % 15) * 0.01e0 AS max_lon, max_lat + (event_id % 15) * 0.01e0 AS max_lat FROM fx_observations)
    SELECT a.event_id, """ + METRIC_IOU.format(a="a", b="b") + " AS iou FROM fx_observations a JOIN b USING (event_id)")
def metric_ious(t):
    return t.fx_observations.select("event_id", geo.metric_iou(obs_box(), _second_box()).alias("iou"))


@query("b16_utm_epsg", """
    SELECT c_custkey, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INT) + 1 AS epsg
    FROM (SELECT c_custkey, (c_custkey * 7) % 360 - 180e0 AS lon, (c_custkey * 11) % 160 - 80e0 AS lat FROM customer)""")
def utm(t):
    key = F.col("c_custkey")
    return t.table("customer").select("c_custkey", geo.utm_epsg((key * 7) % 360 - F.lit(180.0), (key * 11) % 160 - F.lit(80.0)).alias("epsg"))


@query("b17_grid_compat", """
    WITH g AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'EPSG:32643' WHEN 1 THEN ' epsg:32643 ' WHEN 2 THEN 'EPSG:32644' END AS crs_b,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 10e0 + (c_custkey % 3) * 0.09e0 END AS gsd_b, (c_custkey % 6) * 0.004e0 AS dx FROM customer)
    SELECT c_custkey, coalesce(trim(upper(crs_b)) = 'EPSG:32643', false) AS crs, crs_b IS NOT NULL AND coalesce(abs(10e0 - gsd_b) / greatest(10e0, gsd_b) <= 0.01e0, true) AS gsd,
      crs_b IS NOT NULL AND dx < 0.01e0 AS transform,
      coalesce(trim(upper(crs_b)) = 'EPSG:32643', false) AND coalesce(abs(10e0 - gsd_b) / greatest(10e0, gsd_b) <= 0.01e0, true) AND dx < 0.01e0 AS compatible FROM g""")
def grids(t):
    key = F.col("c_custkey")
    crs = F.when(key % 4 == 0, "EPSG:32643").when(key % 4 == 1, " epsg:32643 ").when(key % 4 == 2, "EPSG:32644")
    gsd = F.when(key % 5 != 0, F.lit(10.0) + (key % 3) * F.lit(0.09))

    def grid(x):
        return F.array(x, F.lit(10.0), F.lit(0.0), F.lit(500.0), F.lit(0.0), F.lit(-10.0))

    g = geo.grid_compat(F.lit("EPSG:32643"), crs, F.lit(10.0), gsd, grid(F.lit(100.0)), grid(F.lit(100.0) + (key % 6) * F.lit(0.004)))
    return t.table("customer").select("c_custkey", g.alias("g")).select("c_custkey", "g.crs", "g.gsd", "g.transform", "g.compatible")


@query("b18_pixel_to_lonlat", """
    SELECT event_id, round(min_lon + (event_id % 512 + 0.5e0) / 512e0 * (max_lon - min_lon), 8) AS lon, round(max_lat - (event_id % 256 + 0.5e0) / 256e0 * (max_lat - min_lat), 8) AS lat,
      round(min_lon + (event_id % 512) / 512e0 * (max_lon - min_lon), 8) AS ul_lon, round(max_lat - (event_id % 256 + 1) / 256e0 * (max_lat - min_lat), 8) AS lr_lat FROM fx_observations""")
def lonlat(t):
    args = (F.col("event_id") % 256, F.col("event_id") % 512, F.lit(256.0), F.lit(512.0), obs_box())
    return t.fx_observations.select(
        "event_id",
        F.round(geo.pixel_to_lonlat(*args)["lon"], 8).alias("lon"),
        F.round(geo.pixel_to_lonlat(*args)["lat"], 8).alias("lat"),
        F.round(geo.pixel_to_lonlat(*args, offset="ul")["lon"], 8).alias("ul_lon"),
        F.round(geo.pixel_to_lonlat(*args, offset="lr")["lat"], 8).alias("lr_lat"),
    )


@query("b19_bbox_polygon", """
    SELECT vec_id, concat('{"type":"Polygon","coordinates":[[[', x0, ',', y0, '],[', x1, ',', y0, '],[', x1, ',', y1, '],[', x0, ',', y1, '],[', x0, ',', y0, ']]]}') AS geometry
    FROM (SELECT vec_id, CAST(vec_id % 90 + 0.25e0 AS VARCHAR) AS x0, CAST(vec_id % 45 + 0.5e0 AS VARCHAR) AS y0, CAST(vec_id % 90 + 1.25e0 AS VARCHAR) AS x1, CAST(vec_id % 45 + 2.5e0 AS VARCHAR) AS y1 FROM embeddings)""")
def polygons(t):
    lon, lat = F.col("vec_id") % 90, F.col("vec_id") % 45
    b = geo.box(lon + F.lit(0.25), lat + F.lit(0.5), lon + F.lit(1.25), lat + F.lit(2.5))
    return t.table("embeddings").select("vec_id", geo.bbox_polygon(b).alias("geometry"))


@query("b20_content_id", """
    SELECT event_id, concat('res_', substring(sha256(concat_ws(':', series_id, observation_id, CAST(event_id AS VARCHAR))), 1, 16)) AS id,
      concat_ws(';', least(series_id, observation_id), greatest(series_id, observation_id)) AS ids FROM fx_observations""")
def content_ids(t):
    return t.fx_observations.select(
        "event_id",
        text.content_id("res_", F.col("series_id"), F.col("observation_id"), F.col("event_id")).alias("id"),
        text.sorted_ids(F.array("series_id", "observation_id")).alias("ids"),
    )


@query("b21_band_lookup", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 256) * 1e0 ELSE (o_orderkey % 100) / 100e0 END AS raw,
      CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 256 > 1 THEN (o_orderkey % 256) / 255e0 ELSE (o_orderkey % 256) * 1e0 END ELSE (o_orderkey % 100) / 100e0 END AS red, CAST(NULL AS DOUBLE) AS swir FROM orders""")
def bands(t):
    key = F.col("o_orderkey")
    raw = F.when(key % 2 == 0, (key % 256) * F.lit(1.0)).otherwise((key % 100) / F.lit(100.0))
    means = F.create_map(F.when(key % 3 == 0, "Red").otherwise("B04"), F.col("raw"))
    return t.table("orders").select("o_orderkey", raw.alias("raw")).select(
        "o_orderkey", "raw",
        text.band_lookup(means, ("red", "b04", "b4")).alias("red"),
        text.band_lookup(means, ("swir", "swir1", "b11")).alias("swir"),
    )


@query("b22_quality_meta", """
    SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 50 > 1 THEN (event_id % 50) / 100e0 ELSE (event_id % 50) * 1e0 END ELSE (event_id % 50) * 0.01e0 END AS cloud,
      1e0 - (event_id % 21) * 0.01e0 AS valid, event_id % 4 <> 3 AS known FROM events""")
def quality(t):
    key = F.col("event_id")
    meta = F.map_from_arrays(
        F.array(F.when(key % 2 == 0, "cloud_cover_percentage").otherwise("cloud_ratio"), F.lit("data_coverage")),
        F.array(
            F.when(key % 4 == 3, None).when(key % 2 == 0, (key % 50).cast("string")).otherwise(((key % 50) * F.lit(0.01)).cast("string")),
            (F.lit(1.0) - (key % 21) * F.lit(0.01)).cast("string"),
        ),
    )
    q = text.quality_meta(meta)
    return t.table("events").select("event_id", q["cloud"].alias("cloud"), q["valid"].alias("valid"), q["known"].alias("known"))


@query("b23_bbox_extent", """
    SELECT event_id, round(abs(max_lon - min_lon), 5) AS lon_span, round(abs(max_lat - min_lat), 5) AS lat_span,
      round((min_lon + max_lon) / 2, 5) AS center_lon, round((min_lat + max_lat) / 2, 5) AS center_lat FROM fx_observations""")
def extents(t):
    return t.fx_observations.select("event_id", geo.bbox_extent(obs_box()).alias("e")).select("event_id", "e.*")


@query("b24_normalize_decision", """
    SELECT event_id, CASE WHEN upper(trim(decision)) IN ('CONFIRM', 'CONFIRMED') THEN 'CONFIRMED' WHEN upper(trim(decision)) IN ('REJECT', 'REJECTED') THEN 'REJECTED' ELSE 'PENDING' END AS decision FROM fx_reviews""")
def decisions(t):
    return t.fx_reviews.select("event_id", text.normalize_decision(F.col("decision")).alias("decision"))


@query("b25_canonical_json", """
    SELECT event_id, concat('{"analystNote":"', note, '","candidateRegionId":"', region_id, '","decision":"', decision, '","investigationId":"', investigation_id, '","previousDecision":"","revisionNumber":1}') AS json FROM fx_reviews""")
def canonical(t):
    body = text.canonical_json(
        investigationId=F.col("investigation_id"), candidateRegionId=F.col("region_id"), decision=F.col("decision"),
        analystNote=F.col("note"), previousDecision=F.lit(None).cast("string"), revisionNumber=F.lit(1),
    )
    return t.fx_reviews.select("event_id", body.alias("json"))


@query("b26_band_names", """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND 1 + c_custkey % 4 = 3 THEN 'Red,Green,Blue' WHEN c_custkey % 2 = 0 AND 1 + c_custkey % 4 = 4 THEN 'Red,Green,Blue,Alpha'
      ELSE concat_ws(',', 'nir', CASE WHEN 1 + c_custkey % 4 >= 2 THEN 'Band_2' END, CASE WHEN 1 + c_custkey % 4 >= 3 THEN 'Band_3' END, CASE WHEN 1 + c_custkey % 4 >= 4 THEN 'Band_4' END) END AS names FROM customer""")
def names(t):
    key = F.col("c_custkey")
    found = text.band_names(F.array(F.lit("nir"), F.lit("")), 1 + key % 4, key % 2 == 0)
    return t.table("customer").select("c_custkey", F.array_join(found, ",").alias("names"))


@query("b27_ground_resolution", """
    SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 10e0 END, CASE WHEN o_orderkey % 5 = 0 THEN 30e0 END, CASE WHEN (o_orderkey % 20) / 10e0 > 0.1e0 THEN ((o_orderkey % 20) / 10e0 + 1e0) / 2e0 END) AS meters,
      round(7e0 * coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 10e0 END, CASE WHEN o_orderkey % 5 = 0 THEN 30e0 END, CASE WHEN (o_orderkey % 20) / 10e0 > 0.1e0 THEN ((o_orderkey % 20) / 10e0 + 1e0) / 2e0 END) ** 2, 2) AS area_m2 FROM orders""")
def resolutions(t):
    key = F.col("o_orderkey")
    m = geo.ground_resolution(F.when(key % 3 == 0, 10.0), F.when(key % 5 == 0, 30.0), (key % 20) / F.lit(10.0), F.lit(-1.0))
    return t.table("orders").select("o_orderkey", m.alias("meters")).withColumn("area_m2", F.round(F.lit(7.0) * F.col("meters") * F.col("meters"), 2))
