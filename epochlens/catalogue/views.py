"""Derived views over the given tables, defined once for Spark and for SQL.

Only arithmetic on ids, CASE and concat, so both engines build identical inputs over whole tables.
`SHA(x)` and `MICROS(x)` stand for functions the engines name differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

OBSERVATIONS = [
    ("concat('obs_', CAST(event_id AS STRING))", "observation_id"),
    ("concat('series_', CAST(user_id AS STRING))", "series_id"),
    ("event_id", "event_id"),
    ("CAST(ts AS TIMESTAMP)", "acquisition_time"),
    ("CASE event_type WHEN 'view' THEN 'Sentinel-2A MSI' WHEN 'click' THEN 'sentinel-2a msi' WHEN 'purchase' THEN 'Landsat-8 OLI' ELSE 'unknown' END", "sensor"),
    ("CASE WHEN event_type IN ('view','click') THEN 'Sentinel-2' WHEN event_type = 'purchase' THEN 'Landsat-8' ELSE 'unknown' END", "platform"),
    ("76e0 + (user_id % 20) * 0.2e0 + (event_id % 7) * 0.01e0", "min_lon"),
    ("12e0 + floor(user_id / 20) * 0.2e0 + (event_id % 5) * 0.02e0", "min_lat"),
    ("76.1e0 + (user_id % 20) * 0.2e0 + (event_id % 7) * 0.01e0", "max_lon"),
    ("12.1e0 + floor(user_id / 20) * 0.2e0 + (event_id % 5) * 0.02e0", "max_lat"),
    ("CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 50) * 0.01e0 END", "cloud_fraction"),
    ("1e0 - (event_id % 21) * 0.01e0", "valid_pixel_ratio"),
    ("SHA(concat('obs:', CAST(event_id AS STRING)))", "source_hash"),
]

REGIONS = [
    ("concat('pair_', CAST(o_custkey AS STRING))", "pair_id"),
    ("concat('reg_', CAST(o_orderkey AS STRING))", "region_id"),
    ("o_orderkey", "o_orderkey"),
    ("1 + o_orderkey % 397", "area_px"),
    ("((o_orderkey * 37) % 101) / 100e0", "rectangularity"),
    ("((o_orderkey * 53) % 101) / 100e0", "compactness"),
    ("((o_orderkey * 71) % 101) / 100e0", "linearity_score"),
    ("1e0 + ((o_orderkey * 29) % 90) / 10e0", "aspect_ratio"),
    ("1e0 + ((o_orderkey * 59) % 80) / 10e0", "axis_ratio"),
    ("((o_orderkey * 13) % 120) / 1e0", "major_axis"),
    ("((o_orderkey * 17) % 61) / 1e0", "minor_axis"),
    ("((o_orderkey * 19) % 61 - 30) / 100e0", "brightness_delta"),
    ("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ((o_orderkey * 23) % 51) / 100e0 END", "contrast"),
    ("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ((o_orderkey * 31) % 81 - 40) / 100e0 END", "ndvi_delta"),
    ("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ((o_orderkey * 47) % 101) / 100e0 END", "ndvi_mean"),
    ("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ((o_orderkey * 61) % 81 - 40) / 100e0 END", "ndwi_mean"),
    ("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ((o_orderkey * 43) % 101) / 100e0 END", "water_fraction"),
    ("((o_orderkey * 67) % 61) / 103e0", "surrounding_change"),
    ("((o_orderkey * 73) % 101) / 100e0", "mean_score"),
    ("((o_orderkey * 79) % 51) / 100e0", "score_std"),
    ("o_orderkey % 3 <> 0", "has_wavelength"),
    ("o_orderkey % 37 <> 0", "spectral_available"),
    ("o_orderkey % 11 <> 0", "context_available"),
]

# Later-date band means and scene hints, for screening.
SIGNALS = [
    ("concat('pair_', CAST(o_custkey AS STRING))", "pair_id"),
    ("concat('reg_', CAST(o_orderkey AS STRING))", "region_id"),
    ("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ((o_orderkey * 11) % 97) / 100e0 END", "blue"),
    ("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ((o_orderkey * 11) % 97) / 100e0 + (o_orderkey % 3) * 0.01e0 END", "green"),
    ("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ((o_orderkey * 11) % 97) / 100e0 + (o_orderkey % 5) * 0.01e0 END", "red"),
    ("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ((o_orderkey * 7) % 31) / 100e0 END", "nir"),
    ("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ((o_orderkey * 41) % 89) / 100e0 END", "swir"),
    ("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ((o_orderkey * 3) % 29) / 1000e0 END", "cirrus"),
    ("CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE (o_orderkey % 360) * 1e0 END", "solar_azimuth"),
    ("o_orderkey % 4", "cloud_candidates"),
    ("o_orderkey % 17 = 0", "ray_aligned"),
    ("o_orderkey % 19 = 0", "haze"),
    ("((o_orderkey * 83) % 101) / 100e0", "edge_overlap"),
    ("o_orderkey % 2 = 1", "dipole"),
    ("o_orderkey % 23 = 0", "parallax"),
    ("o_orderkey % 29 = 0", "noise_spike"),
    ("((o_orderkey * 89) % 51) / 100e0", "tile_median"),
    ("o_orderkey % 31 = 0", "gain_shift"),
    ("o_custkey % 5 = 0", "cross_sensor"),
    ("o_orderkey % 41 = 0", "unknown_artifact"),
]

REGION_BOXES = [
    ("concat('pair_', CAST(o_custkey AS STRING))", "pair_id"),
    ("o_orderkey", "region_num"),
    ("concat('reg_', CAST(o_orderkey AS STRING))", "region_id"),
    ("77e0 + (o_custkey % 50) * 0.01e0 + (o_orderkey % 4) * 0.0002e0", "min_lon"),
    ("12e0 + (o_custkey % 40) * 0.01e0 + (o_orderkey % 3) * 0.0002e0", "min_lat"),
    ("77.001e0 + (o_custkey % 50) * 0.01e0 + (o_orderkey % 4) * 0.0002e0", "max_lon"),
    ("12.001e0 + (o_custkey % 40) * 0.01e0 + (o_orderkey % 3) * 0.0002e0", "max_lat"),
]

# One candidate per customer and pair, a little off the regions.
CANDIDATES = [
    ("concat('cand_', CAST(c_custkey AS STRING))", "candidate_id"),
    ("concat('pair_', CAST(c_custkey AS STRING))", "pair_id"),
    ("77e0 + (c_custkey % 50) * 0.01e0 + (c_custkey % 7) * 0.0003e0", "min_lon"),
    ("12e0 + (c_custkey % 40) * 0.01e0 + (c_custkey % 3) * 0.0002e0", "min_lat"),
    ("77.001e0 + (c_custkey % 50) * 0.01e0 + (c_custkey % 7) * 0.0003e0", "max_lon"),
    ("12.001e0 + (c_custkey % 40) * 0.01e0 + (c_custkey % 3) * 0.0002e0", "max_lat"),
]

REVIEWS = [
    ("concat('inv_', CAST(user_id AS STRING))", "investigation_id"),
    ("concat('reg_', CAST(event_id % 3 AS STRING))", "region_id"),
    ("event_id", "event_id"),
    ("CAST(ts AS TIMESTAMP)", "ts"),
    ("CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'REJECTED' ELSE 'maybe' END", "decision"),
    ("CASE WHEN value > 100e0 THEN 'large' ELSE '' END", "note"),
    ("''", "reason"),
]

SCENE_NAMES = [
    ("o_orderkey", "o_orderkey"),
    ("concat(CASE o_orderkey % 4 WHEN 0 THEN 'S2A_' WHEN 1 THEN 'LC08_' WHEN 2 THEN 'demo_' ELSE 'x_' END, replace(substring(CAST(o_orderdate AS STRING), 1, 10), '-', ''), CASE WHEN o_orderkey % 2 = 0 THEN 'T101530' ELSE '' END)", "stem"),
    ("SHA(concat('file:', CAST(o_orderkey AS STRING)))", "file_hash"),
]

SCENES = [
    ("concat('scene_', CAST(o_orderkey AS STRING))", "scene_id"),
    ("CASE o_orderkey % 4 WHEN 0 THEN 'Sentinel-2A MSI' WHEN 1 THEN 'Landsat-8 OLI/TIRS' WHEN 2 THEN 'Sentinel-2B MSI' ELSE 'unknown' END", "sensor"),
    ("CASE o_orderkey % 4 WHEN 0 THEN 'Sentinel-2' WHEN 1 THEN 'Landsat-8' WHEN 2 THEN 'Sentinel-2' ELSE 'unknown' END", "platform"),
    ("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END", "acquisition_time"),
    ("CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 100) * 1e0 END", "cloud_cover_percentage"),
    ("SHA(concat('file:', CAST(o_orderkey AS STRING)))", "file_hash"),
    ("CAST(o_orderdate AS TIMESTAMP)", "created_at"),
    ("o_custkey", "o_custkey"),
]

TILES = [
    ("concat('tile_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING))", "tile_id"),
    ("concat('scene_', CAST(l_orderkey AS STRING))", "source_scene_id"),
    ("CAST(l_linenumber AS BIGINT)", "tile_col"),
    ("l_suppkey % 4", "tile_row"),
    ("14", "zoom_level"),
    ("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) END", "acquisition_time"),
    ("CASE WHEN l_partkey % 2 = 0 THEN 'unknown' ELSE 'Sentinel-2A MSI' END", "sensor"),
    ("70e0 + (l_suppkey % 40) * 0.5e0", "min_lon"),
    ("10e0 + (l_partkey % 40) * 0.5e0", "min_lat"),
    ("70.25e0 + (l_suppkey % 40) * 0.5e0", "max_lon"),
    ("10.25e0 + (l_partkey % 40) * 0.5e0", "max_lat"),
    ("SHA(concat('tile:', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)))", "sha256_hash"),
    ("CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount * 10e0 END", "valid_pixel_ratio"),
    ("l_partkey", "l_partkey"),
    ("l_extendedprice", "l_extendedprice"),
]

# One timeline node per event: candidate = user, in time order.
NODES = [
    ("concat('cand_', CAST(user_id AS STRING))", "candidate_id"),
    ("concat('obs_', CAST(event_id AS STRING))", "observation_id"),
    ("event_id", "event_id"),
    ("CAST(ts AS TIMESTAMP)", "acquisition_time"),
    ("CASE event_type WHEN 'view' THEN 'Sentinel-2A MSI' WHEN 'click' THEN 'sentinel-2a msi' WHEN 'purchase' THEN 'Landsat-8 OLI' ELSE 'unknown' END", "sensor"),
    ("event_id % 50 = 7", "is_simultaneous"),
    ("event_id % 9 = 0", "is_pre"),
    ("event_id % 17 <> 3", "has_pair"),
    ("CASE event_id % 8 WHEN 0 THEN 'suppressed' WHEN 1 THEN 'flagged' WHEN 2 THEN 'insufficient_evidence' WHEN 3 THEN NULL ELSE 'retained' END", "decision"),
    ("CASE WHEN event_id % 6 = 0 THEN 0.1e0 ELSE ((event_id * 37) % 101) / 100e0 END", "iou"),
    ("CASE WHEN event_id % 10 = 0 THEN NULL ELSE ((event_id * 29) % 150) / 1e0 END", "distance_m"),
    ("((event_id * 41) % 101) / 103e0", "change_score"),
    ("CASE WHEN event_id % 12 = 0 THEN NULL ELSE ((event_id * 43) % 101) / 100e0 END", "class_score"),
    ("CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'uncertain' END", "class_tier"),
    ("CASE WHEN user_id % 2 = 0 AND event_id % 7 < 2 THEN 'clearance' WHEN event_id % 7 < 3 THEN 'unknown' WHEN user_id % 10 = 0 AND event_id % 7 = 5 THEN 'water_extent_change' ELSE 'construction' END", "category"),
    ("CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 50) * 0.01e0 END", "cloud_fraction"),
    ("1e0 - (event_id % 21) * 0.01e0", "valid_pixel_ratio"),
    ("user_id", "user_id"),
]

# One row per investigation (customer) and pair (order), with the ids derived from the pair.
STAGES = [
    ("concat('inv_', CAST(o_custkey AS STRING))", "investigation_id"),
    ("concat('series_', CAST(o_custkey % 50 AS STRING))", "series_id"),
    ("concat('pair_obs_', CAST(o_orderkey AS STRING), '__obs_', CAST(o_orderkey + 1 AS STRING))", "pair_id"),
    ("concat('pair_obs_', CAST(o_custkey AS STRING), '__obs_', CAST(o_custkey + 1 AS STRING))", "discovery_pair_id"),
    ("concat('reg_', CAST(o_custkey % 5 AS STRING))", "region_id"),
    ("concat('scene_', CAST(o_orderkey AS STRING))", "scene_id"),
    ("concat('tile_', CAST(o_orderkey % 1000 AS STRING))", "tile_id"),
    ("concat('obs_', CAST(o_orderkey + 1 AS STRING))", "observation_id"),
    ("CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('res_', CAST(o_orderkey AS STRING)) END", "result_id"),
    ("CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('evi_', CAST(o_orderkey AS STRING)) END", "evidence_id"),
    ("concat('cls_', CAST(o_orderkey AS STRING))", "classification_id"),
    ("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('sup_', CAST(o_orderkey AS STRING)) END", "suppression_id"),
    ("concat('tem_', CAST(o_custkey AS STRING))", "timeline_id"),
    ("concat('dossier_', CAST(o_custkey AS STRING))", "dossier_id"),
    ("CAST(o_orderdate AS TIMESTAMP)", "acquisition_time"),
    ("o_orderkey", "o_orderkey"),
    ("o_custkey", "o_custkey"),
]

HASHES = [
    ("concat('inv_', CAST(o_custkey AS STRING))", "investigation_id"),
    ("CASE WHEN o_orderkey % 2 = 0 THEN 'earlier' ELSE 'later' END", "key"),
    ("o_orderkey", "position"),
    ("SHA(concat('src:', CAST(o_orderkey AS STRING)))", "hash"),
]

TABLE_OF = {
    "fx_stages": ("orders", STAGES),
    "fx_hashes": ("orders", HASHES),
    "fx_observations": ("events", OBSERVATIONS),
    "fx_regions": ("orders", REGIONS),
    "fx_signals": ("orders", SIGNALS),
    "fx_region_boxes": ("orders", REGION_BOXES),
    "fx_candidates": ("customer", CANDIDATES),
    "fx_reviews": ("events", REVIEWS),
    "fx_scene_names": ("orders", SCENE_NAMES),
    "fx_scenes": ("orders", SCENES),
    "fx_tiles": ("lineitem", TILES),
    "fx_nodes": ("events", NODES),
}

# Each 64-value vector is a raster of 4 bands of 4 x 4 pixels; vectors 2k and 2k+1 are the two dates of pair k.
EXTRA_SQL = {
    "fx_pixels": """
        SELECT CAST(floor(vec_id / 2) AS BIGINT) AS pair_num, vec_id % 2 AS epoch, CAST(floor(pos / 16) AS INT) AS band,
          CAST(floor((pos % 16) / 4) AS INT) AS r, CAST(pos % 4 AS INT) AS c,
          CASE WHEN (vec_id + pos) % 29 = 0 THEN -99e0 WHEN (vec_id + pos) % 31 = 7 THEN -98e0 ELSE CAST(v AS DOUBLE) END AS value
        FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""",
    "fx_grid8": """
        SELECT vec_id, CAST(floor(pos / 8) AS INT) AS r, CAST(pos % 8 AS INT) AS c, CAST(v AS DOUBLE) AS value
        FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""",
    "fx_px": """
        SELECT e.pair_num AS pair_id, e.r, e.c, e.band, e.value AS e, l.value AS l
        FROM fx_pixels e JOIN fx_pixels l ON e.pair_num = l.pair_num AND e.r = l.r AND e.c = l.c AND e.band = l.band AND e.epoch = 0 AND l.epoch = 1""",
    "fx_valid": "SELECT pair_id, r, c, bool_and(e <> -99 AND e <> -98 AND l <> -99 AND l <> -97) AS valid FROM fx_px GROUP BY ALL",
    "fx_range": """
        SELECT pair_id, band, quantile_cont(e, 0.02) AS el, quantile_cont(e, 0.98) AS eh, quantile_cont(l, 0.02) AS ll, quantile_cont(l, 0.98) AS lh
        FROM fx_px JOIN fx_valid USING (pair_id, r, c) WHERE valid GROUP BY ALL""",
    "fx_score": """
        SELECT pair_id, r, c, valid, CASE WHEN valid THEN avg(abs(
            CASE WHEN lh > ll THEN least(1e0, greatest(0e0, (l - ll) / (lh - ll))) ELSE 0e0 END
          - CASE WHEN eh > el THEN least(1e0, greatest(0e0, (e - el) / (eh - el))) ELSE 0e0 END)) ELSE 0e0 END AS score
        FROM fx_px JOIN fx_valid USING (pair_id, r, c) JOIN fx_range USING (pair_id, band) GROUP BY pair_id, r, c, valid""",
    "fx_threshold": """
        SELECT pair_id, CASE WHEN max(score) > 0 THEN least(1e0, greatest(0e0, avg(score) + 0.5e0 * stddev_pop(score))) END AS threshold
        FROM fx_score WHERE valid GROUP BY pair_id""",
    "fx_changed": """
        SELECT pair_id, r, c, score FROM fx_score JOIN fx_threshold USING (pair_id) WHERE valid AND score > 0 AND score >= threshold""",
    "fx_reach": """
        SELECT pair_id, r, c, r * 4294967296 + c AS seed FROM fx_changed
        UNION
        SELECT p.pair_id, p.r, p.c, q.seed FROM fx_reach q JOIN fx_changed p ON p.pair_id = q.pair_id AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1""",
    "fx_label": """
        SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY pair_id, label) AS area FROM (SELECT pair_id, r, c, min(seed) AS label FROM fx_reach GROUP BY ALL)) WHERE area >= 2""",
    "fx_region_name": """
        SELECT pair_id, label, printf('reg_%04d', row_number() OVER (PARTITION BY pair_id ORDER BY count(*) DESC, min(r), min(c), label)) AS region_id FROM fx_label GROUP BY pair_id, label""",
    "fx_member": """
        SELECT pair_id, region_id, r, c, score FROM fx_label JOIN fx_region_name USING (pair_id, label) JOIN fx_score USING (pair_id, r, c)""",
    "fx_vectors": """
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings""",
}


def _spark_expr(text: str) -> str:
    return re.sub(r"SHA\((.*)\)$", r"sha2(\1, 256)", text)


def _sql_expr(text: str) -> str:
    return re.sub(r"SHA\((.*)\)$", r"sha256(\1)", text)


def sql_definitions() -> dict[str, str]:
    out = {
        name: "SELECT " + ", ".join(f"{_sql_expr(e)} AS {a}" for e, a in exprs) + f" FROM {table}"
        for name, (table, exprs) in TABLE_OF.items()
    }
    out.update(EXTRA_SQL)
    return out


def spark_view(tables, name: str) -> DataFrame:
    if name in TABLE_OF:
        table, exprs = TABLE_OF[name]
        return tables.table(table).selectExpr(*[f"{_spark_expr(e)} AS {a}" for e, a in exprs])
    if name == "fx_vectors":
        return tables.table("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    if name == "fx_grid8":
        return tables.table("embeddings").select(
            "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value")
        ).select(
            "vec_id", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), "value"
        )
    if name == "fx_rasters":
        # Raster store: one row per observation and block, bands x (height*width) values.
        raw = F.col("embedding").cast("array<double>")
        v = F.transform(raw, lambda x, i: F.when((F.col("vec_id") + i) % 29 == 0, -99.0).when((F.col("vec_id") + i) % 31 == 7, -98.0).otherwise(x))
        return tables.table("embeddings").select(
            F.col("vec_id").alias("obs_id"),
            F.lit(0).alias("row0"), F.lit(0).alias("col0"), F.lit(4).alias("height"), F.lit(4).alias("width"),
            F.array(*[F.slice(v, 1 + 16 * b, 16) for b in range(4)]).alias("bands"),
            # Each date has a nodata value of its own; -98 is a value like others in a later raster.
            F.when(F.col("vec_id") % 2 == 0, -98.0).otherwise(-97.0).alias("nodata"),
        )
    if name == "fx_raster_pairs":
        ids = tables.table("embeddings").select("vec_id", F.floor(F.col("vec_id") / 2).alias("pair_id"))
        return ids.groupBy("pair_id").agg(F.min("vec_id").alias("earlier_id"), F.max("vec_id").alias("later_id"))
    if name == "fx_frames":
        pair = F.col("pair_id")
        return tables.fx_raster_pairs.select(
            "pair_id", F.lit(4).alias("frame_height"), F.lit(4).alias("frame_width"),
            (F.lit(70.0) + (pair % 50) * F.lit(0.1)).alias("min_lon"), (F.lit(10.0) + (pair % 30) * F.lit(0.1)).alias("min_lat"),
            (F.lit(70.04) + (pair % 50) * F.lit(0.1)).alias("max_lon"), (F.lit(10.04) + (pair % 30) * F.lit(0.1)).alias("max_lat"),
            F.lit(10.0).alias("resolution_m"),
        )
    raise AttributeError(name)
