"""Region evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalogue import pixels as chain
from epochlens.catalogue.registry import query
from epochlens.config import EvidenceConfig
from epochlens.operators import evidence, pixels

CONFIG = EvidenceConfig(buffer_px=1, min_context_pixels=4, band_roles={"red": 0, "green": 1, "nir": 2, "swir": 3})
NAMES = ["Red", "Green", "Band_3", "B11"]


def regions(t, members=None):
    return pixels.region_stats(chain.members(t) if members is None else members, t.fx_frames)


def spectra(t, members=None):
    run = chain.detection(t)
    return evidence.region_spectra(run.members if members is None else members, run.aligned, 4, -99.0)


BOX = """fx_box AS (SELECT pair_id, region_id, count(*) AS area, min(r) AS r0, min(c) AS c0, max(r) AS r1, max(c) AS c1, avg(score) AS s, max(score) AS mx, stddev_pop(score) AS sd FROM fx_member GROUP BY pair_id, region_id)"""
PERIMETER = """fx_perimeter AS (SELECT m.pair_id, m.region_id, greatest(1, count(*) FILTER (n < 4)) AS p FROM (
    SELECT a.pair_id, a.region_id, a.r, a.c, count(b.r) AS n FROM fx_member a LEFT JOIN fx_member b ON a.pair_id = b.pair_id AND a.region_id = b.region_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL) m GROUP BY ALL)"""


@query("j01_region_perimeter", f"WITH {PERIMETER} SELECT pair_id, region_id, p AS perimeter_px FROM fx_perimeter")
def perimeter(t):
    return evidence.region_perimeter(chain.members(t))


@query("j02_shape_descriptors", f"""
    WITH {BOX}, {PERIMETER} SELECT pair_id, region_id, area AS area_px, c1 - c0 + 1 AS width_px, r1 - r0 + 1 AS height_px, p * 1e0 AS perimeter_px, round(greatest(c1 - c0 + 1, r1 - r0 + 1) / least(c1 - c0 + 1, r1 - r0 + 1), 4) AS aspect_ratio,
      round(least(1e0, 4e0 * pi() * area / (p * p)), 4) AS compactness, round(area / ((c1 - c0 + 1) * (r1 - r0 + 1)), 4) AS rectangularity, round(least(1e0, 2e0 * sqrt(pi() * area) / p), 4) AS shape_regularity,
      round(p / sqrt(area), 4) AS fragmentation, least(r0, 3 - r1, c0, 3 - c1) * 1e0 AS border_distance_px FROM fx_box JOIN fx_perimeter USING (pair_id, region_id)""")
def shape(t):
    members = chain.members(t)
    return evidence.shape_descriptors(regions(t, members), evidence.region_perimeter(members))


@query("j03_moments", """
    WITH m AS (SELECT pair_id, region_id, count(*) AS n, var_pop(c) AS xx, var_pop(r) AS yy, 0e0 - covar_pop(c, r) AS xy FROM fx_member GROUP BY pair_id, region_id),
    e AS (SELECT *, greatest(0e0, (xx + yy + sqrt((xx - yy) ** 2 + 4e0 * xy * xy)) / 2e0) AS big, greatest(0e0, (xx + yy - sqrt((xx - yy) ** 2 + 4e0 * xy * xy)) / 2e0) AS small FROM m)
    SELECT pair_id, region_id, round(4e0 * sqrt(big), 2) AS major_axis, round(4e0 * sqrt(small), 2) AS minor_axis, round((big - small) / (big + small), 4) AS linearity_score, round(degrees(0.5e0 * atan2(if(abs(xy) < 1e-9, 0e0, 2e0 * xy), if(abs(xx - yy) < 1e-9, 0e0, xx - yy))), 2) AS orientation_deg FROM e""")
def moments(t):
    return evidence.moments(chain.members(t)).drop("axis_ratio")


@query("j04_spectral_means", """
    WITH px AS (SELECT m.pair_id, m.region_id, x.band, x.e, x.l FROM fx_member m JOIN fx_px x USING (pair_id, r, c)),
    a AS (SELECT pair_id, region_id, band, avg(e) AS e, avg(l) AS l FROM px GROUP BY ALL)
    SELECT pair_id, region_id, n.name, n.is_band, round(e, 4) AS earlier, round(l, 4) AS later, round(l - e, 4) AS delta, round(abs(l - e), 4) AS abs_delta
    FROM a JOIN (VALUES ('Red', 0, true), ('Green', 1, true), ('Band_3', 2, true), ('B11', 3, true), ('red', 0, false), ('green', 1, false), ('nir', 2, false), ('swir', 3, false)) n(name, band, is_band) USING (band)""")
def means(t):
    return evidence.spectral_means(spectra(t), NAMES, CONFIG.band_roles)


INDICES = """fx_wide AS (SELECT m.pair_id, m.region_id, m.r, m.c, max(e) FILTER (band = 0) AS er, max(l) FILTER (band = 0) AS lr, max(l) FILTER (band = 1) AS lg, max(e) FILTER (band = 2) AS en, max(l) FILTER (band = 2) AS ln
    FROM fx_member m JOIN fx_px x USING (pair_id, r, c) GROUP BY ALL)"""


@query("j05_ndvi", f"""
    WITH {INDICES} SELECT pair_id, region_id, round(avg((ln - lr) / greatest(1e-6, ln + lr)), 4) AS ndvi_mean, round(avg((ln - lr) / greatest(1e-6, ln + lr) - (en - er) / greatest(1e-6, en + er)), 4) AS ndvi_delta FROM fx_wide GROUP BY ALL""")
def ndvi(t):
    return evidence.spectral_indices(spectra(t), CONFIG).select("pair_id", "region_id", "ndvi_mean", "ndvi_delta")


@query("j06_ndwi", f"""
    WITH {INDICES} SELECT pair_id, region_id, round(avg((lg - ln) / greatest(1e-6, lg + ln)), 4) AS ndwi_mean, round(avg(CASE WHEN (lg - ln) / greatest(1e-6, lg + ln) > 0 THEN 1e0 ELSE 0e0 END), 4) AS water_fraction FROM fx_wide GROUP BY ALL""")
def ndwi(t):
    return evidence.spectral_indices(spectra(t), CONFIG).select("pair_id", "region_id", "ndwi_mean", "water_fraction")


@query("j07_brightness_delta", """
    SELECT pair_id, region_id, round(avg(d), 4) AS brightness_delta FROM (SELECT m.pair_id, m.region_id, band, round(avg(l) - avg(e), 4) AS d FROM fx_member m JOIN fx_px x USING (pair_id, r, c) WHERE band < 3 GROUP BY ALL) GROUP BY ALL""")
def brightness(t):
    return evidence.brightness_delta(evidence.spectral_means(spectra(t), NAMES, CONFIG.band_roles))


@query("j08_context_contrast", f"""
    WITH {BOX}, bg AS (SELECT s.* FROM fx_score s ANTI JOIN fx_member m USING (pair_id, r, c)),
    a AS (SELECT b.pair_id, b.region_id, count(bg.r) AS n, avg(bg.score) AS mean, any_value(round(b.s, 4)) AS s FROM fx_box b LEFT JOIN bg ON bg.pair_id = b.pair_id AND bg.r BETWEEN r0 - 1 AND r1 + 1 AND bg.c BETWEEN c0 - 1 AND c1 + 1 GROUP BY ALL)
    SELECT pair_id, region_id, n AS context_pixels, n >= 4 AS context_available, CASE WHEN n >= 4 THEN round(mean, 4) END AS surrounding_change, CASE WHEN n >= 4 THEN round(abs(s - mean), 4) END AS contrast FROM a""")
def context(t):
    run = chain.detection(t)
    return evidence.context_contrast(run.scored, run.members, regions(t, run.members), CONFIG, block=4)


@query("j08_background_means", f"""
    WITH {BOX}, bg AS (SELECT p.* FROM fx_px p ANTI JOIN fx_member m USING (pair_id, r, c)),
    a AS (SELECT b.pair_id, b.region_id, bg.band, count(*) AS n, avg(bg.l) AS mean FROM fx_box b JOIN bg ON bg.pair_id = b.pair_id AND bg.r BETWEEN r0 - 1 AND r1 + 1 AND bg.c BETWEEN c0 - 1 AND c1 + 1 GROUP BY ALL)
    SELECT pair_id, region_id, band, round(mean, 4) AS background_mean FROM a WHERE n >= 4""")
def background(t):
    run = chain.detection(t)
    return evidence.background_means(run.scored, run.aligned, run.members, regions(t, run.members), CONFIG, block=4)


@query("j09_region_score_stats", f"""
    WITH {BOX} SELECT pair_id, region_id, round(s, 4) AS mean_score, round(mx, 4) AS max_score, round(sd, 4) AS score_std, round(area / v.n, 4) AS changed_fraction
    FROM fx_box JOIN (SELECT pair_id, count(*) AS n FROM fx_score WHERE valid GROUP BY pair_id) v USING (pair_id)""")
def score_stats(t):
    run = chain.detection(t)
    return evidence.region_score_stats(run.members, pixels.valid_counts(run.scored))


@query("j10_feature_long", """
    WITH f AS (SELECT pair_id, region_id, unnest(['area_px', 'aspect_ratio', 'compactness', 'rectangularity', 'linearity_score', 'ndvi_mean', 'ndvi_delta', 'ndwi_mean', 'water_fraction', 'brightness_delta', 'contrast']) AS feature,
      unnest([area_px * 1e0, aspect_ratio, compactness, rectangularity, linearity_score, ndvi_mean, ndvi_delta, ndwi_mean, water_fraction, brightness_delta, contrast]) AS value FROM fx_regions)
    SELECT pair_id, region_id, feature, round(value, 4) AS value, value IS NOT NULL AS available,
      CASE feature WHEN 'area_px' THEN 'px' WHEN 'ndvi_mean' THEN 'index_score' WHEN 'ndwi_mean' THEN 'index_score' WHEN 'ndvi_delta' THEN 'index_delta' WHEN 'water_fraction' THEN 'fraction' END AS unit FROM f""")
def features(t):
    return evidence.feature_long(t.fx_regions).select("pair_id", "region_id", "feature", "value", "available", "unit")


@query("j11_region_membership", "SELECT pair_id, region_id, r AS row, c AS col FROM fx_member")
def membership(t):
    return chain.members(t).select("pair_id", "region_id", "row", "col")


@query("d07_region_neighbors", """
    WITH b AS (SELECT *, CAST(region_num % 97 AS INT) * 8 AS r0, CAST(region_num % 89 AS INT) * 8 AS c0, CAST(region_num % 97 AS INT) * 8 + CAST(region_num % 7 AS INT) AS r1, CAST(region_num % 89 AS INT) * 8 + CAST(region_num % 11 AS INT) AS c1 FROM fx_region_boxes)
    SELECT a.pair_id, a.region_id, count(b.region_id) AS neighbors FROM b a LEFT JOIN b ON a.pair_id = b.pair_id AND a.region_id <> b.region_id
      AND greatest(0, a.r0 - b.r1, b.r0 - a.r1) <= 120 AND greatest(0, a.c0 - b.c1, b.c0 - a.c1) <= 120 GROUP BY ALL""")
def neighbors(t):
    n = F.col("region_num")
    boxes = t.fx_region_boxes.select(
        "pair_id", "region_id", ((n % 97) * 8).cast("int").alias("min_row"), ((n % 89) * 8).cast("int").alias("min_col"),
        ((n % 97) * 8 + n % 7).cast("int").alias("max_row"), ((n % 89) * 8 + n % 11).cast("int").alias("max_col"),
    )
    return evidence.region_neighbors(boxes, 120)
