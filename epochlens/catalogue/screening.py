"""Screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalogue.registry import query
from epochlens.catalogue.views import EXTRA_SQL
from epochlens.operators import rules, screening

EXTRA_SQL["fx_signal_rows"] = """
    SELECT *, CASE WHEN blue IS NOT NULL THEN (blue + green + red) / 3e0 ELSE greatest(0e0, brightness_delta) END AS vis,
      CASE WHEN context_available THEN coalesce(surrounding_change, 0e0) ELSE 0e0 END AS su, CASE WHEN context_available THEN coalesce(contrast, 0e0) ELSE 0e0 END AS cc FROM fx_classified JOIN fx_signals USING (pair_id, region_id)"""
EXTRA_SQL["fx_checks"] = """
    WITH a AS (SELECT *, CASE WHEN blue IS NOT NULL AND vis > 0.001e0 THEN (abs(blue - vis) + abs(green - vis) + abs(red - vis)) / (3e0 * vis) WHEN vis >= 0.35e0 THEN 0e0 ELSE 1e0 END AS white,
        NOT has_wavelength OR (cirrus IS NULL AND swir IS NULL) AS rgb, coalesce(CASE WHEN vis > 0.001e0 THEN swir / vis < 0.60e0 END, false) AS swir_drop, coalesce(red, 0.20e0) AS dark,
        coalesce(su / greatest(0.01e0, mean_score), 0e0) AS cpl, CASE WHEN green + swir > 0.001e0 THEN (green - swir) / (green + swir) ELSE 0e0 END AS ndsi FROM fx_signal_rows),
    b AS (SELECT *, vis >= 0.35e0 AND white <= 0.15e0 AS bright, vis >= 0.35e0 AND white <= 0.15e0 AND (coalesce(cirrus >= 0.015e0, false) OR swir_drop) AS cloudy, dark > 0.10e0 OR coalesce(nir > 0.12e0, false) AS lit,
        CASE WHEN mean_score > 0 THEN cpl ELSE 1e0 END AS coupling, edge_overlap >= 0.70e0 AND compactness <= 0.08e0 AND minor_axis <= 2 AS fringe FROM a)
    SELECT *, CASE WHEN rgb THEN if(bright, 0.50e0, 0e0) WHEN cloudy THEN if(rectangularity <= 0.50e0, 1e0, 0.20e0) ELSE 0e0 END AS s1, CASE WHEN rgb THEN 0.25e0 WHEN cloudy THEN if(rectangularity <= 0.50e0, 0.40e0, 0.15e0) ELSE 0.35e0 END AS w1, NOT rgb AND cloudy AND rectangularity <= 0.50e0 AS h1,
      CASE WHEN lit THEN 0e0 WHEN solar_azimuth IS NULL AND NOT ray_aligned THEN 0.40e0 WHEN ray_aligned OR cloud_candidates > 0 THEN 1e0 ELSE 0.15e0 END AS s2, CASE WHEN lit THEN 0.35e0 WHEN solar_azimuth IS NULL AND NOT ray_aligned THEN 0.20e0 WHEN ray_aligned OR cloud_candidates > 0 THEN 0.40e0 ELSE 0.10e0 END AS w2,
      NOT lit AND NOT (solar_azimuth IS NULL AND NOT ray_aligned) AND (ray_aligned OR cloud_candidates > 0) AS h2, NOT lit AND solar_azimuth IS NULL AND NOT ray_aligned AS no_sun,
      if(cc < 0.15e0 AND (haze OR (su >= 0.25e0 AND cc < 0.10e0)), 0.30e0, 0e0) AS s3, 0.15e0 AS w3, if(fringe, if(dipole, 1e0, 0.15e0), 0e0) AS s4, if(fringe, if(dipole, 0.40e0, 0.10e0), 0.35e0) AS w4, fringe AND dipole AS h4,
      if(parallax, 0.55e0, 0e0) AS s5, 0.20e0 AS w5, if(area_px <= 2 OR noise_spike, 1e0, 0e0) AS s6, 0.30e0 AS w6, area_px <= 2 OR noise_spike AS h6,
      if(cc < 0.15e0 AND tile_median >= 0.20e0 AND coupling >= 0.75e0, round(least(1e0, greatest(0.85e0, coupling)), 2), 0e0) AS s7, if(cc < 0.15e0 AND tile_median >= 0.20e0 AND coupling >= 0.75e0, 0.40e0, 0.20e0) AS w7,
      if(has_wavelength AND swir IS NOT NULL AND ndsi >= 0.40e0 AND coalesce(green >= 0.25e0, false), 1e0, 0e0) AS s8, CASE WHEN NOT has_wavelength OR swir IS NULL THEN 0.25e0 WHEN ndsi >= 0.40e0 AND coalesce(green >= 0.25e0, false) THEN 0.40e0 ELSE 0.35e0 END AS w8,
      if(gain_shift, 0.35e0, 0e0) AS s9, 0.15e0 AS w9, if(cross_sensor, 0.30e0, 0e0) AS s10, 0.10e0 AS w10, if(unknown_artifact, 0.30e0, 0e0) AS s11, 0.10e0 AS w11 FROM b"""
EXTRA_SQL["fx_screened"] = """
    WITH r AS (SELECT *, s8 > 0 AS h8, (area_px < 10 AND NOT (area_px <= 2 AND noise_spike)) OR NOT spectral_available AS out_,
        round(least(1e0, w1 * s1 + w2 * s2 + w3 * s3 + w4 * s4 + w5 * s5 + w6 * s6 + w7 * s7 + w8 * s8 + w9 * s9 + w10 * s10 + w11 * s11), 4) AS f FROM fx_checks),
    d AS (SELECT *, h1 OR h2 OR h4 OR h6 OR h8 AS hard, parallax OR (rgb AND s1 >= 0.40e0) OR (no_sun AND s2 >= 0.35e0) AS forced, greatest(w1 * s1, w2 * s2, w3 * s3, w4 * s4, w5 * s5, w6 * s6, w7 * s7, w8 * s8, w9 * s9, w10 * s10, w11 * s11) AS heavy FROM r)
    SELECT *, CASE WHEN out_ THEN 'insufficient_evidence' WHEN hard THEN 'suppressed' WHEN forced THEN 'flagged' WHEN f < 0.35e0 THEN 'retained' ELSE 'flagged' END AS decision, CASE WHEN out_ THEN 0e0 WHEN hard THEN 1e0 ELSE f END AS risk,
      CASE WHEN out_ THEN NULL WHEN hard THEN CASE WHEN h1 THEN 'CLOUD_CONTAMINATION' WHEN h2 THEN 'CLOUD_SHADOW' WHEN h4 THEN 'COREGISTRATION_EDGE_SHEAR' WHEN h6 THEN 'SENSOR_NOISE_DROPOUT' ELSE 'SNOW_ICE' END
        WHEN heavy = 0 THEN NULL WHEN w1 * s1 = heavy THEN 'CLOUD_CONTAMINATION' WHEN w2 * s2 = heavy THEN 'CLOUD_SHADOW' WHEN w3 * s3 = heavy THEN 'HAZE_AEROSOL' WHEN w4 * s4 = heavy THEN 'COREGISTRATION_EDGE_SHEAR' WHEN w5 * s5 = heavy THEN 'VIEWING_GEOMETRY_PARALLAX'
        WHEN w6 * s6 = heavy THEN 'SENSOR_NOISE_DROPOUT' WHEN w7 * s7 = heavy THEN 'GLOBAL_ILLUMINATION_DRIFT' WHEN w8 * s8 = heavy THEN 'SNOW_ICE' WHEN w9 * s9 = heavy THEN 'RADIOMETRIC_GAIN_INCONSISTENCY' WHEN w10 * s10 = heavy THEN 'CROSS_SENSOR_LIMITATION' ELSE 'UNKNOWN_ARTIFACT' END AS primary_artifact FROM d"""


def screened_input(t):
    """Classified regions with their later-date bands as a MAP and the scene hints."""
    classified = rules.classify_regions(t.fx_regions)
    roles = ("blue", "green", "red", "nir", "swir", "cirrus")
    known = F.filter(F.array(*[F.struct(F.lit(r.title()).alias("k"), F.col(r).alias("v")) for r in roles]), lambda e: e["v"].isNotNull())
    signals = t.fx_signals.withColumn("bands", F.map_from_entries(known)).drop(*roles)
    return classified.join(signals, ["pair_id", "region_id"])


for at, (name, columns) in enumerate(
    (
        ("l01_detect_cloud", "s1 AS score, w1 AS weight, h1 AS hard"), ("l02_detect_shadow", "s2 AS score, w2 AS weight, h2 AS hard"),
        ("l03_detect_haze", "s3 AS score, w3 AS weight, false AS hard"), ("l04_detect_edge_shear", "s4 AS score, w4 AS weight, h4 AS hard"),
        ("l05_detect_parallax", "s5 AS score, w5 AS weight, false AS hard"), ("l06_detect_noise", "s6 AS score, w6 AS weight, h6 AS hard"),
        ("l07_detect_illumination", "s7 AS score, w7 AS weight, false AS hard"), ("l08_detect_snow", "s8 AS score, w8 AS weight, s8 > 0 AS hard"),
        ("l09_detect_gain", "s9 AS score, w9 AS weight, false AS hard"), ("l10_detect_cross_sensor", "s10 AS score, w10 AS weight, false AS hard"),
        ("l11_detect_unknown", "s11 AS score, w11 AS weight, false AS hard"),
    )
):

    @query(name, f"SELECT region_id, '{screening.CHECKS[at]}' AS artifact, s{at + 1} > 0 AS detected, {columns} FROM fx_checks")
    def detector(t, detect=screening.DETECTORS[at]):
        rows = screening.with_cloud_terms(screening.with_bands(screened_input(t)), screening.ScreeningConfig())
        found = detect(screening.Signals(rows), screening.ScreeningConfig())
        return rows.select("region_id", found.alias("x")).select("region_id", "x.artifact", "x.detected", "x.score", "x.weight", "x.hard")


_FOUND = ", ".join(f"CASE WHEN NOT out_ AND s{i + 1} > 0 THEN '{a}' END" for i, a in enumerate(screening.CHECKS))


@query("l12_screen_regions", f"""
    SELECT pair_id, region_id, decision, risk, primary_artifact,
      concat_ws(',', CASE WHEN out_ THEN 'DATA_LIMITATION' WHEN hard THEN 'CONSERVATIVE_MULTI_EVIDENCE' WHEN forced THEN 'DATA_LIMITATION_OR_PARALLAX_FLAG' WHEN f < 0.35e0 THEN 'LOW_ARTIFACT_RISK'
        WHEN f < {screening.ScreeningConfig().high_risk}e0 THEN 'MODERATE_ARTIFACT_RISK' ELSE 'HIGH_ARTIFACT_RISK_UNCONFIRMED' END, {_FOUND}) AS reasons,
      concat_ws(',', CASE WHEN area_px < 10 AND NOT (area_px <= 2 AND noise_spike) THEN 'AREA_BELOW_MINIMUM' END, CASE WHEN NOT spectral_available THEN 'SPECTRAL_UNAVAILABLE' END,
        CASE WHEN rgb THEN 'CLOUD_CONTAMINATION_UNCONFIRMED' END, CASE WHEN no_sun THEN 'CLOUD_SHADOW_UNCONFIRMED' END, CASE WHEN NOT has_wavelength OR swir IS NULL THEN 'SNOW_ICE_UNCONFIRMED' END) AS limitations FROM fx_screened""")
def screen(t):
    return screening.screen_regions(screened_input(t)).select(
        "pair_id", "region_id", "decision", "risk", "primary_artifact",
        F.array_join("decision_reasons", ",").alias("reasons"), F.array_join("data_limitations", ",").alias("limitations"),
    )


@query("l13_adjust_tier", """
    SELECT region_id, CASE WHEN decision = 'suppressed' THEN 'suppressed' WHEN decision = 'retained' THEN confidence_tier WHEN confidence_tier = 'high' THEN 'medium' WHEN confidence_tier IN ('medium', 'low') THEN 'low' ELSE 'uncertain' END AS adjusted_tier,
      CASE WHEN decision = 'suppressed' THEN 'suppressed' ELSE category END AS retained_category FROM fx_screened""")
def tiers(t):
    return screening.screen_regions(screened_input(t)).select("region_id", "adjusted_tier", "retained_category")


@query("d08_evidence_x_classification", """
    SELECT r.region_id, coalesce(c.category, 'unknown') AS category, coalesce(c.confidence_tier, 'uncertain') AS confidence_tier FROM fx_regions r LEFT JOIN (SELECT * FROM fx_classified WHERE area_px >= 20) c USING (pair_id, region_id)""")
def with_classification(t):
    found = rules.classify_regions(t.fx_regions).where("area_px >= 20")
    return screening.with_classification(t.fx_regions, found).select("region_id", "category", "confidence_tier")


@query("e07_suppression_metrics", """
    SELECT pair_id, count(*) AS total_regions, CAST(count(*) FILTER (decision = 'retained') AS BIGINT) AS retained, CAST(count(*) FILTER (decision = 'flagged') AS BIGINT) AS flagged, CAST(count(*) FILTER (decision = 'suppressed') AS BIGINT) AS suppressed,
      CAST(count(*) FILTER (decision = 'insufficient_evidence') AS BIGINT) AS insufficient, round(count(*) FILTER (decision = 'suppressed') / count(*), 4) AS suppression_rate, CAST(sum(area_px) AS BIGINT) AS total_area,
      CAST(coalesce(sum(area_px) FILTER (decision = 'retained'), 0) AS BIGINT) AS retained_area, CAST(coalesce(sum(area_px) FILTER (decision = 'flagged'), 0) AS BIGINT) AS flagged_area, CAST(coalesce(sum(area_px) FILTER (decision = 'suppressed'), 0) AS BIGINT) AS suppressed_area,
      """ + ", ".join(f"CAST(count(*) FILTER (primary_artifact = '{a}') AS BIGINT) AS by_{a.lower()}" for a in screening.CHECKS) + " FROM fx_screened GROUP BY pair_id")
def metrics(t):
    return screening.suppression_metrics(screening.screen_regions(screened_input(t)))
