"""Classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalogue.registry import query
from epochlens.catalogue.views import EXTRA_SQL
from epochlens.operators import rules

# Points as sums of CASE terms; the same fixed values as the rule table, written out for SQL.
EXTRA_SQL["fx_category_scores"] = """
    WITH x AS (SELECT *, coalesce(brightness_delta, 0e0) AS b, coalesce(water_fraction, 0e0) AS w, context_available AND contrast IS NOT NULL AS has_c, CASE WHEN context_available THEN coalesce(contrast, 0e0) ELSE 0e0 END AS cc,
        CASE WHEN context_available THEN coalesce(surrounding_change, 0e0) ELSE 0e0 END AS su, has_wavelength AND ndvi_delta IS NOT NULL AS cal, has_wavelength AND water_fraction IS NOT NULL AS wg FROM fx_regions)
    SELECT *, least(1e0, greatest(0e0, (if(rectangularity >= 0.60e0, 30, 0) + if(compactness >= 0.20e0, 15, 0) + if(linearity_score <= 0.65e0 AND aspect_ratio <= 4, 15, 0) + if(b > 0.05e0, 25, 0) + if(cc >= 0.15e0, 15, 0)
          - if(w > 0.30e0, 50, 0) - if(linearity_score > 0.85e0 AND aspect_ratio > 6, 40, 0) - if(b <= 0, 35, 0)) / 100e0)) AS construction,
      least(1e0, greatest(0e0, (if(cal, if(ndvi_delta <= -0.15e0, 45, 0) + if(coalesce(ndvi_mean <= 0.25e0, false), 15, 0), if(b > 0.05e0, 35, 0)) + if(linearity_score <= 0.70e0, 20, 0) + if(rectangularity <= 0.85e0, 10, 0) + if(su <= 0.30e0, 10, 0)
          - if(coalesce(ndvi_delta > 0.05e0, false), 60, 0) - if(w > 0.35e0, 50, 0) - if(linearity_score > 0.80e0 AND aspect_ratio > 5, 40, 0)) / 100e0)) AS clearance,
      CASE WHEN wg THEN least(1e0, greatest(0e0, (if(w >= 0.40e0, 55, 0) + if(coalesce(ndwi_mean >= 0.10e0, false), 25, 0) + if(score_std <= 0.25e0, 20, 0) - if(coalesce(ndvi_mean > 0.30e0, false), 50, 0)) / 100e0)) ELSE 0e0 END AS water,
      least(1e0, greatest(0e0, (if(linearity_score >= 0.75e0, 35, 0) + if(aspect_ratio >= 5 OR axis_ratio >= 5, 25, 0) + if(major_axis >= 40, 15, 0) + if(minor_axis <= 30, 15, 0) + if(cc >= 0.10e0, 10, 0)
          - if(w > 0.35e0, 60, 0) - if(minor_axis > 45, 40, 0) - if(compactness > 0.50e0 AND aspect_ratio < 2.5e0, 50, 0) - if(NOT has_c, 50, if(cc < 0.05e0, 20, 0))) / 100e0)) AS road FROM x"""
EXTRA_SQL["fx_ranked"] = """
    SELECT *, CASE WHEN construction >= greatest(clearance, water, road) THEN 'construction' WHEN clearance >= greatest(water, road) THEN 'clearance' WHEN water >= road THEN 'water_extent_change' ELSE 'road_development' END AS best,
      greatest(construction, clearance, water, road) AS top, list_sort([construction, clearance, water, road], 'DESC')[2] AS second FROM fx_category_scores"""
EXTRA_SQL["fx_classified"] = """
    SELECT *, CASE WHEN area_px < 10 OR NOT spectral_available OR top < 0.45e0 OR (top - second < 0.15e0 AND second >= 0.45e0) THEN 'unknown' ELSE best END AS category,
      CASE WHEN area_px < 10 OR NOT spectral_available THEN 0e0 ELSE round(top, 4) END AS evidence_score,
      CASE WHEN area_px < 10 OR NOT spectral_available OR top < 0.45e0 OR (top - second < 0.15e0 AND second >= 0.45e0) THEN 'uncertain' WHEN NOT has_wavelength AND best IN ('clearance', 'construction') THEN 'low'
        WHEN top >= 0.75e0 AND top - second >= 0.30e0 AND area_px >= 25 THEN 'high' WHEN top >= 0.55e0 AND top - second >= 0.18e0 THEN 'medium' ELSE 'low' END AS confidence_tier,
      area_px >= 10 AND spectral_available AND top >= 0.45e0 AND top - second < 0.15e0 AND second >= 0.45e0 AS is_ambiguous FROM fx_ranked"""

for number, category, column in (
    ("k01_score_construction", "construction", "construction"), ("k02_score_clearance", "clearance", "clearance"),
    ("k03_score_water", "water_extent_change", "water"), ("k04_score_road", "road_development", "road"),
):

    @query(number, f"SELECT region_id, round({column}, 4) AS score FROM fx_category_scores")
    def one_category(t, category=category):
        return t.fx_regions.select("region_id", F.round(rules.category_scores()[category], 4).alias("score"))


@query("g05_top2_margin", "SELECT region_id, best, top AS best_score, second AS runner_score, round(top - second, 6) AS margin FROM fx_ranked")
def top2(t):
    picked = rules.top2({c: F.col(f"score_{c}") for c in rules.CATEGORIES})
    out = rules.with_scores(t.fx_regions).select("region_id", picked.alias("p"))
    return out.select("region_id", "p.best", "p.best_score", "p.runner_score", F.round(F.col("p.best_score") - F.col("p.runner_score"), 6).alias("margin"))


@query("k05_classify_regions", "SELECT region_id, category, evidence_score, confidence_tier, is_ambiguous FROM fx_classified")
def classify(t):
    return rules.classify_regions(t.fx_regions).select("region_id", "category", "evidence_score", "confidence_tier", "is_ambiguous")


@query("k06_rule_audit", """
    SELECT region_id, round(construction, 4) AS construction, round(road, 4) AS road, 5 + if(w > 0.30e0, 1, 0) + if(linearity_score > 0.85e0 AND aspect_ratio > 6, 1, 0) + if(b <= 0, 1, 0) AS construction_rules,
      if(wg, 3 + if(coalesce(ndvi_mean > 0.30e0, false), 1, 0), 1) AS water_rules FROM fx_category_scores WHERE area_px >= 10 AND spectral_available""")
def audit(t):
    rows = rules.rule_audit(t.fx_regions)

    def total(category):
        points = F.sum(F.when(F.col("category") == category, F.col("contribution")).otherwise(0.0))
        return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), points / 100.0)), 4)

    return rows.groupBy("region_id").agg(
        total("construction").alias("construction"), total("road_development").alias("road"),
        F.count_if(F.col("category") == "construction").alias("construction_rules"),
        F.count_if(F.col("category") == "water_extent_change").alias("water_rules"),
    )


@query("e06_classification_metrics", """
    SELECT pair_id, count(*) AS total_regions, CAST(count(*) FILTER (category = 'construction') AS BIGINT) AS n_construction, CAST(count(*) FILTER (category = 'clearance') AS BIGINT) AS n_clearance,
      CAST(count(*) FILTER (category = 'water_extent_change') AS BIGINT) AS n_water_extent_change, CAST(count(*) FILTER (category = 'road_development') AS BIGINT) AS n_road_development, CAST(count(*) FILTER (category = 'unknown') AS BIGINT) AS n_unknown,
      CAST(count(*) FILTER (confidence_tier = 'high') AS BIGINT) AS high_confidence, CAST(count(*) FILTER (is_ambiguous) AS BIGINT) AS ambiguous, round(count(*) FILTER (category = 'unknown') / count(*), 4) AS unknown_fraction FROM fx_classified GROUP BY pair_id""")
def metrics(t):
    return rules.classification_metrics(rules.classify_regions(t.fx_regions))
