"""Weighted-rule classification of regions; the rules are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from epochlens.config import ClassifierConfig

# Categories in tie order, and all values a region can take.
CATEGORIES = ("construction", "clearance", "water_extent_change", "road_development")
ALL_CATEGORIES = (*CATEGORIES, "unknown")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    hit: Column
    points: float  # negative: a penalty, listed only when it hits
    reads: tuple[str, ...]
    applies: Column | None = None


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def rule_table(c: ClassifierConfig = ClassifierConfig()) -> list[Rule]:
    """Every rule with its condition and points (fixed values); a missing measurement counts as zero unless said otherwise."""
    rect, compact, linear = F.col("rectangularity"), F.col("compactness"), F.col("linearity_score")
    aspect, axes, major, minor = F.col("aspect_ratio"), F.col("axis_ratio"), F.col("major_axis"), F.col("minor_axis")
    bright, water = _or_zero("brightness_delta"), _or_zero("water_fraction")
    context = F.col("context_available") & F.col("contrast").isNotNull()
    contrast = F.when(context, F.col("contrast")).otherwise(0.0)
    around = F.when(F.col("context_available"), _or_zero("surrounding_change")).otherwise(0.0)
    green_loss, green_now, wet = F.col("ndvi_delta"), F.col("ndvi_mean"), F.col("ndwi_mean")
    calibrated = F.col("has_wavelength") & green_loss.isNotNull()
    gate = F.col("has_wavelength") & F.col("water_fraction").isNotNull()
    con, cle, wat, roa = CATEGORIES
    return [
        Rule("rule_const_geom_rectangularity", con, rect >= c.construction_min_rectangularity, 30, ("rectangularity",)),
        Rule("rule_const_geom_compactness", con, compact >= 0.20, 15, ("compactness",)),
        Rule("rule_const_geom_non_linear", con, (linear <= 0.65) & (aspect <= 4.0), 15, ("linearity_score", "aspect_ratio")),
        Rule("rule_const_spec_brightness_increase", con, bright > 0.05, 25, ("brightness_delta",)),
        Rule("rule_const_ctx_contrast", con, contrast >= 0.15, 15, ("contrast",)),
        Rule("disqual_const_water_presence", con, water > 0.30, -50, ("water_fraction",)),
        Rule("disqual_const_extreme_elongation", con, (linear > 0.85) & (aspect > 6.0), -40, ("linearity_score", "aspect_ratio")),
        Rule("disqual_const_no_brightness_increase", con, bright <= 0.0, -35, ("brightness_delta",)),
        Rule("rule_clear_spec_ndvi_decline", cle, green_loss <= c.clearance_max_ndvi_delta, 45, ("ndvi_delta",), calibrated),
        Rule("rule_clear_spec_post_ndvi_low", cle, green_now <= 0.25, 15, ("ndvi_mean",), calibrated),
        Rule("rule_clear_spec_rgb_brightness_proxy", cle, bright > 0.05, 35, ("brightness_delta",), ~calibrated),
        Rule("rule_clear_geom_non_linear", cle, linear <= 0.70, 20, ("linearity_score",)),
        Rule("rule_clear_geom_organic_shape", cle, rect <= 0.85, 10, ("rectangularity",)),
        Rule("rule_clear_ctx_isolated", cle, around <= 0.30, 10, ("surrounding_change",)),
        Rule("disqual_clear_vegetation_gain", cle, green_loss > 0.05, -60, ("ndvi_delta",)),
        Rule("disqual_clear_water_presence", cle, water > 0.35, -50, ("water_fraction",)),
        Rule("disqual_clear_linear_corridor", cle, (linear > 0.80) & (aspect > 5.0), -40, ("linearity_score", "aspect_ratio")),
        Rule("gate_water_spectral_bands_required", wat, F.lit(False), 100, (), ~gate),
        Rule("rule_water_spec_criterion_fraction", wat, water >= c.water_min_fraction, 55, ("water_fraction",), gate),
        Rule("rule_water_spec_mean_ndwi", wat, wet >= 0.10, 25, ("ndwi_mean",), gate),
        Rule("rule_water_uniformity", wat, _or_zero("score_std") <= 0.25, 20, ("score_std",), gate),
        Rule("disqual_water_high_vegetation", wat, green_now > 0.30, -50, ("ndvi_mean",), gate),
        Rule("rule_road_geom_linearity", roa, linear >= c.road_min_linearity, 35, ("linearity_score",)),
        Rule("rule_road_geom_elongation", roa, (aspect >= c.road_min_aspect) | (axes >= c.road_min_aspect), 25, ("aspect_ratio", "axis_ratio")),
        Rule("rule_road_geom_corridor_length", roa, major >= 40.0, 15, ("major_axis",)),
        Rule("rule_road_geom_corridor_width_bounded", roa, minor <= c.road_max_minor_axis, 15, ("minor_axis",)),
        Rule("rule_road_ctx_contrast", roa, contrast >= 0.10, 10, ("contrast",)),
        Rule("disqual_road_water_canal", roa, water > 0.35, -60, ("water_fraction",)),
        Rule("disqual_road_excessive_width", roa, minor > c.road_max_minor_axis * 1.5, -40, ("minor_axis",)),
        Rule("disqual_road_compact_blob", roa, (compact > 0.50) & (aspect < 2.5), -50, ("compactness", "aspect_ratio")),
        Rule("disqual_road_missing_context", roa, ~context, -50, ("contrast",)),
        Rule("penalty_road_negligible_contrast", roa, context & (contrast < 0.05), -20, ("contrast",)),
    ]


def _hit(rule: Rule) -> Column:
    hit = F.coalesce(rule.hit, F.lit(False))
    return hit if rule.applies is None else hit & F.coalesce(rule.applies, F.lit(False))


def category_scores(config: ClassifierConfig = ClassifierConfig()) -> dict[str, Column]:
    """Per category the sum of the points that hit, out of 100, kept in 0..1."""
    totals = {c: F.lit(0.0) for c in CATEGORIES}
    for rule in rule_table(config):
        if not rule.rule_id.startswith("gate_"):
            totals[rule.category] = totals[rule.category] + F.when(_hit(rule), float(rule.points)).otherwise(0.0)
    return {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / 100.0)) for c, total in totals.items()}


def rule_evaluations(config: ClassifierConfig = ClassifierConfig()) -> Column:
    """ARRAY of every rule that was looked at, with its contribution and inputs."""
    rows = []
    for rule in rule_table(config):
        hit = _hit(rule)
        inputs = F.create_map(*[x for name in rule.reads for x in (F.lit(name), F.col(name).cast("double"))]) if rule.reads else F.create_map().cast("map<string,double>")
        row = F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.category).alias("category"), hit.alias("matched"),
            F.lit(float(abs(rule.points))).alias("weight"), F.when(hit, float(rule.points)).otherwise(0.0).alias("contribution"), inputs.alias("inputs"),
        )
        shown = hit if rule.points < 0 else (F.coalesce(rule.applies, F.lit(False)) if rule.applies is not None else F.lit(True))
        rows.append(F.when(shown, row))
    return F.array_compact(F.array(*rows))


def top2(scores: dict[str, Column]) -> Column:
    """STRUCT<best, best_score, runner, runner_score>; equal scores keep the given order."""
    ranked = F.array_sort(F.array(*[
        F.struct((-s).alias("order"), F.lit(i).alias("at"), F.lit(name).alias("name"), s.alias("score")) for i, (name, s) in enumerate(scores.items())
    ]))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.struct(first["name"].alias("best"), first["score"].alias("best_score"), second["name"].alias("runner"), second["score"].alias("runner_score"))


def with_scores(regions: DataFrame, config: ClassifierConfig = ClassifierConfig()) -> DataFrame:
    return regions.select("*", *[score.alias(f"score_{c}") for c, score in category_scores(config).items()])


def classify_regions(regions: DataFrame, config: ClassifierConfig = ClassifierConfig()) -> DataFrame:
    """Category, evidence score, confidence tier and ambiguity per region; the inputs stay beside them."""
    scored = with_scores(regions, config).withColumn("_top", top2({c: F.col(f"score_{c}") for c in CATEGORIES}))
    best, runner = F.col("_top.best_score"), F.col("_top.runner_score")
    margin = best - runner
    gated = (F.col("area_px") < config.min_area_px) | ~F.col("spectral_available")
    weak = best < config.min_score
    ambiguous = ~gated & ~weak & (margin < config.ambiguity_margin) & (runner >= config.min_score)
    unknown = gated | weak | ambiguous
    uncalibrated = ~F.col("has_wavelength") & F.col("_top.best").isin("clearance", "construction")
    tier = (
        F.when(unknown, "uncertain")
        .when(uncalibrated, "low")
        .when((best >= 0.75) & (margin >= 0.30) & (F.col("area_px") >= 25), "high")
        .when((best >= 0.55) & (margin >= 0.18), "medium")
        .otherwise("low")
    )
    reason = (
        F.when(F.col("area_px") < config.min_area_px, "region too small")
        .when(~F.col("spectral_available"), "spectral imagery unavailable")
        .when(weak, "no category reaches the minimum score")
        .when(ambiguous, "two categories within the margin")
        .otherwise("best category")
    )
    return scored.select(
        *regions.columns, *[F.when(~gated, F.round(f"score_{c}", 4)).alias(f"score_{c}") for c in CATEGORIES],
        F.when(unknown, "unknown").otherwise(F.col("_top.best")).alias("category"),
        F.when(gated, 0.0).otherwise(F.round(best, 4)).alias("evidence_score"),
        tier.alias("confidence_tier"), ambiguous.alias("is_ambiguous"),
        F.when(ambiguous, F.array("_top.best", "_top.runner")).otherwise(F.array().cast("array<string>")).alias("conflicting"),
        reason.alias("decision_reason"),
    )


def rule_audit(regions: DataFrame, config: ClassifierConfig = ClassifierConfig()) -> DataFrame:
    """One row per rule looked at, for regions that passed the area and spectral gates."""
    open_regions = regions.where((F.col("area_px") >= config.min_area_px) & F.col("spectral_available"))
    return open_regions.select("pair_id", "region_id", F.inline(rule_evaluations(config)))


def classification_metrics(classified: DataFrame) -> DataFrame:
    """Per pair: regions by category (all listed), high confidence, ambiguous, share unknown."""
    total = F.count(F.lit(1))
    return classified.groupBy("pair_id").agg(
        total.alias("total_regions"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in ALL_CATEGORIES],
        F.count_if(F.col("confidence_tier") == "high").alias("high_confidence"),
        F.count_if("is_ambiguous").alias("ambiguous"),
        F.round(F.count_if(F.col("category") == "unknown") / total, 4).alias("unknown_fraction"),
    )
