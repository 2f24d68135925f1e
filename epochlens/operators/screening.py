"""Screening of regions for false alarms: eleven artifact checks and one decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epochlens.config import ScreeningConfig
from epochlens.functions.text import band_at

# Band aliases, and the checks in the order in which a hard one is named first.
ALIASES = {
    "blue": ("blue", "b02", "b2"),
    "green": ("green", "b03", "b3"),
    "red": ("red", "b04", "b4"),
    "visible": ("red", "green", "blue", "b04", "b03", "b02"),
    "nir": ("nir", "b08", "b8", "b5"),
    "swir": ("swir", "swir1", "b11"),
    "cirrus": ("cirrus", "b10", "b09"),
}
CHECKS = (
    "CLOUD_CONTAMINATION", "CLOUD_SHADOW", "HAZE_AEROSOL", "COREGISTRATION_EDGE_SHEAR", "VIEWING_GEOMETRY_PARALLAX",
    "SENSOR_NOISE_DROPOUT", "GLOBAL_ILLUMINATION_DRIFT", "SNOW_ICE", "RADIOMETRIC_GAIN_INCONSISTENCY", "CROSS_SENSOR_LIMITATION", "UNKNOWN_ARTIFACT",
)
# Optional scene and region hints; a column that is absent is unknown.
HINTS = {
    "vis_reflectance": "double", "whiteness": "double", "cirrus_reflectance": "double", "swir_reflectance": "double",
    "nir_reflectance": "double", "green_reflectance": "double", "swir_cloud_evidence": "boolean",
    "solar_azimuth": "double", "cloud_candidates": "int", "ray_aligned": "boolean", "haze": "boolean", "edge_overlap": "double",
    "dipole": "boolean", "parallax": "boolean", "noise_spike": "boolean", "tile_median": "double", "gain_shift": "boolean",
    "cross_sensor": "boolean", "unknown_artifact": "boolean",
}


class Signals:
    """Column expressions of the inputs, with unknown hints as their defaults."""

    def __init__(self, df: DataFrame):
        self._columns = set(df.columns)

    def hint(self, name: str) -> Column:
        return F.col(name) if name in self._columns else F.lit(None).cast(HINTS[name])

    def flag(self, name: str) -> Column:
        return F.coalesce(self.hint(name), F.lit(False))

    def number(self, name: str) -> Column:
        return F.coalesce(self.hint(name), F.lit(0.0))

    def band(self, role: str, override: str | None = None) -> Column:
        value = F.col(f"_band_{role}")
        return F.coalesce(self.hint(override), value) if override else value

    @property
    def around(self) -> Column:
        return F.when(F.col("context_available"), F.coalesce("surrounding_change", F.lit(0.0))).otherwise(0.0)

    @property
    def contrast(self) -> Column:
        return F.when(F.col("context_available"), F.coalesce("contrast", F.lit(0.0))).otherwise(0.0)


def with_bands(df: DataFrame) -> DataFrame:
    """Add the later-date reflectance of each role, looked up once in the `bands` MAP."""
    keyed = df.withColumns({"_keys": F.reverse(F.transform(F.map_keys("bands"), F.lower)), "_values": F.reverse(F.map_values("bands"))})
    found = keyed.withColumns({f"_band_{role}": band_at(F.col("_keys"), F.col("_values"), names) for role, names in ALIASES.items()})
    return found.drop("_keys", "_values")


def _result(name: str, cases: list[tuple[Column, float, float, bool]], quiet_weight: float, note: Column | None = None) -> Column:
    """STRUCT of one check: the first case that holds decides (score, weight, hard), else nothing is found.

    The outcomes are a constant table and only the case number is computed, so a condition is evaluated once.
    """
    at = F.lit(len(cases))
    for i in reversed(range(len(cases))):
        at = F.when(cases[i][0], i).otherwise(at)
    outcomes = F.array(*[
        F.struct(
            F.lit(name).alias("artifact"), F.lit(score > 0).alias("detected"), F.lit(float(score)).alias("score"),
            F.lit(float(weight)).alias("weight"), F.lit(hard).alias("hard"), F.lit(False).alias("limited"),
        )
        for score, weight, hard in [c[1:] for c in cases] + [(0.0, quiet_weight, False)]
    ])
    found = F.get(outcomes, at)
    return found if note is None else found.withField("limited", F.coalesce(note, F.lit(False)))


def with_cloud_terms(df: DataFrame, c: ScreeningConfig) -> DataFrame:
    """Add visible reflectance and whiteness, which several cases share."""
    s = Signals(df)
    blue, green, red = s.band("blue"), s.band("green"), s.band("red")
    known = blue.isNotNull() & green.isNotNull() & red.isNotNull()
    risen = F.when(F.col("brightness_delta").isNotNull(), F.greatest(F.lit(0.0), F.col("brightness_delta")))
    df = df.withColumn("_vis", F.coalesce(s.hint("vis_reflectance"), F.when(known, (blue + green + red) / 3.0), risen, F.lit(0.0)))
    vis = F.col("_vis")
    spread = (F.abs(blue - vis) + F.abs(green - vis) + F.abs(red - vis)) / (3.0 * vis)
    plain = F.when(vis >= c.cloud_reflectance, 0.0).otherwise(1.0)
    return df.withColumn("_white", F.coalesce(s.hint("whiteness"), F.when(known & (vis > 0.001), spread), plain))


def detect_cloud(s: Signals, c: ScreeningConfig) -> Column:
    vis, white = F.col("_vis"), F.col("_white")
    cirrus, swir = s.band("cirrus", "cirrus_reflectance"), s.band("swir", "swir_reflectance")
    evidence = s.hint("swir_cloud_evidence")
    drop = F.coalesce(evidence, F.when(vis > 0.001, swir / vis < 0.60), F.lit(False))
    plain = ~F.col("has_wavelength") | (cirrus.isNull() & swir.isNull() & evidence.isNull())
    bright = (vis >= c.cloud_reflectance) & (white <= c.cloud_whiteness)
    confirmed = bright & (F.coalesce(cirrus >= c.cloud_cirrus, F.lit(False)) | drop)
    return _result(
        CHECKS[0],
        [(plain & bright, 0.50, 0.25, False), (plain, 0.0, 0.25, False), (confirmed & (F.col("rectangularity") <= 0.50), 1.0, 0.40, True), (confirmed, 0.20, 0.15, False)],
        0.35, plain,
    )


def detect_shadow(s: Signals, c: ScreeningConfig) -> Column:
    vis = F.coalesce(s.hint("vis_reflectance"), s.band("visible"), F.lit(0.20))
    nir = s.band("nir", "nir_reflectance")
    lit = (vis > c.shadow_vis) | F.coalesce(nir > c.shadow_nir, F.lit(False))
    sun, aligned = s.hint("solar_azimuth").isNotNull(), s.flag("ray_aligned")
    blind = ~lit & ~sun & ~aligned
    clouds = F.coalesce(s.hint("cloud_candidates"), F.lit(0)) > 0
    return _result(
        CHECKS[1], [(lit, 0.0, 0.35, False), (blind, 0.40, 0.20, False), (aligned | clouds, 1.0, 0.40, True), (F.lit(True), 0.15, 0.10, False)], 0.35, blind
    )


def detect_haze(s: Signals, c: ScreeningConfig) -> Column:
    waived = s.contrast >= c.contrast_margin
    return _result(CHECKS[2], [(~waived & (s.flag("haze") | ((s.around >= 0.25) & (s.contrast < 0.10))), 0.30, 0.15, False)], 0.15)


def detect_edge_shear(s: Signals, c: ScreeningConfig) -> Column:
    fringe = (s.number("edge_overlap") >= c.shear_overlap) & (F.col("compactness") <= c.shear_max_compactness) & (F.col("minor_axis") <= c.shear_max_width)
    return _result(CHECKS[3], [(fringe & s.flag("dipole"), 1.0, 0.40, True), (fringe, 0.15, 0.10, False)], 0.35)


def detect_parallax(s: Signals, c: ScreeningConfig) -> Column:
    return _result(CHECKS[4], [(s.flag("parallax"), 0.55, 0.20, False)], 0.20)


def detect_noise(s: Signals, c: ScreeningConfig) -> Column:
    speck = (F.col("area_px") <= 2) & (F.col("area_px") < c.min_area_px)
    return _result(CHECKS[5], [(speck | s.flag("noise_spike"), 1.0, 0.30, True)], 0.30)


def detect_illumination(s: Signals, c: ScreeningConfig) -> Column:
    own = F.coalesce("mean_score", F.lit(0.0))
    coupling = F.when(own > 0, s.around / F.greatest(F.lit(0.01), own)).otherwise(1.0)
    found = (s.contrast < c.contrast_margin) & (s.number("tile_median") >= c.illumination_median) & (coupling >= c.illumination_coupling)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.85), coupling)), 2)
    return F.struct(
        F.lit(CHECKS[6]).alias("artifact"), found.alias("detected"), F.when(found, score).otherwise(0.0).alias("score"),
        F.when(found, 0.40).otherwise(0.20).alias("weight"), F.lit(False).alias("hard"), F.lit(False).alias("limited"),
    )


def detect_snow(s: Signals, c: ScreeningConfig) -> Column:
    green, swir = s.band("green", "green_reflectance"), s.band("swir", "swir_reflectance")
    plain = ~F.col("has_wavelength") | swir.isNull()
    total = green + swir
    ndsi = F.when(total > 0.001, (green - swir) / total).otherwise(0.0)
    return _result(CHECKS[7], [(plain, 0.0, 0.25, False), ((ndsi >= c.snow_ndsi) & (green >= 0.25), 1.0, 0.40, True)], 0.35, plain)


def detect_gain(s: Signals, c: ScreeningConfig) -> Column:
    return _result(CHECKS[8], [(s.flag("gain_shift"), 0.35, 0.15, False)], 0.15)


def detect_cross_sensor(s: Signals, c: ScreeningConfig) -> Column:
    return _result(CHECKS[9], [(s.flag("cross_sensor"), 0.30, 0.10, False)], 0.10)


def detect_unknown(s: Signals, c: ScreeningConfig) -> Column:
    return _result(CHECKS[10], [(s.flag("unknown_artifact"), 0.30, 0.10, False)], 0.10)


DETECTORS = (
    detect_cloud, detect_shadow, detect_haze, detect_edge_shear, detect_parallax, detect_noise, detect_illumination, detect_snow,
    detect_gain, detect_cross_sensor, detect_unknown,
)


def _with_checks(regions: DataFrame, config: ScreeningConfig) -> DataFrame:
    """Add one STRUCT column for each check, `_check_0` and on."""
    banded = with_cloud_terms(with_bands(regions), config)
    s = Signals(banded)
    return banded.withColumns({f"_check_{i}": d(s, config) for i, d in enumerate(DETECTORS)})


def _each() -> list[Column]:
    return [F.col(f"_check_{i}") for i in range(len(DETECTORS))]


def detect_all(regions: DataFrame, config: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """Add `checks`, the ARRAY of all artifact checks in order."""
    return _with_checks(regions, config).select(*regions.columns, F.array(*_each()).alias("checks"))


def adjust_tier(tier: Column, decision: Column) -> Column:
    level = F.lower(tier)
    lowered = F.when(level == "high", "medium").when(level.isin("medium", "low"), "low").otherwise("uncertain")
    return F.when(decision == "suppressed", "suppressed").when(decision.isin("flagged", "insufficient_evidence"), lowered).otherwise(level)


def screen_regions(regions: DataFrame, config: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """Decision, risk, attribution and adjusted tier per region.

    Only a hard check suppresses; summed risk alone at most flags.
    """
    checked = _with_checks(regions, config)
    s, each = Signals(checked), _each()
    total = F.lit(0.0)
    for c in each:
        total = total + c["weight"] * c["score"]
    small = (F.col("area_px") < config.min_area_px) & ~((F.col("area_px") <= 2) & s.flag("noise_spike"))
    terms = checked.withColumns({
        "_small": small,
        "_out": small | ~F.col("spectral_available"),
        "_hard": F.coalesce(*[F.when(c["hard"], name) for c, name in zip(each, CHECKS)]),
        "_heavy": F.greatest(*[F.when(c["detected"], c["weight"] * c["score"]) for c in each]),
        "_risk": F.round(F.least(F.lit(1.0), total), 4),
    })
    forced = (
        each[4]["detected"]
        | (each[0]["detected"] & each[0]["limited"] & (each[0]["score"] >= 0.40))
        | (each[1]["detected"] & each[1]["limited"] & (each[1]["score"] >= 0.35))
    )
    out, is_hard, risk = F.col("_out"), F.col("_hard").isNotNull(), F.col("_risk")
    basis = (
        F.when(out, "DATA_LIMITATION").when(is_hard, "CONSERVATIVE_MULTI_EVIDENCE").when(forced, "DATA_LIMITATION_OR_PARALLAX_FLAG")
        .when(risk < config.flag_risk, "LOW_ARTIFACT_RISK").when(risk < config.high_risk, "MODERATE_ARTIFACT_RISK").otherwise("HIGH_ARTIFACT_RISK_UNCONFIRMED")
    )
    terms = terms.withColumn("basis", basis)
    decision = (
        F.when(F.col("basis") == "DATA_LIMITATION", "insufficient_evidence").when(F.col("basis") == "CONSERVATIVE_MULTI_EVIDENCE", "suppressed")
        .when(F.col("basis") == "LOW_ARTIFACT_RISK", "retained").otherwise("flagged")
    )
    terms = terms.withColumn("decision", decision)
    # The heaviest check is named; of equal ones the first in order.
    heaviest = F.coalesce(*[F.when(c["detected"] & (c["weight"] * c["score"] == F.col("_heavy")), name) for c, name in zip(each, CHECKS)])
    category = F.col("category") if "category" in regions.columns else F.lit("unknown")
    tier = F.col("confidence_tier") if "confidence_tier" in regions.columns else F.lit("uncertain")
    empty = F.array().cast("array<string>")
    found = F.array_compact(F.array(*[F.when(c["detected"], name) for c, name in zip(each, CHECKS)]))
    limits = F.array_compact(F.array(
        F.when(F.col("_small"), "AREA_BELOW_MINIMUM"), F.when(~F.col("spectral_available"), "SPECTRAL_UNAVAILABLE"),
        *[F.when(c["limited"], f"{name}_UNCONFIRMED") for c, name in zip(each, CHECKS)],
    ))
    return terms.select(
        *regions.columns, "decision", F.when(out, 0.0).when(is_hard, 1.0).otherwise(risk).alias("risk"), "basis",
        F.when(out, None).when(is_hard, F.col("_hard")).otherwise(heaviest).alias("primary_artifact"),
        F.when(out, empty).otherwise(found).alias("contributing"),
        F.when(F.col("decision") == "suppressed", "suppressed").otherwise(category).alias("retained_category"),
        adjust_tier(tier, F.col("decision")).alias("adjusted_tier"),
        F.when(out, F.array().cast("array<struct<artifact: string, detected: boolean, score: double, weight: double, hard: boolean, limited: boolean>>")).otherwise(F.array(*each)).alias("checks"),
        # Why the region was decided so, and what the data could not show: stable codes, in order.
        F.concat(F.array("basis"), F.when(out, empty).otherwise(found)).alias("decision_reasons"), limits.alias("data_limitations"),
    )


def with_classification(evidence: DataFrame, classified: DataFrame) -> DataFrame:
    """Every region keeps its row; one without a classification is unknown and uncertain."""
    found = classified.select("pair_id", "region_id", "category", "confidence_tier")
    joined = evidence.join(found, ["pair_id", "region_id"], "left")
    return joined.withColumn("category", F.coalesce("category", F.lit("unknown"))).withColumn("confidence_tier", F.coalesce("confidence_tier", F.lit("uncertain")))


def suppression_metrics(screened: DataFrame) -> DataFrame:
    """Per pair: decisions, areas, suppression rate and regions per primary artifact."""
    def count(d):
        return F.count_if(F.col("decision") == d)

    def area(d):
        return F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("area_px"))), F.lit(0))

    return screened.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("total_regions"), count("retained").alias("retained"), count("flagged").alias("flagged"),
        count("suppressed").alias("suppressed"), count("insufficient_evidence").alias("insufficient"),
        F.round(count("suppressed") / F.count(F.lit(1)), 4).alias("suppression_rate"),
        F.sum("area_px").alias("total_area"), area("retained").alias("retained_area"), area("flagged").alias("flagged_area"), area("suppressed").alias("suppressed_area"),
        *[F.count_if(F.col("primary_artifact") == a).alias(f"by_{a.lower()}") for a in CHECKS],
    )
