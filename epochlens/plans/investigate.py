"""Investigations: from requests to timelines, for all requests at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from epochlens.config import ClassifierConfig, DetectionConfig, EvidenceConfig, ScreeningConfig, TimelineConfig
from epochlens.functions.text import content_id, pair_id, split_pair_id
from epochlens.operators import evidence, lineage, matching, pixels, rules, screening, timeline
from epochlens.operators.catalog import mark_simultaneous
from epochlens.session import cut


@dataclass(frozen=True)
class Settings:
    strategy: str = "adjacent"  # adjacent | baseline
    block: int = 512
    band_names: tuple[str, ...] = ("Band_1", "Band_2", "Band_3")
    detection: DetectionConfig = field(default_factory=DetectionConfig)
    evidence: EvidenceConfig = field(default_factory=EvidenceConfig)
    classifier: ClassifierConfig = field(default_factory=ClassifierConfig)
    screening: ScreeningConfig = field(default_factory=ScreeningConfig)
    timeline: TimelineConfig = field(default_factory=TimelineConfig)


@dataclass(frozen=True)
class Investigation:
    errors: DataFrame  # candidate_id, stage, error
    regions: DataFrame  # evidence, category and decision of every region
    matches: DataFrame  # candidate_id, pair_id, matched_region_id, ...
    timeline: DataFrame  # one row per candidate and observation
    summary: DataFrame  # one row per candidate
    stages: DataFrame  # artifact ids per candidate and pair


def validate_requests(requests: DataFrame, observations: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Requests with `stage` and `error`: the first thing that cannot be resolved.

    requests: candidate_id, series_id, pair_id, region_id. A pair belongs to a series when both of its
    observations do, in chronological order.
    """
    series = observations.select("series_id").distinct().withColumn("_series", F.lit(True))
    ends = split_pair_id(F.col("pair_id"))
    rows = requests.withColumn("earlier_id", ends["earlier"]).withColumn("later_id", ends["later"]).join(series, "series_id", "left")
    for side in ("earlier", "later"):
        known = observations.select(
            F.col("observation_id").alias(f"{side}_id"), F.col("series_id").alias(f"_{side}_series"), F.col("acquisition_time").alias(f"_{side}_time")
        )
        rows = rows.join(known, f"{side}_id", "left")
    unknown_pair = F.col("_earlier_series").isNull() | F.col("_later_series").isNull()
    foreign = (F.col("_earlier_series") != F.col("series_id")) | (F.col("_later_series") != F.col("series_id"))
    backwards = F.struct(F.col("_earlier_time").alias("t"), F.col("earlier_id").alias("i")) >= F.struct(F.col("_later_time").alias("t"), F.col("later_id").alias("i"))
    checks = [
        ("series_resolution", F.col("_series").isNull(), "unknown series"), ("discovery_pair_resolution", unknown_pair, "unknown pair"),
        ("discovery_pair_resolution", foreign, "pair belongs to another series"), ("discovery_pair_resolution", backwards, "pair is not in chronological order"),
    ]
    if regions is not None:
        found = regions.select("pair_id", "region_id").distinct().withColumn("_region", F.lit(True))
        rows = rows.join(found, ["pair_id", "region_id"], "left")
        checks.append(("candidate_region_validation", F.col("_region").isNull(), "unknown region"))
    stage, error = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, wrong, message in reversed(checks):
        wrong = F.coalesce(wrong, F.lit(False))
        stage, error = F.when(wrong, name).otherwise(stage), F.when(wrong, message).otherwise(error)
    return rows.select("candidate_id", "series_id", "pair_id", "region_id", "earlier_id", "later_id", stage.alias("stage"), error.alias("error"))


def default_requests(series: DataFrame, pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """The one request made when none is given: first series with four observations (else two), its earliest
    compatible pair, and the largest region of that pair.

    series: series_id, observation_count; pairs: as evaluated; regions: pair_id, region_id, area_px. Each step
    is a take of the first row, never a sort of the table.
    """
    band = F.when(F.col("observation_count") >= 4, 0).otherwise(1)
    first_series = series.where("observation_count >= 2").orderBy(band, "series_id").limit(1).select("series_id")
    own = pairs.where("check.compatible").join(first_series, "series_id", "left_semi")
    first_pair = own.orderBy("earlier.acquisition_time", "later.acquisition_time", "pair_id").limit(1).select("series_id", "pair_id")
    largest = regions.join(first_pair, "pair_id").orderBy(F.desc("area_px"), "region_id").limit(1)
    return largest.select(content_id("cand_", F.col("pair_id"), F.col("region_id")).alias("candidate_id"), "series_id", "pair_id", "region_id")


def analyse_pairs(pairs: DataFrame, rasters: DataFrame, frames: DataFrame, settings: Settings) -> DataFrame:
    """Detection, evidence, category and decision of every region of the given pairs."""
    run = pixels.detect(pairs, rasters, settings.detection, settings.block)
    members = cut(run.members)
    regions = pixels.region_stats(members, frames)
    wide = evidence.extract(
        run.scored, members, regions, run.aligned, pixels.valid_counts(run.scored),
        list(settings.band_names), settings.evidence, settings.block, settings.detection.nodata,
    )
    placed = regions.select("pair_id", "region_id", *matching.BOX, "lon", "lat", "area_m2")
    hints = pairs.select("pair_id", "cross_sensor") if "cross_sensor" in pairs.columns else pairs.select("pair_id", F.lit(False).alias("cross_sensor"))
    joined = wide.join(placed, ["pair_id", "region_id"]).join(hints, "pair_id")
    return screening.screen_regions(rules.classify_regions(joined, settings.classifier), settings.screening)


def investigate(requests: DataFrame, observations: DataFrame, rasters: DataFrame, frames_of: DataFrame, settings: Settings = Settings()) -> Investigation:
    """Run the whole chain for a table of requests; what cannot be resolved becomes an error row.

    frames_of: observation_id, frame_height, frame_width, box columns, resolution_m. Pairs shared by several
    requests are analysed once.
    """
    checked = validate_requests(requests, observations)
    good = checked.where("error IS NULL").drop("stage", "error")
    schedule = cut(timeline.pair_schedule(good, observations, settings.strategy).withColumn("pair_id", pair_id(F.col("earlier_id"), F.col("later_id"))))
    sensors = observations.select("observation_id", F.lower("sensor").alias("_s"))
    pairs = schedule.select("pair_id", "earlier_id", "later_id").distinct()
    for side in ("earlier", "later"):
        pairs = pairs.join(sensors.select(F.col("observation_id").alias(f"{side}_id"), F.col("_s").alias(f"_{side}")), f"{side}_id")
    pairs = cut(pairs.select("pair_id", "earlier_id", "later_id", (F.col("_earlier") != F.col("_later")).alias("cross_sensor")))
    frames = frames_of.withColumnRenamed("observation_id", "earlier_id").join(pairs.select("pair_id", "earlier_id"), "earlier_id").drop("earlier_id")
    regions = cut(analyse_pairs(pairs, rasters, frames, settings))

    validated = validate_requests(requests, observations, regions)
    errors = checked.where("error IS NOT NULL").select("candidate_id", "stage", "error").unionByName(
        validated.join(good.select("candidate_id"), "candidate_id", "left_semi").where("error IS NOT NULL").select("candidate_id", "stage", "error")
    )
    good = validated.where("error IS NULL").drop("stage", "error")
    schedule = schedule.join(good.select("candidate_id", "region_id", F.col("pair_id").alias("discovery_pair_id")), "candidate_id")

    place = regions.select(F.col("pair_id").alias("discovery_pair_id"), "region_id", *matching.BOX, "lon", "lat")
    candidates = schedule.join(place, ["discovery_pair_id", "region_id"])
    others = candidates.where("NOT is_discovery")
    met = matching.candidate_x_regions(others, regions, settings.timeline)
    resolved = matching.resolve_match(others.select("candidate_id", "pair_id", *matching.BOX, "lon", "lat"), met, settings.timeline, regions)
    own = candidates.where("is_discovery").select(
        "candidate_id", "pair_id", F.lit("EXACT_REFERENCE").alias("status"), F.lit("MATCHED").alias("relationship"),
        F.col("region_id").alias("matched_region_id"), F.lit(1.0).alias("iou"), F.lit(0.0).alias("distance_m"),
    )
    matches = cut(own.unionByName(resolved))

    timeline_rows = cut(build_timeline(good, schedule, observations, matches, regions, settings.timeline))
    summary = timeline.summarize(timeline_rows, settings.timeline)
    stages = schedule.select(
        "candidate_id", "pair_id", "discovery_pair_id", "region_id",
        *[content_id(prefix, F.col("pair_id"), F.lit(stage)).alias(name) for name, prefix, stage in (
            ("result_id", "res_", "detection"), ("evidence_id", "evi_", "evidence"), ("classification_id", "cls_", "classification"), ("suppression_id", "sup_", "screening"))],
    )
    return Investigation(errors, regions, matches, timeline_rows, summary, stages)


def build_timeline(requests: DataFrame, schedule: DataFrame, observations: DataFrame, matches: DataFrame, regions: DataFrame, config: TimelineConfig) -> DataFrame:
    """Every observation of the series of a request as an evaluated timeline node."""
    obs = mark_simultaneous(observations).select(
        "series_id", "observation_id", "acquisition_time", "sensor", "cloud_fraction", "valid_pixel_ratio", "is_simultaneous", F.struct(*matching.BOX).alias("_seen")
    )
    base = requests.select("candidate_id", "series_id", "region_id", "earlier_id", F.col("pair_id").alias("discovery_pair_id"))
    start = observations.select(F.col("observation_id").alias("earlier_id"), F.col("sensor").alias("discovery_sensor"))
    shape = regions.select(F.col("pair_id").alias("discovery_pair_id"), "region_id", F.struct(*matching.BOX).alias("_shape"))
    base = base.join(start, "earlier_id").join(shape, ["discovery_pair_id", "region_id"])
    nodes = obs.join(base, "series_id").withColumn("is_pre", F.col("observation_id") == F.col("earlier_id"))
    linked = schedule.select("candidate_id", F.col("later_id").alias("observation_id"), "pair_id").join(matches, ["candidate_id", "pair_id"])
    judged = regions.select(
        "pair_id", F.col("region_id").alias("matched_region_id"), "decision", F.col("mean_score").alias("change_score"),
        F.col("evidence_score").alias("class_score"), F.col("confidence_tier").alias("class_tier"), "category",
    )
    linked = linked.join(judged, ["pair_id", "matched_region_id"], "left").withColumn("_linked", F.lit(True))
    rows = nodes.join(linked, ["candidate_id", "observation_id"], "left").withColumns({
        "has_pair": F.coalesce("_linked", F.lit(False)),
        "covered": timeline.footprint_covers(F.col("_shape"), F.col("_seen")),
        "compatible": (F.col("relationship") == "MATCHED") & timeline.is_compatible(F.col("iou"), F.col("distance_m"), config),
    })
    rows = rows.withColumn("compatible", F.coalesce("compatible", F.lit(False))).drop("_linked", "_shape", "_seen")
    return timeline.assemble_timeline(timeline.evaluate_nodes(rows, config))


def dossiers(result: Investigation, requests: DataFrame, observations: DataFrame) -> DataFrame:
    """The flat dossier row of every investigated candidate, with its content id."""
    latest = observations.groupBy("series_id").agg(F.max("acquisition_time").alias("acquisition_time"))
    request = requests.select("candidate_id", "series_id", F.col("pair_id").alias("pair_key")).join(latest, "series_id")
    stages = result.stages.join(request, "candidate_id").withColumn("investigation_key", F.col("candidate_id"))
    ends = result.stages.select("candidate_id", F.explode(F.array(*[split_pair_id(F.col("pair_id"))[s] for s in ("earlier", "later")])).alias("observation_id")).distinct()
    hashes = ends.join(observations.select("observation_id", "source_hash"), "observation_id").select(
        F.col("candidate_id").alias("investigation_key"), F.col("observation_id").alias("key"), F.col("source_hash").alias("hash")
    )
    ids = lineage.investigation_ids(stages, hashes).withColumnRenamed("investigation_key", "candidate_id")
    refs = result.stages.groupBy("candidate_id").agg(*[F.max(c).alias(c) for c in ("result_id", "evidence_id", "classification_id", "suppression_id")])
    complete = lineage.lineage_completeness(ids.join(refs, "candidate_id").withColumn("timeline_id", content_id("tem_", F.col("candidate_id"), F.col("content_hash"))))
    shifts = result.matches.join(requests.select("candidate_id", "region_id"), "candidate_id")
    return lineage.dossier_summary(
        result.summary, matching.correspondence_summary(shifts), timeline.screening_summary(result.timeline.where("has_pair")), complete
    )
