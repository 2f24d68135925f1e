"""Timeline of a candidate: what each observation says, and when the change began.

A node is one observation of one candidate: (candidate_id, observation_id, acquisition_time, sensor, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from epochlens.config import TimelineConfig
from epochlens.functions import times
from epochlens.functions.text import split_pair_id
from epochlens.plans.ordered import DAY, keyed, ordered

KEY = ["candidate_id"]
# Weights of the support score.
GATES = {"retained": 1.0, "flagged": 0.40}
TIERS = {"high": 1.0, "medium": 0.85, "low": 0.70}
SUPPORTING = ("EARLIEST_SUPPORTING", "PERSISTENT_SUPPORT")
WITH_CATEGORY = (*SUPPORTING, "FLAGGED_SUPPORT")


def footprint_covers(candidate: Column, bounds: Column, tolerance: float = 1e-4) -> Column:
    """The candidate box meets the observed area; an unknown box counts as covered."""
    apart = (
        (candidate["max_lon"] < bounds["min_lon"] - tolerance) | (candidate["min_lon"] > bounds["max_lon"] + tolerance)
        | (candidate["max_lat"] < bounds["min_lat"] - tolerance) | (candidate["min_lat"] > bounds["max_lat"] + tolerance)
    )
    return ~F.coalesce(apart, F.lit(False))


def absence_verified(cloud: Column, valid: Column, covered: Column, config: TimelineConfig = TimelineConfig()) -> Column:
    """The place was clearly seen; unknown quality verifies nothing."""
    return F.coalesce((cloud <= config.max_cloud) & (valid >= config.min_valid) & covered, F.lit(False))


def is_compatible(iou: Column, distance: Column, config: TimelineConfig = TimelineConfig()) -> Column:
    return F.coalesce(iou >= config.min_iou, F.lit(False)) | F.coalesce(distance <= config.max_distance_m, F.lit(False))


def support_score(decision, iou, distance, compatible, cross_sensor, change, class_score, class_tier, config: TimelineConfig = TimelineConfig()) -> Column:
    """Heuristic support in 0..1 (4 dp); zero without a passing decision or a compatible place."""
    def weight(value, table, otherwise):
        out = F.lit(otherwise)
        for name, w in table.items():
            out = F.when(value == name, w).otherwise(out)
        return out

    gate, tier = weight(decision, GATES, 0.0), weight(class_tier, TIERS, 0.50)
    near = F.when(distance <= 30.0, 0.80).when(distance <= 60.0, 0.50).otherwise(0.0)
    place = F.when(iou >= config.min_iou, iou).otherwise(near)
    sensor = F.when(cross_sensor, 0.80).otherwise(1.0)
    raw = place * sensor * (0.40 * F.coalesce(change, F.lit(0.0)) + 0.60 * (F.coalesce(class_score, F.lit(0.50)) * tier))
    return F.when((gate > 0) & compatible, F.round(F.least(F.lit(1.0), gate * raw), 4)).otherwise(0.0)


def evaluate_nodes(nodes: DataFrame, config: TimelineConfig = TimelineConfig()) -> DataFrame:
    """Add cross_sensor, compatible, score, eligible and the provisional node_status."""
    decision = F.coalesce(F.lower("decision"), F.lit("insufficient_evidence"))
    covered = F.col("covered") if "covered" in nodes.columns else F.lit(True)
    plain = ~F.col("is_simultaneous") & ~F.col("is_pre") & F.col("has_pair")
    base = nodes.withColumns({
        "cross_sensor": F.lower("sensor") != F.lower("discovery_sensor"),
        "compatible": F.col("compatible") if "compatible" in nodes.columns else is_compatible(F.col("iou"), F.col("distance_m"), config),
    })
    score = support_score(
        decision, F.col("iou"), F.col("distance_m"), F.col("compatible"), F.col("cross_sensor"), F.col("change_score"), F.col("class_score"), F.col("class_tier"), config
    )
    base = base.withColumn("score", F.when(plain, score).otherwise(0.0))
    base = base.withColumn("eligible", plain & (decision == "retained") & F.col("compatible") & (F.col("score") >= config.min_support_score))
    status = (
        F.when(F.col("is_simultaneous"), "SIMULTANEOUS_CO_TEMPORAL")
        .when(F.col("is_pre") & absence_verified(F.col("cloud_fraction"), F.col("valid_pixel_ratio"), covered, config), "PRE_CHANGE_ABSENCE")
        .when(F.col("is_pre") | ~F.col("has_pair"), "INSUFFICIENT_DATA")
        .when(decision == "suppressed", "SUPPRESSED_ARTIFACT")
        .when(decision == "insufficient_evidence", "INSUFFICIENT_DATA")
        .when(decision == "flagged", "FLAGGED_SUPPORT")
        .when(F.col("eligible"), "EARLIEST_SUPPORTING")
        .when((F.col("score") < config.min_support_score) & F.col("compatible"), "NO_SUPPORT")
        .otherwise("INSUFFICIENT_DATA")
    )
    return base.withColumn("node_status", status)


def _moment() -> Column:
    return F.struct("acquisition_time", "observation_id")


def assemble_timeline(evaluated: DataFrame) -> DataFrame:
    """Only the first eligible node stays EARLIEST_SUPPORTING; the others become PERSISTENT_SUPPORT."""
    rows = keyed(evaluated, KEY, F.min(F.when(F.col("eligible"), _moment())).alias("earliest"))
    later = F.col("eligible") & (_moment() > F.col("earliest"))
    return rows.withColumn("node_status", F.when(later, "PERSISTENT_SUPPORT").otherwise(F.col("node_status")))


def _kinds() -> dict[str, Column]:
    status, decision = F.col("node_status"), F.lower("decision")
    return {
        "all": F.lit(True), "supporting": status.isin(*SUPPORTING), "absence": status == "PRE_CHANGE_ABSENCE",
        "flagged_suppressed": status.isin("FLAGGED_SUPPORT", "SUPPRESSED_ARTIFACT") | F.coalesce(decision.isin("flagged", "suppressed"), F.lit(False)),
    }


def filter_timeline(nodes: DataFrame, kind: str = "all") -> DataFrame:
    kinds = _kinds()
    if kind not in kinds:
        raise ValueError(f"unknown timeline filter {kind!r}")
    return nodes.where(kinds[kind])


def timeline_kinds(nodes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The rows of `filter_timeline` for each of the kinds, with a column `kind`; the timeline is computed once."""
    known = _kinds()
    if unknown := [k for k in kinds if k not in known]:
        raise ValueError(f"unknown timeline filter {unknown[0]!r}")
    met = F.array_compact(F.array(*[F.when(known[k], F.lit(k)) for k in kinds]))
    return nodes.withColumn("kind", F.explode(met))


def _count_aggs() -> list[Column]:
    def n(*statuses):
        return F.count_if(F.col("node_status").isin(*statuses))

    return [
        F.count(F.lit(1)).alias("nodes"), n(*SUPPORTING).alias("supporting"), n("FLAGGED_SUPPORT").alias("flagged"),
        n("SUPPRESSED_ARTIFACT").alias("suppressed"), n("PRE_CHANGE_ABSENCE").alias("absence"), n("INSUFFICIENT_DATA").alias("insufficient"),
        n("SIMULTANEOUS_CO_TEMPORAL").alias("simultaneous"), F.count_if("cross_sensor").alias("cross_sensor"),
    ]


def _moment_aggs() -> list[Column]:
    before = _moment() < F.col("earliest")
    status = F.col("node_status")
    return [
        F.max("earliest").alias("earliest"),
        F.max(F.when(before & (status == "PRE_CHANGE_ABSENCE"), _moment())).alias("prior"),
        F.min(F.when(before & (status == "FLAGGED_SUPPORT"), _moment())).alias("flagged_before"),
    ]


def timeline_metrics(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy(*KEY).agg(*_count_aggs())


def key_moments(timeline: DataFrame) -> DataFrame:
    """Per candidate: first support, last verified absence before it, first flagged node before it."""
    return timeline.groupBy(*KEY).agg(*_moment_aggs())


def category_trajectory(timeline: DataFrame) -> DataFrame:
    """(candidate_id, place, observation_id, category): the category of every supporting or flagged node in order of time,
    from place 1. Rows and not a list, so a candidate of any length is spread over tasks."""
    seen = timeline.where(F.col("node_status").isin(*WITH_CATEGORY) & F.col("category").isNotNull())
    placed = ordered(seen.select(*KEY, "acquisition_time", "observation_id", "category"), KEY, "acquisition_time", "observation_id", rank="place")
    return placed.select(*KEY, F.col("place").cast("bigint").alias("place"), "observation_id", "category")


def category_evolution(timeline: DataFrame) -> DataFrame:
    """Categories in order of first appearance, first, last and most frequent one, the steps between neighbours with
    their kind (`emerged`, `built_on_clearing`, `conflict`, `change`), whether they conflict and whether they are valid."""
    seen = timeline.where(F.col("node_status").isin(*WITH_CATEGORY) & F.col("category").isNotNull())
    per_category = seen.groupBy(*KEY, "category").agg(
        F.count(F.lit(1)).alias("n"), F.min(_moment()).alias("first"), F.max(_moment()).alias("last")
    )
    # At most one row per category is left for each candidate.
    rows = per_category.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("first", "category", "n", "last"))).alias("_in_order"),
        F.max_by("category", "last").alias("last_category"), F.sum("n").alias("categorised_nodes"),
    )
    in_order = F.transform("_in_order", lambda x: x["category"])
    most = F.array_sort(F.transform("_in_order", lambda x, i: F.struct((-x["n"]).alias("n"), i.alias("i"), x["category"].alias("category"))))
    rows = rows.select(*KEY, in_order.alias("categories"), F.get(in_order, F.lit(0)).alias("first_category"), "last_category", F.get(most, F.lit(0))["category"].alias("primary_category"), "categorised_nodes")
    # Which steps say something. Water next to a structure on the same ground contradicts it.
    built = ("construction", "road_development")

    def kind(a, b):
        clash = ((a == "water_extent_change") & b.isin(*built)) | ((b == "water_extent_change") & a.isin(*built))
        return F.when(a == "unknown", "emerged").when((a == "clearance") & (b == "construction"), "built_on_clearing").when(clash, "conflict").otherwise("change")

    follow = F.filter(F.transform("categories", lambda c, i: F.struct(c.alias("a"), F.get("categories", i + 1).alias("b"))), lambda s: s["b"].isNotNull())
    steps = F.transform(follow, lambda s: F.concat_ws(":", s["a"], s["b"], kind(s["a"], s["b"])))
    rows = rows.withColumn("steps", steps)
    conflicted = F.exists("steps", lambda x: x.endswith(":conflict"))
    return rows.withColumns({"is_conflicted": conflicted, "is_evolution_valid": ~conflicted})


def support_status(metrics: DataFrame, evolution: DataFrame, config: TimelineConfig = TimelineConfig()) -> DataFrame:
    rows = metrics.join(evolution, KEY, "left").withColumn("is_conflicted", F.coalesce("is_conflicted", F.lit(False)))
    status = (
        F.when(F.col("is_conflicted"), "TEMPORALLY_AMBIGUOUS")
        .when(F.col("supporting") >= config.min_persistent, "STRONG_TEMPORAL_SUPPORT")
        .when(F.col("supporting") == 1, "SINGLE_OBSERVATION_SUPPORT")
        .when(F.col("flagged") > 0, "FLAGGED_PENDING_REVIEW")
        .when(F.col("insufficient") == F.col("nodes"), "INSUFFICIENT_DATA")
        .otherwise("NO_SUPPORT")
    )
    return rows.withColumn("support_status", status)


def onset_interval(moments: DataFrame) -> DataFrame:
    """Half-open interval in which the change began, and the closed span shown for it."""
    start, end = F.col("prior.acquisition_time"), F.col("earliest.acquisition_time")
    kind = F.when(end.isNull(), "UNRESOLVED").when(start.isNull(), "LEFT_UNBOUNDED").otherwise("BOUNDED_HALF_OPEN")

    def day(t):
        return F.date_format(t, "yyyy-MM-dd")

    text = F.when(start.isNotNull(), F.concat(F.lit("("), day(start), F.lit(", "), day(end), F.lit("]"))).when(
        end.isNotNull(), F.concat(F.lit("(-infinity, "), day(end), F.lit("]"))
    )
    # Fixed format: the same bounds as a closed span, for display.
    shown = F.when(end.isNotNull(), F.concat(F.lit("["), F.coalesce(day(start), F.lit("None")), F.lit(", "), day(end), F.lit("]")))
    carried = [c for c in moments.columns if c not in (*KEY, "earliest", "prior", "flagged_before")]
    return moments.select(
        *KEY, *carried, kind.alias("interval_type"),
        F.col("prior.observation_id").alias("prior_id"), F.col("earliest.observation_id").alias("earliest_id"), F.col("flagged_before.observation_id").alias("flagged_id"),
        F.round(times.seconds_between(start, end) / 86400.0, 2).alias("interval_days"), text.alias("interval"), shown.alias("display_span"),
    )


def confidence_tier(status: Column, cross_sensor_nodes: Column, prior: Column, days: Column, config: TimelineConfig = TimelineConfig()) -> Column:
    strong = F.when((cross_sensor_nodes > 0) | prior.isNull() | F.coalesce(days > config.max_gap_days, F.lit(False)), "medium").otherwise("high")
    return F.when(status == "STRONG_TEMPORAL_SUPPORT", strong).when(status == "SINGLE_OBSERVATION_SUPPORT", "low").otherwise("uncertain")


def decision_reasons(summary: DataFrame, config: TimelineConfig = TimelineConfig()) -> tuple[Column, Column]:
    """Codes of the reasons for a candidate's status and of the limitations of its tier, each an array in a fixed order.

    summary: the columns of `support_status` over `onset_interval`.
    """
    found = F.col("earliest_id").isNotNull()
    status = F.col("support_status")
    strong = status == "STRONG_TEMPORAL_SUPPORT"

    def listed(pairs):
        return F.filter(F.array(*[F.when(condition, code) for condition, code in pairs]), lambda c: c.isNotNull())

    reasons = listed([
        (found, "earliest_support"), (F.col("is_conflicted"), "conflicting_categories"), (strong, "persistent_support"),
        (status == "SINGLE_OBSERVATION_SUPPORT", "single_support"), (status == "FLAGGED_PENDING_REVIEW", "flagged_only"),
        (status == "INSUFFICIENT_DATA", "insufficient_series"), (status == "NO_SUPPORT", "no_supporting_observation"),
        (F.col("interval_type") == "BOUNDED_HALF_OPEN", "onset_bounded"), (F.col("interval_type") == "LEFT_UNBOUNDED", "onset_left_unbounded"),
    ])
    crossed, unverified = F.col("cross_sensor") > 0, F.col("prior_id").isNull()
    limitations = listed([
        (F.col("flagged_id").isNotNull(), "flagged_before_support"), (strong & crossed, "tier_capped_by_sensor_change"), (strong & ~crossed & unverified, "absence_unverified"),
        (strong & ~crossed & ~unverified & F.coalesce(F.col("interval_days") > config.max_gap_days, F.lit(False)), "interval_beyond_gap"),
    ])
    return reasons, limitations


def summarize(timeline: DataFrame, config: TimelineConfig = TimelineConfig()) -> DataFrame:
    """One row per candidate with counts, support, onset, categories, confidence, reasons and limitations."""
    figures = timeline.groupBy(*KEY).agg(*_count_aggs(), *_moment_aggs())
    rows = support_status(onset_interval(figures), category_evolution(timeline), config)
    tier = confidence_tier(F.col("support_status"), F.col("cross_sensor"), F.col("prior_id"), F.col("interval_days"), config)
    reasons, limitations = decision_reasons(rows, config)
    return rows.withColumns({"confidence_tier": tier, "reasons": reasons, "limitations": limitations})


def screening_summary(nodes: DataFrame) -> DataFrame:
    def n(d):
        return F.count_if(F.lower("decision") == d)

    out = nodes.groupBy(*KEY).agg(n("retained").alias("retained"), n("flagged").alias("flagged"), n("suppressed").alias("suppressed"))
    return out.withColumn("outcome", F.when(F.col("suppressed") > 0, "SUPPRESSED").when(F.col("flagged") > 0, "FLAGGED_RISK").otherwise("PASS"))


def align_evidence(evidence: DataFrame, observations: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """Later observation of each pair: by time within the tolerance, else by the id in the pair id, else the next free one.

    evidence: series_id, pair_id, later_time. Times meet in buckets as wide as the tolerance.
    """
    width = int(tolerance_s * 1_000_000)
    bucket = F.floor(F.unix_micros("later_time") / F.lit(width))
    obs = observations.select("series_id", "observation_id", "acquisition_time")
    placed = obs.withColumn("_b", F.floor(F.unix_micros("acquisition_time") / F.lit(width)))
    wide = evidence.select("series_id", "pair_id", "later_time", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    near = F.abs(F.unix_micros("acquisition_time") - F.unix_micros("later_time")) < width
    by_time = wide.join(placed, ["series_id", "_b"]).where(near).groupBy("series_id", "pair_id").agg(F.min(_moment())["observation_id"].alias("_by_time"))
    named = obs.select("series_id", F.col("observation_id").alias("_by_name"))
    rows = evidence.select("series_id", "pair_id", "later_time", split_pair_id(F.col("pair_id"))["later"].alias("_by_name"))
    rows = rows.join(by_time, ["series_id", "pair_id"], "left").join(named.withColumn("_known", F.lit(True)), ["series_id", "_by_name"], "left")
    found = F.coalesce("_by_time", F.when(F.col("_known"), F.col("_by_name")))
    rows = rows.select("series_id", "pair_id", "later_time", found.alias("observation_id"))

    taken = rows.where("observation_id IS NOT NULL").select("series_id", "observation_id").distinct()
    free = ordered(obs.join(taken, ["series_id", "observation_id"], "left_anti"), ["series_id"], "acquisition_time", "observation_id", rank="_slot")
    open_rows = ordered(rows.where("observation_id IS NULL").drop("observation_id"), ["series_id"], "later_time", "pair_id", rank="_slot")
    filled = open_rows.join(free.select("series_id", "_slot", "observation_id"), ["series_id", "_slot"], "left")
    return rows.where("observation_id IS NOT NULL").select("series_id", "pair_id", "observation_id").unionByName(filled.select("series_id", "pair_id", "observation_id"))


def pair_schedule(requests: DataFrame, observations: DataFrame, strategy: str = "adjacent", width_us: int = DAY) -> DataFrame:
    """The discovery pair and one pair for every later observation of the series.

    requests: candidate_id, series_id, earlier_id, later_id. `adjacent` pairs an observation with its
    predecessor, `baseline` with the earlier observation of the discovery pair.
    """
    if strategy not in ("adjacent", "baseline"):
        raise ValueError(f"unknown pairing strategy {strategy!r}")
    obs = observations.select("series_id", "observation_id", "acquisition_time")
    ranked = ordered(obs, ["series_id"], "acquisition_time", "observation_id", prev="_prev", width_us=width_us)
    start = requests.join(
        obs.withColumnRenamed("observation_id", "later_id").withColumnRenamed("acquisition_time", "_from"), ["series_id", "later_id"]
    )
    after = ranked.join(start, "series_id").where(
        F.struct(F.col("acquisition_time"), F.col("observation_id")) >= F.struct(F.col("_from"), F.col("later_id"))
    )
    discovery = F.col("observation_id") == F.col("later_id")
    partner = F.col("earlier_id") if strategy == "baseline" else F.col("_prev.observation_id")
    return after.select(
        "candidate_id", "series_id", F.when(discovery, F.col("earlier_id")).otherwise(partner).alias("earlier_id"),
        F.col("observation_id").alias("later_id"), discovery.alias("is_discovery"),
    )
