"""Matching and timeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalogue.registry import query
from epochlens.catalogue.scalars import HAVERSINE, METRIC_IOU
from epochlens.catalogue.views import EXTRA_SQL
from epochlens.functions import geo
from epochlens.operators import matching, timeline
from epochlens.plans.ordered import ordered


def centered(df):
    lon, lat = geo.center(matching.box_of())
    return df.withColumns({"lon": lon, "lat": lat})


def met(t):
    return matching.candidate_x_regions(centered(t.fx_candidates), centered(t.fx_region_boxes))


DISTANCE = HAVERSINE.format(lon1="(a.min_lon + a.max_lon) / 2", lat1="((a.min_lat + a.max_lat) / 2)", lon2="(b.min_lon + b.max_lon) / 2", lat2="((b.min_lat + b.max_lat) / 2)")
IOU_SHARED = METRIC_IOU.format(a="a", b="b")
EXTRA_SQL["fx_met"] = f"""
    SELECT * FROM (SELECT a.candidate_id, a.pair_id, b.region_id, {IOU_SHARED} AS iou, {DISTANCE} AS distance_m FROM fx_candidates a JOIN fx_region_boxes b ON a.pair_id = b.pair_id) WHERE iou > 0 OR distance_m <= 60"""
EXTRA_SQL["fx_match"] = """
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, pair_id ORDER BY iou DESC, region_id) AS rn, lead(iou) OVER (PARTITION BY candidate_id, pair_id ORDER BY iou DESC, region_id) AS nxt FROM fx_met WHERE iou >= 0.30e0),
    d AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, pair_id ORDER BY distance_m, region_id) AS rn, lead(distance_m) OVER (PARTITION BY candidate_id, pair_id ORDER BY distance_m, region_id) AS nxt FROM fx_met WHERE distance_m <= 60)
    SELECT c.candidate_id, c.pair_id, CASE WHEN o.region_id IS NOT NULL THEN 'GEOREFERENCED_BBOX' WHEN d.region_id IS NOT NULL THEN 'GEOREFERENCED_CENTROID_ONLY' ELSE 'DISJOINT' END AS status,
      CASE WHEN o.region_id IS NOT NULL THEN CASE WHEN o.nxt IS NULL OR o.iou - o.nxt >= 0.05e0 THEN 'MATCHED' ELSE 'AMBIGUOUS' END WHEN d.region_id IS NOT NULL THEN CASE WHEN d.nxt IS NULL OR d.nxt - d.distance_m >= 15 THEN 'MATCHED' ELSE 'AMBIGUOUS' END ELSE 'NONE' END AS relationship,
      CASE WHEN o.region_id IS NOT NULL THEN CASE WHEN o.nxt IS NULL OR o.iou - o.nxt >= 0.05e0 THEN o.region_id END WHEN d.region_id IS NOT NULL THEN CASE WHEN d.nxt IS NULL OR d.nxt - d.distance_m >= 15 THEN d.region_id END END AS matched_region_id,
      CASE WHEN o.region_id IS NOT NULL THEN o.iou WHEN d.region_id IS NOT NULL THEN CASE WHEN d.nxt IS NULL OR d.nxt - d.distance_m >= 15 THEN d.iou ELSE 0e0 END ELSE coalesce((SELECT max(m.iou) FROM fx_met m WHERE m.candidate_id = c.candidate_id), 0e0) END AS iou
    FROM fx_candidates c LEFT JOIN o ON o.candidate_id = c.candidate_id AND o.rn = 1 LEFT JOIN d ON d.candidate_id = c.candidate_id AND d.rn = 1"""


# Places all over the world, some beside the meridian of 180 degrees, in five pairs.
EXTRA_SQL["fx_places"] = """
    SELECT concat('place_', c_custkey) AS place_id, concat('world_', c_custkey % 5) AS pair_id, c_custkey % 3 = 0 AS is_region,
      CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 179.9997e0 ELSE -179.9997e0 END ELSE ((c_custkey * 37) % 3600) * 0.1e0 - 180e0 END AS lon, ((c_custkey * 11) % 170) * 1e0 - 85e0 AS lat FROM customer"""
PLACE_DISTANCE = HAVERSINE.format(lon1="a.lon", lat1="a.lat", lon2="b.lon", lat2="b.lat")


def _places(t):
    n = F.col("c_custkey")
    east = F.when(n % 2 == 0, F.lit(179.9997)).otherwise(F.lit(-179.9997))
    rows = t.table("customer").select(
        F.concat(F.lit("place_"), n).alias("place_id"), F.concat(F.lit("world_"), n % 5).alias("pair_id"), (n % 3 == 0).alias("is_region"),
        F.when(n % 7 == 0, east).otherwise(((n * 37) % 3600) * F.lit(0.1) - F.lit(180.0)).alias("lon"), (((n * 11) % 170) * F.lit(1.0) - F.lit(85.0)).alias("lat"),
    )
    rows = rows.withColumns({c: F.col(c[4:]) for c in matching.BOX})
    return rows.where("NOT is_region").withColumnRenamed("place_id", "candidate_id"), rows.where("is_region").withColumnRenamed("place_id", "region_id")


@query("m02_nearest_region", f"SELECT a.place_id AS candidate_id, a.pair_id, min({PLACE_DISTANCE}) AS distance_m FROM fx_places a JOIN fx_places b ON a.pair_id = b.pair_id AND NOT a.is_region AND b.is_region GROUP BY ALL")
def nearest_region(t):
    return matching.nearest_regions(*_places(t))


@query("d06_across_meridian", f"SELECT candidate_id, region_id, distance_m FROM (SELECT a.place_id AS candidate_id, b.place_id AS region_id, {PLACE_DISTANCE} AS distance_m FROM fx_places a JOIN fx_places b ON a.pair_id = b.pair_id AND NOT a.is_region AND b.is_region) WHERE distance_m <= 60")
def across_meridian(t):
    return matching.candidate_x_regions(*_places(t)).where("distance_m <= 60").select("candidate_id", "region_id", "distance_m")


@query("d06_candidate_x_regions", "SELECT candidate_id, pair_id, region_id, iou, distance_m FROM fx_met")
def candidate_x_regions(t):
    return met(t).where("iou > 0 OR distance_m <= 60")


@query("m01_spatial_correspondence", f"""
    SELECT candidate_id, region_id, iou >= 0.30e0 OR distance_m <= 60 AS compatible, CASE WHEN iou < 0.30e0 AND distance_m > 60 AND iou = 0 THEN 'NONE' ELSE 'MATCHED' END AS relationship,
      CASE WHEN iou < 0.30e0 AND distance_m > 120 THEN 'DISJOINT' WHEN CAST(substring(candidate_id, 6) AS BIGINT) % 2 = 0 THEN 'EXACT_PIXEL_GRID' ELSE 'GEOREFERENCED_BBOX' END AS status
    FROM (SELECT a.candidate_id, b.region_id, {IOU_SHARED} AS iou, {DISTANCE} AS distance_m FROM fx_candidates a JOIN fx_region_boxes b ON a.pair_id = b.pair_id)""")
def correspondence(t):
    a = centered(t.fx_candidates).select("candidate_id", "pair_id", F.struct(matching.box_of().alias("box"), "lon", "lat").alias("a"))
    b = centered(t.fx_region_boxes).select("pair_id", "region_id", F.struct(matching.box_of().alias("box"), "lon", "lat").alias("b"))
    even = F.substring("candidate_id", 6, 20).cast("bigint") % 2 == 0
    none = F.lit(None).cast("double")
    grid = geo.grid_compat(F.lit("EPSG:32643"), F.when(even, "EPSG:32643").otherwise("EPSG:4326"), none, none, F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>"))
    c = matching.spatial_correspondence(F.col("a.box"), F.col("a.lon"), F.col("a.lat"), F.col("b.box"), F.col("b.lon"), F.col("b.lat"), grid, F.lit(3.0))
    rows = a.join(b, "pair_id").select("candidate_id", "region_id", c.alias("c"))
    return rows.select("candidate_id", "region_id", "c.compatible", "c.relationship", "c.status")


@query("m02_resolve_match", "SELECT candidate_id, pair_id, status, relationship, matched_region_id, iou FROM fx_match")
def resolve(t):
    return matching.resolve_match(centered(t.fx_candidates), met(t)).drop("distance_m")


@query("m02_resolve_match_distance", f"""
    WITH n AS (SELECT a.candidate_id, a.pair_id, min({DISTANCE}) AS nearest FROM fx_candidates a JOIN fx_region_boxes b ON a.pair_id = b.pair_id GROUP BY ALL)
    SELECT m.candidate_id, m.relationship, n.nearest AS distance_m FROM fx_match m LEFT JOIN n ON n.candidate_id = m.candidate_id AND n.pair_id = m.pair_id WHERE m.relationship = 'NONE'""")
def resolve_distance(t):
    candidates, regions = centered(t.fx_candidates), centered(t.fx_region_boxes)
    found = matching.with_nearest(matching.resolve_match(candidates, met(t)), candidates, regions)
    return found.where("relationship = 'NONE'").select("candidate_id", "relationship", "distance_m")


@query("m03_match_scores", "SELECT candidate_id, pair_id, region_id, iou FROM fx_met WHERE iou > 0")
def scores(t):
    return matching.match_scores(met(t)).where("iou > 0")


@query("e09_correspondence_summary", """
    SELECT candidate_id, count(*) AS epochs, round(avg(coalesce(iou, 0e0)), 2) AS average_iou, CAST(count(*) FILTER (matched_region_id <> 'reg_0') AS BIGINT) AS shifted_ids, avg(iou) >= 0.5e0 AS is_stable FROM fx_match GROUP BY candidate_id""")
def correspondence_summary(t):
    matches = matching.resolve_match(centered(t.fx_candidates), met(t)).withColumn("region_id", F.lit("reg_0"))
    return matching.correspondence_summary(matches).drop("max_drift_m")


# The sensor of the first observation stands for the discovery sensor.
EXTRA_SQL["fx_evaluated"] = """
    WITH a AS (SELECT *, lower(sensor) <> lower(first_value(sensor) OVER (PARTITION BY candidate_id ORDER BY acquisition_time, observation_id)) AS cross_sensor, iou >= 0.30e0 OR coalesce(distance_m <= 60, false) AS compatible,
        NOT is_simultaneous AND NOT is_pre AND has_pair AS plain, coalesce(decision, 'insufficient_evidence') AS dec FROM fx_nodes),
    b AS (SELECT *, CASE WHEN plain AND compatible AND dec IN ('retained', 'flagged') THEN round(least(1e0, if(dec = 'retained', 1e0, 0.40e0) * (CASE WHEN iou >= 0.30e0 THEN iou WHEN distance_m <= 30 THEN 0.80e0 WHEN distance_m <= 60 THEN 0.50e0 ELSE 0e0 END
        * if(cross_sensor, 0.80e0, 1e0) * (0.40e0 * change_score + 0.60e0 * (coalesce(class_score, 0.50e0) * CASE class_tier WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.85e0 WHEN 'low' THEN 0.70e0 ELSE 0.50e0 END)))), 4) ELSE 0e0 END AS score FROM a),
    c AS (SELECT *, plain AND dec = 'retained' AND compatible AND score >= 0.45e0 AS eligible FROM b)
    SELECT *, CASE WHEN is_simultaneous THEN 'SIMULTANEOUS_CO_TEMPORAL' WHEN is_pre AND coalesce(cloud_fraction <= 0.10e0 AND valid_pixel_ratio >= 0.90e0, false) THEN 'PRE_CHANGE_ABSENCE' WHEN is_pre OR NOT has_pair THEN 'INSUFFICIENT_DATA'
      WHEN dec = 'suppressed' THEN 'SUPPRESSED_ARTIFACT' WHEN dec = 'insufficient_evidence' THEN 'INSUFFICIENT_DATA' WHEN dec = 'flagged' THEN 'FLAGGED_SUPPORT' WHEN eligible THEN 'EARLIEST_SUPPORTING' WHEN score < 0.45e0 AND compatible THEN 'NO_SUPPORT' ELSE 'INSUFFICIENT_DATA' END AS provisional FROM c"""
EXTRA_SQL["fx_timeline"] = """
    SELECT *, CASE WHEN eligible AND rn > earliest_rn THEN 'PERSISTENT_SUPPORT' ELSE provisional END AS node_status FROM (
      SELECT *, min(CASE WHEN eligible THEN rn END) OVER (PARTITION BY candidate_id) AS earliest_rn FROM (
        SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY acquisition_time, observation_id) AS rn FROM fx_evaluated))"""
EXTRA_SQL["fx_timeline_counts"] = """
    SELECT candidate_id, count(*) AS nodes, CAST(count(*) FILTER (node_status IN ('EARLIEST_SUPPORTING', 'PERSISTENT_SUPPORT')) AS BIGINT) AS supporting, CAST(count(*) FILTER (node_status = 'FLAGGED_SUPPORT') AS BIGINT) AS flagged,
      CAST(count(*) FILTER (node_status = 'SUPPRESSED_ARTIFACT') AS BIGINT) AS suppressed, CAST(count(*) FILTER (node_status = 'PRE_CHANGE_ABSENCE') AS BIGINT) AS absence, CAST(count(*) FILTER (node_status = 'INSUFFICIENT_DATA') AS BIGINT) AS insufficient,
      CAST(count(*) FILTER (node_status = 'SIMULTANEOUS_CO_TEMPORAL') AS BIGINT) AS simultaneous, CAST(count(*) FILTER (cross_sensor) AS BIGINT) AS cross_sensor FROM fx_timeline GROUP BY candidate_id"""
EXTRA_SQL["fx_category_order"] = """
    SELECT candidate_id, category, count(*) AS n, min(rn) AS first_rn, max(rn) AS last_rn FROM fx_timeline WHERE node_status IN ('EARLIEST_SUPPORTING', 'PERSISTENT_SUPPORT', 'FLAGGED_SUPPORT') AND category IS NOT NULL GROUP BY ALL"""
EXTRA_SQL["fx_evolution"] = """
    WITH s AS (SELECT *, lead(category) OVER (PARTITION BY candidate_id ORDER BY first_rn) AS nxt FROM fx_category_order)
    SELECT candidate_id, string_agg(category, ',' ORDER BY first_rn) AS categories, arg_min(category, first_rn) AS first_category, arg_max(category, last_rn) AS last_category, arg_min(category, (-n, first_rn)) AS primary_category,
      coalesce(bool_or((category = 'water_extent_change' AND nxt IN ('construction', 'road_development')) OR (nxt = 'water_extent_change' AND category IN ('construction', 'road_development'))), false) AS is_conflicted FROM s GROUP BY candidate_id"""
EXTRA_SQL["fx_support"] = """
    SELECT c.*, coalesce(is_conflicted, false) AS is_conflicted, CASE WHEN coalesce(is_conflicted, false) THEN 'TEMPORALLY_AMBIGUOUS' WHEN supporting >= 2 THEN 'STRONG_TEMPORAL_SUPPORT' WHEN supporting = 1 THEN 'SINGLE_OBSERVATION_SUPPORT'
      WHEN flagged > 0 THEN 'FLAGGED_PENDING_REVIEW' WHEN insufficient = nodes THEN 'INSUFFICIENT_DATA' ELSE 'NO_SUPPORT' END AS support_status FROM fx_timeline_counts c LEFT JOIN fx_evolution USING (candidate_id)"""
EXTRA_SQL["fx_moments"] = """
    SELECT candidate_id, max(CASE WHEN rn = earliest_rn THEN observation_id END) AS earliest_id, max(CASE WHEN rn = earliest_rn THEN acquisition_time END) AS earliest_time,
      arg_max(observation_id, rn) FILTER (node_status = 'PRE_CHANGE_ABSENCE' AND rn < earliest_rn) AS prior_id, max(acquisition_time) FILTER (node_status = 'PRE_CHANGE_ABSENCE' AND rn < earliest_rn) AS prior_time,
      arg_min(observation_id, rn) FILTER (node_status = 'FLAGGED_SUPPORT' AND rn < earliest_rn) AS flagged_id FROM fx_timeline GROUP BY candidate_id"""
EXTRA_SQL["fx_onset"] = """
    SELECT *, CASE WHEN earliest_id IS NULL THEN 'UNRESOLVED' WHEN prior_id IS NULL THEN 'LEFT_UNBOUNDED' ELSE 'BOUNDED_HALF_OPEN' END AS interval_type, round((epoch_us(earliest_time) - epoch_us(prior_time)) / 1e6 / 86400e0, 2) AS interval_days,
      CASE WHEN earliest_id IS NOT NULL THEN concat('[', coalesce(strftime(prior_time, '%Y-%m-%d'), 'None'), ', ', strftime(earliest_time, '%Y-%m-%d'), ']') END AS display_span,
      CASE WHEN prior_id IS NOT NULL THEN concat('(', strftime(prior_time, '%Y-%m-%d'), ', ', strftime(earliest_time, '%Y-%m-%d'), ']') WHEN earliest_id IS NOT NULL THEN concat('(-infinity, ', strftime(earliest_time, '%Y-%m-%d'), ']') END AS interval FROM fx_moments"""
EXTRA_SQL["fx_candidate_summary"] = """
    SELECT s.*, o.* EXCLUDE (candidate_id), e.* EXCLUDE (candidate_id, is_conflicted), CASE support_status WHEN 'STRONG_TEMPORAL_SUPPORT' THEN CASE WHEN cross_sensor > 0 OR prior_id IS NULL OR interval_days > 90 THEN 'medium' ELSE 'high' END WHEN 'SINGLE_OBSERVATION_SUPPORT' THEN 'low' ELSE 'uncertain' END AS confidence_tier
    FROM fx_support s JOIN fx_onset o USING (candidate_id) LEFT JOIN fx_evolution e USING (candidate_id)"""


def nodes(t):
    """Nodes with the sensor of the first observation of their candidate."""
    rows = ordered(t.fx_nodes, ["candidate_id"], "acquisition_time", "observation_id", first="_first", payload=["sensor"])
    return rows.withColumn("discovery_sensor", F.col("_first.sensor")).drop("_first")


def evaluated(t):
    return timeline.evaluate_nodes(nodes(t))


def assembled(t):
    return timeline.assemble_timeline(evaluated(t))


@query("c09_footprint_covers", """
    SELECT candidate_id, pair_id, region_id, NOT (c.max_lon < r.min_lon - 1e-4 OR c.min_lon > r.max_lon + 1e-4 OR c.max_lat < r.min_lat - 1e-4 OR c.min_lat > r.max_lat + 1e-4) AS covered FROM fx_candidates c JOIN fx_region_boxes r USING (pair_id)""")
def covers(t):
    a = t.fx_candidates.select("candidate_id", "pair_id", matching.box_of().alias("a"))
    b = t.fx_region_boxes.select("pair_id", "region_id", matching.box_of().alias("b"))
    return a.join(b, "pair_id").select("candidate_id", "pair_id", "region_id", timeline.footprint_covers(F.col("a"), F.col("b")).alias("covered"))


@query("m05_pre_change_node", "SELECT observation_id, coalesce(cloud_fraction <= 0.10e0 AND valid_pixel_ratio >= 0.90e0, false) AS verified FROM fx_observations")
def pre_change(t):
    return t.fx_observations.select("observation_id", timeline.absence_verified(F.col("cloud_fraction"), F.col("valid_pixel_ratio"), F.lit(True)).alias("verified"))


@query("m06_support_score", "SELECT candidate_id, observation_id, cross_sensor, compatible, score, eligible FROM fx_evaluated")
def support(t):
    return evaluated(t).select("candidate_id", "observation_id", "cross_sensor", "compatible", "score", "eligible")


@query("m07_node_status", "SELECT candidate_id, observation_id, provisional AS node_status FROM fx_evaluated")
def node_status(t):
    return evaluated(t).select("candidate_id", "observation_id", "node_status")


@query("m08_assemble_timeline", "SELECT candidate_id, observation_id, node_status FROM fx_timeline")
def assemble(t):
    return assembled(t).select("candidate_id", "observation_id", "node_status")


@query("f04_earliest_support", "SELECT candidate_id, earliest_id FROM fx_moments")
def earliest(t):
    return timeline.key_moments(assembled(t)).select("candidate_id", F.col("earliest.observation_id").alias("earliest_id"))


@query("f05_first_flagged_before", "SELECT candidate_id, flagged_id FROM fx_moments")
def flagged_before(t):
    return timeline.key_moments(assembled(t)).select("candidate_id", F.col("flagged_before.observation_id").alias("flagged_id"))


@query("d13_nearest_prior", "SELECT candidate_id, prior_id, epoch_us(prior_time) AS prior_us FROM fx_moments")
def nearest_prior(t):
    return timeline.key_moments(assembled(t)).select(
        "candidate_id", F.col("prior.observation_id").alias("prior_id"), F.unix_micros("prior.acquisition_time").alias("prior_us")
    )


@query("e08_timeline_metrics", "SELECT * FROM fx_timeline_counts")
def metrics(t):
    return timeline.timeline_metrics(assembled(t))


@query("f07_distinct_in_order", "SELECT candidate_id, categories FROM fx_evolution")
def distinct_in_order(t):
    return timeline.category_evolution(assembled(t)).select("candidate_id", F.array_join("categories", ",").alias("categories"))


@query("m09_category_trajectory", """
    SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY rn) AS place, observation_id, category FROM fx_timeline WHERE node_status IN ('EARLIEST_SUPPORTING', 'PERSISTENT_SUPPORT', 'FLAGGED_SUPPORT') AND category IS NOT NULL""")
def trajectory(t):
    return timeline.category_trajectory(assembled(t))


@query("m09_category_steps", """
    WITH s AS (SELECT *, lead(category) OVER (PARTITION BY candidate_id ORDER BY first_rn) AS nxt FROM fx_category_order),
    k AS (SELECT candidate_id, first_rn, concat_ws(':', category, nxt, CASE WHEN category = 'unknown' THEN 'emerged' WHEN category = 'clearance' AND nxt = 'construction' THEN 'built_on_clearing'
      WHEN (category = 'water_extent_change' AND nxt IN ('construction', 'road_development')) OR (nxt = 'water_extent_change' AND category IN ('construction', 'road_development')) THEN 'conflict' ELSE 'change' END) AS step FROM s WHERE nxt IS NOT NULL)
    SELECT candidate_id, coalesce(string_agg(step, ',' ORDER BY first_rn), '') AS steps, NOT coalesce(bool_or(step LIKE '%:conflict'), false) AS is_evolution_valid FROM fx_category_order LEFT JOIN k USING (candidate_id, first_rn) GROUP BY candidate_id""")
def steps(t):
    return timeline.category_evolution(assembled(t)).select("candidate_id", F.array_join("steps", ",").alias("steps"), "is_evolution_valid")


@query("m09_category_evolution", "SELECT candidate_id, first_category, last_category, primary_category, is_conflicted FROM fx_evolution")
def evolution(t):
    return timeline.category_evolution(assembled(t)).drop("categories", "categorised_nodes", "steps", "is_evolution_valid")


@query("m10_support_status", "SELECT candidate_id, supporting, is_conflicted, support_status FROM fx_support")
def support_status(t):
    rows = assembled(t)
    return timeline.support_status(timeline.timeline_metrics(rows), timeline.category_evolution(rows)).select("candidate_id", "supporting", "is_conflicted", "support_status")


@query("m11_onset_interval", "SELECT candidate_id, interval_type, prior_id, earliest_id, flagged_id, interval_days, interval, display_span FROM fx_onset")
def onset(t):
    return timeline.onset_interval(timeline.key_moments(assembled(t)))


@query("m12_confidence_tier", "SELECT candidate_id, support_status, confidence_tier FROM fx_candidate_summary")
def confidence(t):
    return timeline.summarize(assembled(t)).select("candidate_id", "support_status", "confidence_tier")


@query("m12_decision_reasons", """
    SELECT candidate_id, concat_ws(',', CASE WHEN earliest_id IS NOT NULL THEN 'earliest_support' END, CASE WHEN is_conflicted THEN 'conflicting_categories' END,
        CASE support_status WHEN 'STRONG_TEMPORAL_SUPPORT' THEN 'persistent_support' WHEN 'SINGLE_OBSERVATION_SUPPORT' THEN 'single_support' WHEN 'FLAGGED_PENDING_REVIEW' THEN 'flagged_only' WHEN 'INSUFFICIENT_DATA' THEN 'insufficient_series' WHEN 'NO_SUPPORT' THEN 'no_supporting_observation' END,
        CASE interval_type WHEN 'BOUNDED_HALF_OPEN' THEN 'onset_bounded' WHEN 'LEFT_UNBOUNDED' THEN 'onset_left_unbounded' END) AS reasons,
      concat_ws(',', CASE WHEN flagged_id IS NOT NULL THEN 'flagged_before_support' END,
        CASE WHEN support_status = 'STRONG_TEMPORAL_SUPPORT' THEN CASE WHEN cross_sensor > 0 THEN 'tier_capped_by_sensor_change' WHEN prior_id IS NULL THEN 'absence_unverified' WHEN interval_days > 90 THEN 'interval_beyond_gap' END END) AS limitations FROM fx_candidate_summary""")
def reasons(t):
    return timeline.summarize(assembled(t)).select("candidate_id", F.array_join("reasons", ",").alias("reasons"), F.array_join("limitations", ",").alias("limitations"))


@query("e10_screening_summary", """
    SELECT candidate_id, CAST(count(*) FILTER (decision = 'retained') AS BIGINT) AS retained, CAST(count(*) FILTER (decision = 'flagged') AS BIGINT) AS flagged, CAST(count(*) FILTER (decision = 'suppressed') AS BIGINT) AS suppressed,
      CASE WHEN count(*) FILTER (decision = 'suppressed') > 0 THEN 'SUPPRESSED' WHEN count(*) FILTER (decision = 'flagged') > 0 THEN 'FLAGGED_RISK' ELSE 'PASS' END AS outcome FROM fx_nodes GROUP BY candidate_id""")
def screening_summary(t):
    return timeline.screening_summary(t.fx_nodes)


@query("c06_filter_timeline", """
    SELECT kind, candidate_id, observation_id FROM (SELECT 'supporting' AS kind, * FROM fx_timeline WHERE node_status IN ('EARLIEST_SUPPORTING', 'PERSISTENT_SUPPORT') UNION ALL SELECT 'absence', * FROM fx_timeline WHERE node_status = 'PRE_CHANGE_ABSENCE'
      UNION ALL SELECT 'flagged_suppressed', * FROM fx_timeline WHERE node_status IN ('FLAGGED_SUPPORT', 'SUPPRESSED_ARTIFACT') OR decision IN ('flagged', 'suppressed'))""")
def filter_timeline(t):
    kinds = timeline.timeline_kinds(assembled(t), ("supporting", "absence", "flagged_suppressed"))
    return kinds.select("kind", "candidate_id", "observation_id")


@query("d09_evidence_to_observation", """
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY acquisition_time, observation_id) AS rn FROM fx_observations),
    e AS (SELECT series_id, observation_id, rn, rn % 3 AS kind, acquisition_time FROM o),
    t AS (SELECT e.series_id, e.observation_id AS origin, arg_min(o.observation_id, o.rn) AS hit FROM e JOIN o ON o.series_id = e.series_id AND e.kind = 0 AND abs(epoch_us(o.acquisition_time) - (epoch_us(e.acquisition_time) + 400000)) < 1000000 GROUP BY ALL),
    k AS (SELECT series_id, origin, hit FROM t UNION ALL SELECT series_id, observation_id, observation_id FROM e WHERE kind = 1),
    f AS (SELECT o.series_id, o.observation_id, row_number() OVER (PARTITION BY o.series_id ORDER BY o.rn) AS slot FROM o ANTI JOIN k ON k.series_id = o.series_id AND k.hit = o.observation_id),
    u AS (SELECT series_id, observation_id AS origin, row_number() OVER (PARTITION BY series_id ORDER BY rn) AS slot FROM e WHERE kind = 2)
    SELECT series_id, origin, hit AS observation_id FROM k UNION ALL SELECT series_id, origin, f.observation_id FROM u LEFT JOIN f USING (series_id, slot)""")
def align(t):
    obs = ordered(t.fx_observations, ["series_id"], "acquisition_time", "observation_id", rank="rn")
    kind = F.col("rn") % 3
    shift = F.when(kind == 0, F.expr("acquisition_time + INTERVAL '0.4' SECOND")).otherwise(F.expr("acquisition_time + INTERVAL '9000' DAY"))
    pair = F.concat(F.lit("pair_x__"), F.when(kind == 1, F.col("observation_id")).otherwise(F.concat(F.lit("none-"), "observation_id")))
    evidence = obs.select("series_id", pair.alias("pair_id"), shift.alias("later_time"))
    out = timeline.align_evidence(evidence, t.fx_observations)
    origin = F.regexp_replace(F.regexp_replace("pair_id", "^pair_x__", ""), "^none-", "")
    return out.select("series_id", origin.alias("origin"), "observation_id")


@query("m04_pair_schedule", """
    WITH o AS (SELECT series_id, observation_id, row_number() OVER w AS rn, lag(observation_id) OVER w AS prev, nth_value(observation_id, 1) OVER w2 AS first_id FROM fx_observations WINDOW w AS (PARTITION BY series_id ORDER BY acquisition_time, observation_id), w2 AS (PARTITION BY series_id ORDER BY acquisition_time, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT 'adjacent' AS strategy, series_id AS candidate_id, prev AS earlier_id, observation_id AS later_id, rn = 2 AS is_discovery FROM o WHERE rn >= 2 UNION ALL SELECT 'baseline', series_id, first_id, observation_id, rn = 2 FROM o WHERE rn >= 2""")
def schedule(t):
    ranked = ordered(t.fx_observations.select("series_id", "observation_id", "acquisition_time"), ["series_id"], "acquisition_time", "observation_id", rank="rn", prev="p")
    requests = ranked.where("rn = 2").select(F.col("series_id").alias("candidate_id"), "series_id", F.col("p.observation_id").alias("earlier_id"), F.col("observation_id").alias("later_id"))
    out = None
    for strategy in ("adjacent", "baseline"):
        part = timeline.pair_schedule(requests, t.fx_observations, strategy).select(F.lit(strategy).alias("strategy"), "candidate_id", "earlier_id", "later_id", "is_discovery")
        out = part if out is None else out.unionByName(part)
    return out
