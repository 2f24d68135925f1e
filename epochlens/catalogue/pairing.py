"""Pairing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalogue.registry import query
from epochlens.config import PairingConfig
from epochlens.operators import pairing

ADJACENT = """a AS (SELECT series_id, observation_id AS e_id, acquisition_time AS e_ts, sensor AS e_sensor, platform AS e_platform, min_lon AS ex0, min_lat AS ey0, max_lon AS ex1, max_lat AS ey1,
      lead(observation_id) OVER w AS l_id, lead(acquisition_time) OVER w AS l_ts, lead(sensor) OVER w AS l_sensor, lead(platform) OVER w AS l_platform,
      lead(min_lon) OVER w AS lx0, lead(min_lat) OVER w AS ly0, lead(max_lon) OVER w AS lx1, lead(max_lat) OVER w AS ly1
    FROM fx_observations WINDOW w AS (PARTITION BY series_id ORDER BY acquisition_time, observation_id))"""
CHECKED = ADJACENT + """, o AS (SELECT *, (epoch_us(l_ts) - epoch_us(e_ts)) / 1e6 AS gap, greatest(ex0, lx0) < least(ex1, lx1) AND greatest(ey0, ly0) < least(ey1, ly1) AS ov,
      (least(ex1, lx1) - greatest(ex0, lx0)) * (least(ey1, ly1) - greatest(ey0, ly0)) AS ia, (ex1 - ex0) * (ey1 - ey0) AS ea, (lx1 - lx0) * (ly1 - ly0) AS la FROM a WHERE l_id IS NOT NULL),
    c AS (SELECT *, CASE WHEN ov THEN round(least(1e0, ia / (ea + la - ia)), 4) ELSE 0e0 END AS iou, CASE WHEN ov THEN round(least(1e0, ia / least(ea, la)), 4) ELSE 0e0 END AS min_ratio FROM o)"""
STRICT = PairingConfig(min_separation_s=3600.0, max_separation_s=86400.0, min_overlap=0.3, overlap_metric="min", require_same_sensor=True, require_same_platform=True)


@query("d02_pairs_adjacent", f"WITH {ADJACENT} SELECT concat('pair_', e_id, '__', l_id) AS pair_id, e_id, l_id FROM a WHERE l_id IS NOT NULL")
def adjacent(t):
    return pairing.pairs_adjacent(t.fx_observations).select(
        "pair_id", F.col("earlier.observation_id").alias("e_id"), F.col("later.observation_id").alias("l_id")
    )


@query("d03_pairs_baseline", """
    WITH b AS (SELECT series_id, observation_id AS l_id, first_value(observation_id) OVER (PARTITION BY series_id ORDER BY acquisition_time, observation_id) AS e_id FROM fx_observations)
    SELECT series_id, e_id, l_id FROM b WHERE e_id <> l_id""")
def baseline(t):
    return pairing.pairs_baseline(t.fx_observations).select(
        "series_id", F.col("earlier.observation_id").alias("e_id"), F.col("later.observation_id").alias("l_id")
    )


@query("d04_pairs_all", """
    SELECT e.observation_id AS e_id, l.observation_id AS l_id FROM fx_observations e JOIN fx_observations l ON e.series_id = l.series_id
      AND (e.acquisition_time, e.observation_id) < (l.acquisition_time, l.observation_id) AND epoch_us(l.acquisition_time) - epoch_us(e.acquisition_time) <= 86400000000""")
def within(t):
    return pairing.pairs_within(t.fx_observations, 86400.0).select(
        F.col("earlier.observation_id").alias("e_id"), F.col("later.observation_id").alias("l_id")
    )


@query("d04_pair_counts", """
    SELECT series_id, count(*) - 1 AS adjacent, count(*) - 1 AS baseline, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS all_pairwise FROM fx_observations GROUP BY series_id""")
def pair_counts(t):
    return pairing.pair_counts(t.fx_observations)


@query("c03_pair_status", f"""
    WITH {CHECKED} SELECT concat('pair_', e_id, '__', l_id) AS pair_id, round(gap / 86400e0, 4) AS days, iou, lower(e_sensor) <> lower(l_sensor) AS cross_sensor, lower(e_platform) <> lower(l_platform) AS cross_platform,
      CASE WHEN gap = 0 THEN 'IDENTICAL_TIMESTAMPS' WHEN NOT ov OR iou < 0.5e0 THEN 'INSUFFICIENT_OVERLAP' ELSE 'COMPATIBLE' END AS status,
      CASE WHEN gap = 0 THEN 'IDENTICAL_TIMESTAMPS' WHEN gap < 3600 THEN 'BELOW_MIN_INTERVAL' WHEN gap > 86400 THEN 'EXCEEDS_MAX_INTERVAL' WHEN NOT ov OR min_ratio < 0.3e0 THEN 'INSUFFICIENT_OVERLAP'
        WHEN lower(e_sensor) <> lower(l_sensor) THEN 'INCOMPATIBLE_SENSOR' WHEN lower(e_platform) <> lower(l_platform) THEN 'INCOMPATIBLE_PLATFORM' ELSE 'COMPATIBLE' END AS strict_status FROM c""")
def status(t):
    pairs = pairing.evaluate(pairing.pairs_adjacent(t.fx_observations))
    strict = pairing.pair_status(F.col("earlier"), F.col("later"), STRICT)
    return pairs.select(
        "pair_id", "check.days", F.col("check.overlap.ratio_iou").alias("iou"), "check.cross_sensor", "check.cross_platform", "check.status",
        strict["status"].alias("strict_status"),
    )


@query("c04_split_pairs", f"""
    WITH {CHECKED} SELECT concat('pair_', e_id, '__', l_id) AS pair_id, CASE WHEN gap > 0 AND ov AND iou >= 0.5e0 THEN 'valid' ELSE 'rejected' END AS side FROM c""")
def split(t):
    valid, rejected = pairing.split_pairs(pairing.evaluate(pairing.pairs_adjacent(t.fx_observations)))
    return valid.select("pair_id", F.lit("valid").alias("side")).unionByName(rejected.select("pair_id", F.lit("rejected").alias("side")))


@query("g01_order_pairs", f"WITH {ADJACENT} SELECT concat('pair_', e_id, '__', l_id) AS pair_id, epoch_us(e_ts) AS e_us, epoch_us(l_ts) AS l_us FROM a WHERE l_id IS NOT NULL ORDER BY e_ts, l_ts, pair_id")
def order(t):
    return pairing.order_pairs(pairing.pairs_adjacent(t.fx_observations)).select(
        "pair_id", F.unix_micros("earlier.acquisition_time").alias("e_us"), F.unix_micros("later.acquisition_time").alias("l_us")
    )


@query("h04_duplicate_pair_check", "SELECT pair_id, count(*) AS times FROM fx_regions GROUP BY pair_id HAVING count(*) > 1")
def duplicates(t):
    return pairing.duplicate_pairs(t.fx_regions)


@query("minimum_slice_pair_status", f"""
    WITH {CHECKED} SELECT CASE WHEN gap = 0 THEN 'IDENTICAL_TIMESTAMPS' WHEN NOT ov OR iou < 0.5e0 THEN 'INSUFFICIENT_OVERLAP' ELSE 'COMPATIBLE' END AS status, count(*) AS pairs FROM c GROUP BY 1""")
def minimum_slice(t):
    pairs = pairing.evaluate(pairing.pairs_adjacent(t.fx_observations))
    return pairs.groupBy(F.col("check.status").alias("status")).agg(F.count(F.lit(1)).alias("pairs"))
