"""Lineage, review and investigation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlens.catalogue.registry import query
from epochlens.catalogue.timeline import assembled
from epochlens.catalogue.views import EXTRA_SQL
from epochlens.config import ClassifierConfig, DetectionConfig, EvidenceConfig, ScreeningConfig
from epochlens.operators import catalog, lineage, matching, pairing, reviews, timeline
from epochlens.plans import investigate as plan
from epochlens.plans.ordered import ordered
from epochlens.session import cut


@query("o01_lineage_edges", """
    SELECT DISTINCT parent_id, child_id, stage FROM (SELECT unnest([scene_id, tile_id, observation_id, pair_id, result_id, evidence_id, classification_id, suppression_id, timeline_id]) AS parent_id,
      unnest([tile_id, observation_id, pair_id, result_id, evidence_id, classification_id, suppression_id, timeline_id, dossier_id]) AS child_id, unnest(['tile', 'observation', 'pair', 'result', 'evidence', 'classification', 'suppression', 'timeline', 'dossier']) AS stage FROM fx_stages)
    WHERE parent_id IS NOT NULL AND child_id IS NOT NULL""")
def edges(t):
    return lineage.lineage_edges(t.fx_stages)


@query("o02_upstream_hashes", "SELECT investigation_id, key, arg_max(hash, position) AS hash FROM fx_hashes GROUP BY ALL")
def hashes(t):
    return lineage.upstream_hashes(t.fx_hashes)



PARTS = ("pair_id", "result_id", "evidence_id", "classification_id", "suppression_id")


def _digest(x):
    lanes = [f"printf('%016x', CAST(coalesce(sum(CAST(('0x' || substring(sha256({x}), {1 + 8 * i}, 8)) AS BIGINT)), 0) AS BIGINT))" for i in range(8)]
    return f"sha256(concat({', '.join(lanes)}, CAST(count({x}) AS VARCHAR)))"


def _known(x):
    return f"coalesce({x}, '\u2205')"


EXTRA_SQL["fx_investigation_ids"] = f"""
    WITH v AS ({' UNION '.join(f"SELECT DISTINCT investigation_id AS k, series_id, discovery_pair_id AS dp, region_id, '{p}' AS part, {p} AS value FROM fx_stages" for p in PARTS)}),
    d AS (SELECT k, series_id, dp, region_id, part, {_digest('value')} AS digest FROM v GROUP BY ALL),
    s AS (SELECT k, series_id, dp, region_id, {', '.join(f"max(digest) FILTER (part = '{p}') AS {p}" for p in PARTS)} FROM d GROUP BY ALL),
    c AS (SELECT investigation_id AS k, max(acquisition_time) AS created_at FROM fx_stages GROUP BY ALL),
    n AS (SELECT DISTINCT investigation_id AS k, concat_ws('=', {_known('key')}, {_known('hash')}) AS x FROM (SELECT investigation_id, key, arg_max(hash, position) AS hash FROM fx_hashes GROUP BY ALL)),
    h AS (SELECT k, {_digest('x')} AS src FROM n GROUP BY ALL)
    SELECT k AS investigation_key, substring(sha256(concat_ws(':', {', '.join(_known(x) for x in ('series_id', 'dp', 'region_id', *PARTS, 'src'))}, 'v1')), 1, 16) AS content_hash, created_at
    FROM s LEFT JOIN c USING (k) LEFT JOIN h USING (k)"""


def ids(t):
    stages = t.fx_stages.withColumnRenamed("investigation_id", "investigation_key").withColumn("pair_key", F.col("discovery_pair_id"))
    sources = lineage.upstream_hashes(t.fx_hashes).withColumnRenamed("investigation_id", "investigation_key")
    return lineage.investigation_ids(stages, sources, "v1")


@query("o03_investigation_id", "SELECT investigation_key, concat('inv_', content_hash) AS investigation_id, content_hash, epoch_us(created_at) AS created_us FROM fx_investigation_ids")
def investigation_ids(t):
    return ids(t).select("investigation_key", "investigation_id", "content_hash", F.unix_micros("created_at").alias("created_us"))


@query("o04_provenance_of_scene", """
    SELECT tile_id AS target_id, source_scene_id, 'tiling' AS processing_stage FROM fx_tiles WHERE source_scene_id = 'scene_77'""")
def provenance_of_scene(t):
    from epochlens.sources.tables import provenance_rows

    records = provenance_rows(t.fx_tiles, "tiling", F.col("tile_id"), F.col("source_scene_id"), "tiler", at=F.col("acquisition_time"))
    return lineage.provenance_of_scene(records, "scene_77").select("target_id", "source_scene_id", "processing_stage")


@query("o05_lineage_completeness", """
    WITH d AS (SELECT concat_ws(',', CASE WHEN o_custkey % 11 = 0 THEN 'content_hash' END, CASE WHEN result_id IS NULL THEN 'result_id' END, CASE WHEN evidence_id IS NULL THEN 'evidence_id' END, CASE WHEN suppression_id IS NULL THEN 'suppression_id' END) AS missing, * FROM fx_stages)
    SELECT o_orderkey, missing, CASE WHEN missing = '' THEN 8 ELSE 7 - (length(missing) - length(replace(missing, ',', ''))) END AS present, CASE WHEN o_custkey % 11 = 0 THEN 'INSUFFICIENT' WHEN missing <> '' THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness FROM d""")
def completeness(t):
    rows = t.fx_stages.withColumn("provenance_id", F.lit("prov")).withColumn("content_hash", F.when(F.col("o_custkey") % 11 != 0, "hash"))
    return lineage.lineage_completeness(rows).select("o_orderkey", F.array_join("missing", ",").alias("missing"), "present", "completeness")


@query("o06_epoch_lineage", """
    SELECT s.investigation_id, s.pair_id, concat('obs_', CAST(o_orderkey AS VARCHAR)) AS earlier_id, concat('obs_', CAST(o_orderkey + 1 AS VARCHAR)) AS later_id, result_id,
      CASE WHEN o_orderkey % 3 = 0 THEN concat('reg_', CAST(o_orderkey % 5 AS VARCHAR)) WHEN pair_id = discovery_pair_id THEN region_id END AS matched_region_id,
      CASE WHEN o_orderkey % 3 = 0 THEN 'MATCHED' WHEN pair_id = discovery_pair_id THEN 'MATCHED' ELSE 'UNRESOLVED' END AS relationship,
      coalesce(CASE WHEN o_orderkey % 3 = 0 THEN concat('reg_', CAST(o_orderkey % 5 AS VARCHAR)) WHEN pair_id = discovery_pair_id THEN region_id END <> region_id, false) AS is_id_shifted FROM fx_stages s""")
def epoch_lineage(t):
    matches = t.fx_stages.where("o_orderkey % 3 = 0").select(
        "investigation_id", "pair_id", F.concat(F.lit("reg_"), F.col("o_orderkey") % 5).alias("matched_region_id"), F.lit(0.5).alias("iou"), F.lit(1.0).alias("distance_m"), F.lit("MATCHED").alias("relationship")
    )
    return lineage.epoch_lineage(t.fx_stages, matches).select("investigation_id", "pair_id", "earlier_id", "later_id", "result_id", "matched_region_id", "relationship", "is_id_shifted")


@query("o12_stage_log", """
    SELECT investigation_id, pair_id, stage, artifact_id, CASE WHEN artifact_id IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM (SELECT investigation_id, pair_id,
      unnest(['detection', 'evidence', 'classification', 'screening', 'timeline']) AS stage, unnest([result_id, evidence_id, classification_id, suppression_id, timeline_id]) AS artifact_id FROM fx_stages)""")
def stage_log(t):
    return lineage.stage_log(t.fx_stages)


EXTRA_SQL["fx_ledger"] = """
    SELECT investigation_id, 'input' AS stage_id, key AS artifact_id, hash, NULL AS source_pair_id, 'VERIFIED_INPUT' AS status FROM (SELECT investigation_id, key, arg_max(hash, position) AS hash FROM fx_hashes GROUP BY ALL)
    UNION ALL SELECT investigation_id, stage, coalesce(artifact_id, '-'), NULL, pair_id, CASE WHEN artifact_id IS NULL THEN 'FAILED' ELSE 'COMPLETED' END FROM (SELECT investigation_id, pair_id,
      unnest(['detection', 'evidence', 'classification', 'screening', 'timeline']) AS stage, unnest([result_id, evidence_id, classification_id, suppression_id, timeline_id]) AS artifact_id FROM fx_stages)
    UNION ALL SELECT investigation_key, 'dossier', investigation_key, content_hash, NULL, 'COMPLETED' FROM fx_investigation_ids"""


def ledger(t):
    dossiers = ids(t).withColumn("investigation_id", F.col("investigation_key"))
    return lineage.artifact_ledger(lineage.upstream_hashes(t.fx_hashes), t.fx_stages, dossiers)


@query("h01_artifact_ledger", "SELECT * FROM fx_ledger")
def artifact_ledger(t):
    return ledger(t).select("investigation_id", "stage_id", "artifact_id", "hash", "source_pair_id", "status")


@query("c07_search_artifacts", """
    SELECT investigation_id, stage_id, artifact_id FROM fx_ledger WHERE contains(artifact_id, 'es_12') OR contains(coalesce(hash, ''), 'es_12') OR contains(coalesce(source_pair_id, ''), 'es_12')""")
def search_artifacts(t):
    return lineage.search_artifacts(ledger(t), "ES_12").select("investigation_id", "stage_id", "artifact_id")


@query("o13_node_correspondence", """
    WITH n AS (SELECT *, rn FROM fx_timeline), e AS (SELECT candidate_id, observation_id AS later_id, rn - 1 AS position, CASE WHEN event_id % 4 = 0 THEN 'reg_b' ELSE 'reg_a' END AS m, iou FROM fx_timeline WHERE event_id % 3 <> 0),
    j AS (SELECT n.*, coalesce(a.m, b.m) AS m, coalesce(a.iou, b.iou) AS miou, coalesce(a.candidate_id, b.candidate_id) IS NOT NULL AS hit, node_status = 'PRE_CHANGE_ABSENCE' OR n.rn = 1 AS base FROM n
      LEFT JOIN e a ON a.candidate_id = n.candidate_id AND a.later_id = n.observation_id LEFT JOIN e b ON b.candidate_id = n.candidate_id AND b.position + 1 = n.rn)
    SELECT candidate_id, observation_id, CASE WHEN base THEN 'reg_a' ELSE coalesce(m, 'reg_a') END AS matched_region_id, NOT base AND coalesce(m, 'reg_a') <> 'reg_a' AS is_id_shifted,
      CASE WHEN base THEN 1e0 WHEN hit THEN miou ELSE iou END AS iou, CASE WHEN base THEN 'PRE_CHANGE_BASELINE' WHEN hit THEN 'MATCHED' ELSE 'NONE' END AS relationship FROM j""")
def node_correspondence(t):
    rows = ordered(assembled(t), ["candidate_id"], "acquisition_time", "observation_id", rank="node_rank").withColumn("region_id", F.lit("reg_a"))
    epochs = rows.where("event_id % 3 <> 0").select(
        "candidate_id", F.col("observation_id").alias("later_id"), (F.col("node_rank") - 1).alias("position"),
        F.when(F.col("event_id") % 4 == 0, "reg_b").otherwise("reg_a").alias("matched_region_id"), "iou", F.lit(0.0).alias("distance_m"), F.lit("MATCHED").alias("relationship"), F.lit("GEOREFERENCED_BBOX").alias("status"),
    )
    return lineage.node_correspondence(rows, epochs).select("candidate_id", "observation_id", "matched_region_id", "is_id_shifted", "iou", "relationship")


@query("o14_dossier_summary", """
    SELECT c.candidate_id, support_status, confidence_tier, interval_type, primary_category, s.outcome, m.average_iou, 'COMPLETE' AS completeness FROM fx_candidate_summary c
      JOIN (SELECT candidate_id, CASE WHEN count(*) FILTER (decision = 'suppressed') > 0 THEN 'SUPPRESSED' WHEN count(*) FILTER (decision = 'flagged') > 0 THEN 'FLAGGED_RISK' ELSE 'PASS' END AS outcome FROM fx_nodes GROUP BY ALL) s USING (candidate_id)
      JOIN (SELECT candidate_id, round(avg(iou), 2) AS average_iou FROM fx_nodes GROUP BY ALL) m USING (candidate_id)""")
def dossier_summary(t):
    rows = assembled(t)
    matches = t.fx_nodes.select("candidate_id", F.lit("r").alias("region_id"), F.lit("r").alias("matched_region_id"), "iou", "distance_m")
    refs = t.fx_nodes.select("candidate_id").distinct().select("candidate_id", *[F.lit("x").alias(c) for c in lineage.REFERENCES])
    out = lineage.dossier_summary(timeline.summarize(rows), matching.correspondence_summary(matches), timeline.screening_summary(t.fx_nodes), lineage.lineage_completeness(refs))
    return out.select("candidate_id", "support_status", "confidence_tier", "interval_type", "primary_category", "outcome", "average_iou", "completeness")


# Reviews

EXTRA_SQL["fx_review_rows"] = """
    SELECT investigation_id, region_id, event_id, ts, note, CASE WHEN upper(decision) IN ('CONFIRM', 'CONFIRMED') THEN 'CONFIRMED' WHEN upper(decision) IN ('REJECT', 'REJECTED') THEN 'REJECTED' ELSE 'PENDING' END AS decision FROM fx_reviews"""
EXTRA_SQL["fx_review_log"] = """
    WITH p AS (SELECT *, lag(decision) OVER w AS pd, lag(note) OVER w AS pn FROM fx_review_rows WINDOW w AS (PARTITION BY investigation_id, region_id ORDER BY ts, event_id)),
    k AS (SELECT * FROM p WHERE pd IS NULL OR pd <> decision OR pn <> note)
    SELECT investigation_id, region_id, event_id, ts, decision, note, pd AS previous_decision, row_number() OVER w AS revision, first_value(ts) OVER w AS created_at FROM k WINDOW w AS (PARTITION BY investigation_id, region_id ORDER BY ts, event_id)"""


def log(t):
    """The log after two batches, split by time."""
    first = cut(reviews.review_append(None, t.fx_reviews.where("ts < '2024-01-15'")))
    return first.unionByName(reviews.review_append(first, t.fx_reviews.where("ts >= '2024-01-15'")))


@query("f08_revision_number", """
    SELECT event_id, row_number() OVER w AS revision, lag(decision) OVER w AS previous_decision, epoch_us(first_value(ts) OVER w) AS created_us FROM fx_review_rows WINDOW w AS (PARTITION BY investigation_id, region_id ORDER BY ts, event_id)""")
def revisions(t):
    return reviews.revision_number(reviews.normalize(t.fx_reviews)).select("event_id", "revision", "previous_decision", F.unix_micros("created_at").alias("created_us"))


@query("o07_review_append", """
    SELECT concat('rev_', investigation_id, '_', region_id, '_r', CAST(revision AS VARCHAR)) AS review_id, event_id, revision, decision, note, previous_decision, epoch_us(created_at) AS created_us FROM fx_review_log""")
def review_append(t):
    return log(t).select("review_id", "event_id", "revision", "decision", "note", "previous_decision", F.unix_micros("created_at").alias("created_us"))


@query("o08_review_audit_hash", """
    SELECT event_id, sha256(concat('{"analystId":"analyst_local","analystNote":"', note, '","candidateRegionId":"', region_id, '","createdAt":"', strftime(created_at, '%Y-%m-%dT%H:%M:%S.'), printf('%03d', (epoch_us(created_at) % 1000000) // 1000), 'Z","decision":"', decision,
      '","investigationId":"', investigation_id, '","previousDecision":"', coalesce(previous_decision, ''), '","reasonCode":"","revisionNumber":', CAST(revision AS VARCHAR), ',"selectedReason":"","updatedAt":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.'), printf('%03d', (epoch_us(ts) % 1000000) // 1000), 'Z"}')) AS audit_hash FROM fx_review_log""")
def audit(t):
    return log(t).select("event_id", "audit_hash")


@query("o09_review_history", "SELECT region_id, revision, decision FROM fx_review_log WHERE investigation_id = 'inv_7'")
def history(t):
    return reviews.review_history(log(t), "inv_7").select("region_id", "revision", "decision")


@query("o10_review_latest", "SELECT investigation_id, region_id, max(revision) AS revision, arg_max(decision, revision) AS decision FROM fx_review_log GROUP BY ALL")
def latest(t):
    return reviews.review_latest(log(t)).select("investigation_id", "region_id", "revision", "decision")


@query("o11_review_export", """
    WITH t AS (SELECT investigation_id, region_id, count(*) AS total_revisions FROM fx_review_log GROUP BY ALL)
    SELECT investigation_id, region_id, CAST(floor((revision - 1) / 5) AS INT) AS page, any_value(total_revisions) AS total_revisions, CAST(count(*) AS BIGINT) AS revisions, min(revision) AS first_revision FROM fx_review_log JOIN t USING (investigation_id, region_id) GROUP BY ALL""")
def export(t):
    out = reviews.review_export(log(t), 5)
    doc = F.from_json("json", "struct<total_revisions: bigint, revisions: array<struct<revision: bigint>>>")
    return out.select("investigation_id", "region_id", "page", doc.alias("d")).select(
        "investigation_id", "region_id", "page", "d.total_revisions", F.size("d.revisions").cast("bigint").alias("revisions"), F.get("d.revisions", F.lit(0))["revision"].alias("first_revision")
    )


# Investigations over the vector table: four vectors are the four dates of one series.

SETTINGS = plan.Settings(
    strategy="baseline", block=4, band_names=("Red", "Green", "B08", "B11"),
    detection=DetectionConfig(nodata=-99.0, std_multiplier=0.5, min_region_area=2),
    evidence=EvidenceConfig(buffer_px=1, min_context_pixels=4, band_roles={"red": 0, "green": 1, "nir": 2}),
    classifier=ClassifierConfig(min_area_px=2), screening=ScreeningConfig(min_area_px=2),
)


def series(t):
    """Observations and frames of the series made of vectors."""
    vec = F.col("vec_id")
    rows = t.table("embeddings").select(
        F.concat(F.lit("s"), F.floor(vec / 4)).alias("series_id"), vec.alias("obs_no"), F.concat(F.lit("v"), vec).alias("observation_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + (vec % 4) * F.lit(2_592_000_000_000)).alias("acquisition_time"), F.lit("Sentinel-2A MSI").alias("sensor"), F.lit("Sentinel-2").alias("platform"),
        (F.lit(70.0) + F.floor(vec / 4) % 50 * F.lit(0.1)).alias("min_lon"), (F.lit(10.0) + F.floor(vec / 4) % 30 * F.lit(0.1)).alias("min_lat"),
        (F.lit(70.0004) + F.floor(vec / 4) % 50 * F.lit(0.1)).alias("max_lon"), (F.lit(10.0004) + F.floor(vec / 4) % 30 * F.lit(0.1)).alias("max_lat"),
        F.lit(0.05).alias("cloud_fraction"), F.lit(0.98).alias("valid_pixel_ratio"), F.sha2(vec.cast("string"), 256).alias("source_hash"),
    )
    frames = rows.select("observation_id", F.lit(4).alias("frame_height"), F.lit(4).alias("frame_width"), *matching.BOX, F.lit(10.0).alias("resolution_m"))
    rasters = t.fx_rasters.withColumn("obs_id", F.concat(F.lit("v"), "obs_id"))
    return rows.drop("obs_no"), rasters, frames


def requests(t):
    """One request per series: its first pair, first region."""
    rows = t.table("embeddings").select(F.floor(F.col("vec_id") / 4).alias("n")).distinct()
    return rows.select(
        F.concat(F.lit("c"), "n").alias("candidate_id"), F.concat(F.lit("s"), "n").alias("series_id"),
        F.concat(F.lit("pair_v"), F.col("n") * 4, F.lit("__v"), F.col("n") * 4 + 1).alias("pair_id"), F.lit("reg_0001").alias("region_id"),
    )


@query("m13_investigate")
def investigate(t):
    observations, rasters, frames = series(t)
    asked = requests(t)
    result = plan.investigate(asked, observations, rasters, frames, SETTINGS)
    out = plan.dossiers(result, asked, observations).select(
        "candidate_id", "investigation_id", "support_status", "confidence_tier", "interval_type", "interval_days", "supporting", "flagged", "average_iou", "completeness"
    )
    return out.unionByName(result.errors, allowMissingColumns=True)


@query("m14_validate_requests", """
    WITH r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'series_none' WHEN event_id % 10 = 1 THEN concat('series_', CAST(user_id + 1 AS VARCHAR)) ELSE series_id END AS series_id, event_id % 10 AS k, observation_id FROM fx_observations JOIN (SELECT event_id, user_id FROM events) USING (event_id)),
    n AS (SELECT observation_id, series_id AS s, lead(observation_id) OVER (PARTITION BY series_id ORDER BY acquisition_time, observation_id) AS nxt FROM fx_observations),
    x AS (SELECT r.*, n.s, n.nxt FROM r JOIN n USING (observation_id) WHERE n.nxt IS NOT NULL)
    SELECT event_id, CASE WHEN k = 0 OR series_id NOT IN (SELECT series_id FROM fx_observations) THEN 'series_resolution' WHEN k IN (1, 2, 3) THEN 'discovery_pair_resolution' WHEN k = 4 THEN 'candidate_region_validation' END AS stage FROM x""")
def validate_requests(t):
    key = F.col("event_id") % 10
    obs = t.fx_observations
    pairs = pairing.pairs_adjacent(obs, extra=("event_id",)).select(F.col("earlier.event_id").alias("event_id"), "series_id", F.col("earlier.observation_id").alias("a"), F.col("later.observation_id").alias("b"))
    other = F.concat(F.lit("series_"), F.regexp_replace("series_id", "series_", "").cast("bigint") + 1)
    asked = pairs.select(
        F.col("event_id").alias("candidate_id"), F.when(key == 0, "series_none").when(key == 1, other).otherwise(F.col("series_id")).alias("series_id"),
        F.when(key == 2, F.concat(F.lit("pair_zzz__"), "b")).when(key == 3, F.concat(F.lit("pair_"), "b", F.lit("__"), "a")).otherwise(F.concat(F.lit("pair_"), "a", F.lit("__"), "b")).alias("pair_id"),
        F.when(key == 4, "none").otherwise("reg_0001").alias("region_id"),
    )
    regions = asked.where("region_id <> 'none'").select("pair_id", "region_id")
    return plan.validate_requests(asked, obs, regions).select(F.col("candidate_id").alias("event_id"), "stage")


@query("m15_default_requests", """
    WITH s AS (SELECT series_id FROM fx_observations GROUP BY series_id HAVING count(*) >= 2 ORDER BY CASE WHEN count(*) >= 4 THEN 0 ELSE 1 END, series_id LIMIT 1),
    a AS (SELECT *, lead(observation_id) OVER w AS l_id, lead(acquisition_time) OVER w AS l_ts, lead(min_lon) OVER w AS lx0, lead(min_lat) OVER w AS ly0, lead(max_lon) OVER w AS lx1, lead(max_lat) OVER w AS ly1 FROM fx_observations WHERE series_id IN (SELECT series_id FROM s) WINDOW w AS (PARTITION BY series_id ORDER BY acquisition_time, observation_id)),
    v AS (SELECT *, (least(max_lon, lx1) - greatest(min_lon, lx0)) AS ox, (least(max_lat, ly1) - greatest(min_lat, ly0)) AS oy FROM a WHERE l_id IS NOT NULL AND l_ts > acquisition_time),
    f AS (SELECT series_id, concat('pair_', observation_id, '__', l_id) AS pair_id FROM v WHERE ox > 0 AND oy > 0 AND round(ox * oy / ((max_lon - min_lon) * (max_lat - min_lat) + (lx1 - lx0) * (ly1 - ly0) - ox * oy), 4) >= 0.5e0 ORDER BY acquisition_time, l_ts, pair_id LIMIT 1)
    SELECT series_id, pair_id, 'reg_0002' AS region_id FROM f""")
def default_requests(t):
    pairs = pairing.evaluate(pairing.pairs_adjacent(t.fx_observations))
    regions = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(f"reg_{i:04d}").alias("region_id"), F.lit(a).alias("area_px")) for i, a in ((1, 20), (2, 40), (3, 40))])).alias("r")).select("pair_id", "r.*")
    return plan.default_requests(catalog.build_series(t.fx_observations), pairs, regions).select("series_id", "pair_id", "region_id")
