"""Lineage: edges, hashes, content ids, ledgers and dossier rows.

`stages` holds one row per investigation and pair with the ids of everything derived from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epochlens.functions.text import digest_of_lanes, lanes_of, set_digest, split_pair_id
from epochlens.session import cut

# Fixed order: each artifact is derived from the one before it.
CHAIN = ("scene_id", "tile_id", "observation_id", "pair_id", "result_id", "evidence_id", "classification_id", "suppression_id", "timeline_id", "dossier_id")
STAGES = {
    "result_id": ("detection", "Pairwise change detection", "ChangeDetectionResult"),
    "evidence_id": ("evidence", "Region evidence", "CandidateEvidence"),
    "classification_id": ("classification", "Rule classification", "ClassificationResult"),
    "suppression_id": ("screening", "False-alarm screening", "SuppressionResult"),
    "timeline_id": ("timeline", "Multi-epoch timeline", "TemporalEvidenceResult"),
}


def lineage_edges(stages: DataFrame) -> DataFrame:
    """Distinct (parent_id, child_id, stage) edges; one pass, and repeats collapse before the shuffle."""
    steps = [(a, b) for a, b in zip(CHAIN, CHAIN[1:]) if a in stages.columns and b in stages.columns]
    edges = F.array(*[F.struct(F.col(a).alias("parent_id"), F.col(b).alias("child_id"), F.lit(b[:-3]).alias("stage")) for a, b in steps])
    return stages.select(F.explode(edges).alias("e")).select("e.*").where("parent_id IS NOT NULL AND child_id IS NOT NULL").distinct()


def upstream_hashes(hashes: DataFrame) -> DataFrame:
    """Source hash per investigation and key; the last one in `position` wins."""
    return hashes.groupBy("investigation_id", "key").agg(F.max_by("hash", "position").alias("hash"))


#: Rows of one investigation that a task may meet; the ids of a larger one are dealt over several.
HOT_ROWS = 100_000
#: Stands for a missing part of a content id, so that it isn't the same as a part left out.
MISSING = "\u2205"


def investigation_ids(stages: DataFrame, hashes: DataFrame, configuration: str = "") -> DataFrame:
    """Content id of each investigation from its request, artifact ids, settings and source hashes.

    The distinct ids of each kind are folded into an order-free digest, so neither their order nor their number
    matters to a task; a retried stage that names an artifact again changes nothing, and a missing part is marked.
    """
    key = ["investigation_key", "series_id", "pair_key", "region_id"]
    parts = ("pair_id", "result_id", "evidence_id", "classification_id", "suppression_id")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    # The key travels as a 128-bit digest, a null part told apart from every text.
    marked = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in key]
    rows = stages.withColumn("_k", F.unhex(F.md5(F.concat_ws(",", *[F.coalesce(m, F.lit("-")) for m in marked]))))
    groups = cut(rows.groupBy("_k", *key).agg(F.count(F.lit(1)).alias("_n"), F.max("acquisition_time").alias("_at")))
    # Rows of a key meet in one task, those of a very large key in many; so ids are shuffled once and only sums after that.
    hot = cut(groups.where(F.col("_n") > HOT_ROWS).select("_k", F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_split")))
    listed = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("part"), F.col(c).cast("string").alias("value")) for i, c in enumerate(parts)])
    ids = rows.select("_k", *dict.fromkeys(parts)).select("_k", F.explode(listed).alias("p")).select("_k", "p.*").where("value IS NOT NULL")
    ids = ids.join(hot, "_k", "left").withColumn("_split", F.pmod(F.hash("value"), F.coalesce("_split", F.lit(1))))
    distinct = ids.repartition("_k", "part", "_split").select("_k", "part", "_split", "value").distinct()
    lanes = [f"_{i}" for i in range(len(lanes_of(F.lit(""))))]
    summed = distinct.groupBy("_k", "part", "_split").agg(
        F.count("value").alias("_n"), *[F.sum(x).alias(name) for name, x in zip(lanes, lanes_of(F.col("value")))]
    )
    sums = summed.groupBy("_k").agg(*[F.sum(F.when(F.col("part") == i, F.col(c))).alias(f"{c}_{i}") for i in range(len(parts)) for c in ("_n", *lanes)])
    digests = [digest_of_lanes([F.col(f"{c}_{i}") for c in lanes], F.col(f"_n_{i}")).alias(part) for i, part in enumerate(parts)]
    folded = groups.select("_k", *key).join(sums, "_k", "left").select(*key, *digests)
    times = groups.groupBy("investigation_key").agg(F.max("_at").alias("created_at"))
    named = hashes.select("investigation_key", F.concat_ws("=", known("key"), known("hash")).alias("_h")).distinct()
    sources = named.groupBy("investigation_key").agg(set_digest(F.col("_h")).alias("_sources"))
    rows = folded.join(times, "investigation_key", "left").join(sources, "investigation_key", "left")
    seed = F.concat_ws(":", *[known(c) for c in (*key[1:], *parts, "_sources")], F.lit(configuration))
    digest = F.substring(F.sha2(seed, 256), 1, 16)
    return rows.select(
        "investigation_key", F.concat(F.lit("inv_"), digest).alias("investigation_id"), F.concat(F.lit("prov_inv_"), digest).alias("provenance_id"),
        digest.alias("content_hash"), "created_at",
    )


def provenance_of_scene(records: DataFrame, scene_id: str) -> DataFrame:
    return records.where(F.col("source_scene_id") == scene_id).orderBy("timestamp", "provenance_id")


REFERENCES = ("investigation_id", "provenance_id", "content_hash", "timeline_id", "result_id", "evidence_id", "classification_id", "suppression_id")


def lineage_completeness(dossiers: DataFrame) -> DataFrame:
    """Which of the eight expected references are present; without the three root ids lineage is insufficient."""
    absent = {c: F.coalesce(F.col(c), F.lit("")) == "" for c in REFERENCES}
    missing = F.array_compact(F.array(*[F.when(gone, F.lit(c)) for c, gone in absent.items()]))
    root_gone = absent["investigation_id"] | absent["provenance_id"] | absent["content_hash"]
    status = F.when(root_gone, "INSUFFICIENT").when(F.size("missing") > 0, "PARTIAL").otherwise("COMPLETE")
    return dossiers.withColumn("missing", missing).withColumn("present", F.lit(len(REFERENCES)) - F.size("missing")).withColumn("completeness", status)


def epoch_lineage(stages: DataFrame, matches: DataFrame) -> DataFrame:
    """Per investigation and pair: its scenes, artifact ids and the region the candidate became.

    stages: investigation_id, pair_id, discovery_pair_id, region_id and artifact ids.
    """
    found = matches.select("investigation_id", "pair_id", F.col("matched_region_id").alias("_matched"), "iou", "distance_m", F.col("relationship").alias("_relationship"))
    rows = stages.join(found, ["investigation_id", "pair_id"], "left")
    discovery = F.col("pair_id") == F.col("discovery_pair_id")
    matched = F.coalesce("_matched", F.when(discovery, F.col("region_id")))
    ends = split_pair_id(F.col("pair_id"))
    return rows.select(
        "investigation_id", "pair_id", ends["earlier"].alias("earlier_id"), ends["later"].alias("later_id"),
        "result_id", "evidence_id", "classification_id", "suppression_id", matched.alias("matched_region_id"), "iou", "distance_m",
        F.coalesce("_relationship", F.when(discovery, "MATCHED").otherwise("UNRESOLVED")).alias("relationship"),
        F.coalesce(matched != F.col("region_id"), F.lit(False)).alias("is_id_shifted"),
    )


def stage_log(stages: DataFrame) -> DataFrame:
    """One row per investigation, pair and stage with its artifact; a stage without one failed."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("stage"), F.col(c).alias("artifact_id"), F.when(F.col(c).isNull(), "FAILED").otherwise("COMPLETED").alias("status"))
        for c, (name, _, _) in STAGES.items() if c in stages.columns
    ])
    return stages.select("investigation_id", "pair_id", F.explode(entries).alias("e")).select("investigation_id", "pair_id", "e.*")


def artifact_ledger(hashes: DataFrame, stages: DataFrame, dossiers: DataFrame) -> DataFrame:
    """Source hashes, stage artifacts and the final dossier of every investigation."""
    def text(c):
        return F.lit(c)

    none = F.lit(None).cast("string")
    sources = hashes.select(
        "investigation_id", text("input").alias("stage_id"), text("Ingested observation tile").alias("stage_name"), F.col("key").alias("artifact_id"),
        text("Source tile").alias("artifact_type"), "hash", none.alias("provenance_id"), none.alias("source_pair_id"), text("VERIFIED_INPUT").alias("status"),
    )
    names = F.create_map(*[F.lit(x) for name, title, _ in STAGES.values() for x in (name, title)])
    kinds = F.create_map(*[F.lit(x) for name, _, kind in STAGES.values() for x in (name, kind)])
    made = stage_log(stages).select(
        "investigation_id", F.col("stage").alias("stage_id"), names[F.col("stage")].alias("stage_name"), F.coalesce("artifact_id", text("-")).alias("artifact_id"),
        kinds[F.col("stage")].alias("artifact_type"), none.alias("hash"), none.alias("provenance_id"), F.col("pair_id").alias("source_pair_id"), "status",
    )
    final = dossiers.select(
        "investigation_id", text("dossier").alias("stage_id"), text("Investigation dossier").alias("stage_name"), F.col("investigation_id").alias("artifact_id"),
        text("InvestigationDossier").alias("artifact_type"), F.col("content_hash").alias("hash"), "provenance_id", none.alias("source_pair_id"), text("COMPLETED").alias("status"),
    )
    return sources.unionByName(made).unionByName(final)


SEARCHED = ("stage_id", "stage_name", "artifact_id", "provenance_id", "hash", "source_pair_id")


def search_artifacts(ledger: DataFrame, term: str) -> DataFrame:
    """Ledger rows in which any of six columns holds the term (ignoring case); no term keeps all."""
    if not term:
        return ledger
    hit = F.lit(False)
    for c in SEARCHED:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    return ledger.where(hit)


def node_correspondence(nodes: DataFrame, epochs: DataFrame) -> DataFrame:
    """Each timeline node with its match: the baseline for absence and the first node, else by observation, else by position.

    nodes: candidate_id, observation_id, node_rank (1-based), node_status, region_id, iou, distance_m.
    epochs: candidate_id, later_id, position (1-based), matched_region_id, iou, distance_m, relationship, status.
    """
    fields = ("matched_region_id", "iou", "distance_m", "relationship", "status")

    def named(prefix, *keys):
        return epochs.select("candidate_id", *keys, F.struct(*fields).alias(prefix))

    by_id = named("_by_id", F.col("later_id").alias("observation_id"))
    by_place = named("_by_place", (F.col("position") + 1).alias("node_rank"))
    rows = nodes.join(by_id, ["candidate_id", "observation_id"], "left").join(by_place, ["candidate_id", "node_rank"], "left")
    baseline = (F.col("node_status") == "PRE_CHANGE_ABSENCE") | (F.col("node_rank") == 1)
    match = F.coalesce("_by_id", "_by_place")
    matched = F.when(baseline, F.col("region_id")).otherwise(F.coalesce(match["matched_region_id"], F.col("region_id")))

    def pick(base, field, fallback):
        return F.when(baseline, F.lit(base)).when(match.isNotNull(), match[field]).otherwise(fallback).alias(field)

    return rows.select(
        "candidate_id", "observation_id", matched.alias("matched_region_id"), (~baseline & (matched != F.col("region_id"))).alias("is_id_shifted"),
        pick(1.0, "iou", F.coalesce("iou", F.lit(0.0))), pick(0.0, "distance_m", F.coalesce("distance_m", F.lit(0.0))),
        pick("PRE_CHANGE_BASELINE", "relationship", F.lit("NONE")), pick("BASELINE_REFERENCE", "status", F.lit("UNLINKED")),
    )


def dossier_summary(summary: DataFrame, correspondence: DataFrame, screening: DataFrame, completeness: DataFrame) -> DataFrame:
    """One flat row per candidate from its timeline, correspondence, screening and lineage figures."""
    out = summary
    for part in (correspondence, screening, completeness):
        clash = [c for c in part.columns if c in out.columns and c != "candidate_id"]
        for c in clash:
            part = part.withColumnRenamed(c, f"screened_{c}")
        out = out.join(part, "candidate_id", "left")
    return out


