"""Append-only review log with revisions per (investigation, region)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epochlens.functions.text import canonical_json, normalize_decision
from epochlens.plans.ordered import DAY, ordered

KEY = ["investigation_id", "region_id"]
CONTENT = ("decision", "note", "reason")


def normalize(batch: DataFrame) -> DataFrame:
    """Trimmed texts and decisions in one of three values."""
    def tidy(c):
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    analyst = tidy("analyst_id") if "analyst_id" in batch.columns else F.lit("analyst_local")
    return batch.select(
        *KEY, "ts", "event_id", normalize_decision(F.col("decision")).alias("decision"), tidy("note").alias("note"), tidy("reason").alias("reason"), analyst.alias("analyst_id")
    )


def revision_number(rows: DataFrame, width_us: int = DAY) -> DataFrame:
    """Dense version per key in time order, with the previous decision and the time of the first version."""
    out = ordered(rows, KEY, "ts", "event_id", rank="revision", prev="_prev", first="_first", payload=["decision"], width_us=width_us)
    return out.withColumn("previous_decision", F.col("_prev.decision")).withColumn("created_at", F.col("_first.ts")).drop("_prev", "_first")


def review_latest(log: DataFrame) -> DataFrame:
    """Newest revision per key, as an aggregate."""
    rest = [c for c in log.columns if c not in KEY and c != "revision"]
    newest = log.groupBy(*KEY).agg(F.max(F.struct("revision", *rest)).alias("_r"))
    return newest.select(*[F.col(c) if c in KEY else F.col(f"_r.{c}").alias(c) for c in log.columns])


def review_history(log: DataFrame, investigation_id: str, region_id: str | None = None) -> DataFrame:
    wanted = F.col("investigation_id") == investigation_id
    if region_id is not None:
        wanted = wanted & (F.col("region_id") == region_id)
    return log.where(wanted).orderBy(F.desc("revision"), "region_id")


def audit_hash() -> Column:
    """SHA-256 of the canonical text of a revision (columns of the log)."""
    def stamp(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    return F.sha2(
        canonical_json(
            analystId=F.col("analyst_id"), analystNote=F.col("note"), candidateRegionId=F.col("region_id"), createdAt=stamp("created_at"),
            decision=F.col("decision"), investigationId=F.col("investigation_id"), previousDecision=F.col("previous_decision"),
            reasonCode=F.col("reason"), revisionNumber=F.col("revision"), selectedReason=F.col("reason"), updatedAt=stamp("ts"),
        ),
        256,
    )


def review_append(log: DataFrame | None, batch: DataFrame, width_us: int = DAY) -> DataFrame:
    """New revisions of a batch: rows that repeat the revision before them are left out.

    A row repeats the log exactly when it equals the row before it, or, at the start of the batch, the latest
    stored revision; so one look at the neighbour is enough.
    """
    rows = ordered(normalize(batch), KEY, "ts", "event_id", prev="_prev", payload=list(CONTENT), width_us=width_us)
    if log is not None:
        latest = review_latest(log).select(
            *KEY, F.col("revision").alias("_base"), F.col("created_at").alias("_created"), F.struct(*CONTENT).alias("_latest")
        )
        rows = rows.join(latest, KEY, "left")
    else:
        empty = "struct<decision: string, note: string, reason: string>"
        rows = rows.withColumns({"_base": F.lit(0).cast("bigint"), "_created": F.lit(None).cast("timestamp"), "_latest": F.lit(None).cast(empty)})
    before = F.coalesce(F.struct(*[F.col(f"_prev.{c}").alias(c) for c in CONTENT]), F.col("_latest"))
    before = F.when(F.col("_prev").isNotNull(), before).otherwise(F.col("_latest"))
    rows = rows.withColumn("_before", before)
    changed = rows.where(F.col("_before").isNull() | (F.struct(*CONTENT) != F.col("_before")))
    numbered = ordered(changed, KEY, "ts", "event_id", rank="_n", first="_first", width_us=width_us)
    revision = F.coalesce("_base", F.lit(0)) + F.col("_n")
    out = numbered.select(
        F.concat(F.lit("rev_"), "investigation_id", F.lit("_"), "region_id", F.lit("_r"), revision.cast("string")).alias("review_id"),
        *KEY, revision.alias("revision"), "ts", "event_id", *CONTENT, "analyst_id",
        F.col("_before.decision").alias("previous_decision"), F.coalesce("_created", F.col("_first.ts")).alias("created_at"),
    )
    return out.withColumn("audit_hash", audit_hash())


def review_export(log: DataFrame, page_size: int = 1000) -> DataFrame:
    """JSON documents with totals and at most `page_size` revisions each, per key and page."""
    totals = review_latest(log).select(*KEY, F.col("revision").alias("latest_revision"), F.col("decision").alias("current_decision"), F.col("audit_hash").alias("current_audit_hash"))
    counts = log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_revisions"))
    page = F.floor((F.col("revision") - 1) / page_size).cast("int")
    fields = [c for c in log.columns if c not in (*KEY, "revision")]
    pages = log.groupBy(*KEY, page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("revision", "review_id", *[c for c in fields if c != "review_id"]))).alias("revisions"))
    rows = pages.join(totals.join(counts, KEY), KEY)
    body = F.to_json(F.struct(*KEY, "page", "current_decision", "latest_revision", "total_revisions", "current_audit_hash", "revisions"))
    return rows.select(*KEY, "page", "total_revisions", body.alias("json"))
