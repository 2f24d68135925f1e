"""Stored tables: lookups, ingest, writes, upserts, deletes and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def get_by_id(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.where(F.col(key) == value)


def list_ids(table: DataFrame, key: str) -> DataFrame:
    return table.select(key).distinct().orderBy(key)


def list_scenes(scenes: DataFrame) -> DataFrame:
    """Newest first, summary columns only."""
    fields = [c for c in ("scene_id", "sensor", "platform", "acquisition_time", "created_at") if c in scenes.columns]
    return scenes.select(*fields).orderBy(F.desc("created_at"), "scene_id")


def scene_tiles(tiles: DataFrame, scene_id: str) -> DataFrame:
    return tiles.where(F.col("source_scene_id") == scene_id)


def ingest_new(files: DataFrame, catalog: DataFrame, force: bool = False, provenance: DataFrame | None = None) -> DataFrame:
    """Files with `existing_id`, the scene already stored for their hash, and `is_new`.

    One file stands for all copies of a content: the first by path. Copies collapse before the join. With `provenance`
    (scene_id, provenance_id, executed_at), `provenance_id` is the last record of the existing scene; only
    records of scenes that files meet are shuffled.
    """
    rest = [c for c in files.columns if c not in ("file_hash", "path")]
    first = files.groupBy("file_hash").agg(F.min(F.struct("path", *rest)).alias("_f"), F.count(F.lit(1)).alias("copies"))
    known = catalog.groupBy("file_hash").agg(F.min("scene_id").alias("existing_id"))
    rows = first.select("file_hash", "_f.*", "copies").join(known, "file_hash", "left")
    rows = rows.withColumn("is_new", F.lit(True) if force else F.col("existing_id").isNull())
    if provenance is None:
        return rows
    last = provenance.groupBy(F.col("scene_id").alias("existing_id")).agg(F.max(F.struct("executed_at", "provenance_id"))["provenance_id"].alias("provenance_id"))
    met = rows.join(last, "existing_id", "left")
    return met.select(*rows.columns, F.when(~F.col("is_new"), F.col("provenance_id")).alias("provenance_id"))


def new_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return files.join(catalog.select("file_hash"), "file_hash", "left_anti")


def upsert(table: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The table with every updated key replaced by its last update, the one of the largest `version`.

    `version` is a column of the updates (an arrival number or time) and need not be one of the table. Updates of
    equal version are told apart by their values, so the result doesn't depend on their order; a key sent many
    times collapses before the shuffle.
    """
    rest = [c for c in table.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("_version"), *rest)).alias("_u"))
    latest = newest.select(*keys, *[F.col(f"_u.{c}").alias(c) for c in rest])
    return table.join(latest.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(latest)


def upsert_versions(table: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The newest version per key of both tables; an aggregate, not a window, so hot keys stay cheap."""
    both = table.unionByName(updates)
    rest = [c for c in both.columns if c not in keys and c != version]
    newest = both.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_r"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in both.columns])


def key_collisions(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is already stored, or appears twice among the new rows."""
    stored = rows.join(table.select(*keys), list(keys), "left_semi").select(*keys)
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return stored.unionByName(twice).distinct()


def insert_strict(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append; an existing key is an error."""
    if not key_collisions(table, rows, keys).isEmpty():
        raise ValueError(f"some keys ({', '.join(keys)}) already exist")
    return table.unionByName(rows)


def delete_cascade(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "tile_id") -> dict[str, DataFrame]:
    """Every table without the rows of the given keys."""
    ids = doomed.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def write_artifacts(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace only the partitions that `df` holds."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


PROVENANCE = ("provenance_id", "target_id", "source_scene_id", "processing_stage", "pipeline_version", "parameters", "executed_by", "timestamp")


def provenance_rows(df: DataFrame, stage: str, target: Column, scene: Column, executed_by: str, parameters: str = "{}", version: str = "1.0.0", at: Column | None = None) -> DataFrame:
    """One record per row of a stage output, in the provenance layout."""
    from epochlens.functions.text import content_id

    return df.select(
        content_id("prov_", F.lit(stage), target, scene, F.lit(version), F.lit(parameters)).alias("provenance_id"),
        target.alias("target_id"), scene.alias("source_scene_id"), F.lit(stage).alias("processing_stage"), F.lit(version).alias("pipeline_version"),
        F.lit(parameters).alias("parameters"), F.lit(executed_by).alias("executed_by"), (F.current_timestamp() if at is None else at).alias("timestamp"),
    )


def append_provenance(records: DataFrame, path: str) -> None:
    records.select(*PROVENANCE).write.mode("append").parquet(path)


def export_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, preceded by a header with the number of records in its own folder."""
    df.agg(F.count(F.lit(1)).alias("record_count")).coalesce(1).write.mode("overwrite").json(f"{path}/header")
    df.write.mode("overwrite").json(f"{path}/records")
