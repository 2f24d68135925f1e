"""Metadata-filtered exact similarity search over stored vectors."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from epochlens.functions import vectors
from epochlens.plans.scoring import topk_batch


@dataclass(frozen=True)
class TileFilter:
    scene: str | None = None
    sensor: str | None = None
    platform: str | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    aoi: tuple[float, float, float, float] | None = None  # min_lon, min_lat, max_lon, max_lat

    def __post_init__(self) -> None:
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from is later than date_to")

    @property
    def empty(self) -> bool:
        return self == TileFilter()


def aoi_intersects(aoi: tuple[float, float, float, float]) -> Column:
    """Box intersection in which touching counts; plain range predicates, so a scan can skip row groups."""
    lon0, lat0, lon1, lat1 = aoi
    return (F.col("min_lon") <= lon1) & (F.col("max_lon") >= lon0) & (F.col("min_lat") <= lat1) & (F.col("max_lat") >= lat0)


def filter_tiles(tiles: DataFrame, where: TileFilter = TileFilter()) -> DataFrame:
    """Tiles that meet every given condition; none given keeps all."""
    tests: list[Column] = []
    if where.scene is not None:
        tests.append(F.col("source_scene_id") == where.scene)
    for name in ("sensor", "platform"):
        wanted = getattr(where, name)
        if wanted is not None:
            tests.append(F.lower(name) == wanted.lower())
    if where.date_from is not None:
        tests.append(F.col("acquisition_time") >= F.lit(where.date_from))
    if where.date_to is not None:
        tests.append(F.col("acquisition_time") <= F.lit(where.date_to))
    if where.aoi is not None:
        tests.append(aoi_intersects(where.aoi))
    return tiles.where(reduce(lambda a, b: a & b, tests)) if tests else tiles


def stale_embeddings(tiles: DataFrame, records: DataFrame, model: str, preprocessing: str) -> DataFrame:
    """Tiles without an embedding record, or whose content, model or preprocessing changed since."""
    known = records.select("tile_id", F.col("source_hash").alias("_hash"), F.col("model_id").alias("_model"), F.col("preprocessing").alias("_prep"))
    joined = tiles.join(known, "tile_id", "left")
    same = F.col("_hash").eqNullSafe(F.col("sha256_hash")) & F.col("_model").eqNullSafe(F.lit(model)) & F.col("_prep").eqNullSafe(F.lit(preprocessing))
    state = F.when(F.col("_hash").isNull() & F.col("_model").isNull(), "new").when(~same, "replaced").otherwise("skipped")
    return joined.withColumn("state", state).drop("_hash", "_model", "_prep")


def candidates_semi(index: DataFrame, allowed: DataFrame) -> DataFrame:
    return index.join(allowed.select("tile_id"), "tile_id", "left_semi")


def exclude_self(hits: DataFrame) -> DataFrame:
    return hits.where("query_id <> tile_id")


def ids_except(candidates: DataFrame, query_ids: DataFrame) -> DataFrame:
    return candidates.select("tile_id").join(query_ids.select("tile_id"), "tile_id", "left_anti")


def check_dimension(index: DataFrame, dimension: int, column: str = "v") -> DataFrame:
    return index.withColumn("error", vectors.dimension_error(F.col(column), dimension))


def topk(index: DataFrame, vector: list[float], k: int) -> DataFrame:
    """The k rows most similar to one vector: score (6 dp) descending, then id. A sort-and-take, not a sort."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    scored = index.select("tile_id", F.round(vectors.cosine(F.col("v"), query), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "tile_id").limit(max(k, 0))


def enrich_hits(hits: DataFrame, tiles: DataFrame, records: DataFrame) -> DataFrame:
    """Hits with tile metadata (required) and embedding record (optional)."""
    fields = [c for c in ("source_scene_id", "sensor", "acquisition_time", "min_lon", "min_lat", "max_lon", "max_lat") if c in tiles.columns]
    return hits.join(tiles.select("tile_id", *fields), "tile_id").join(records.select("tile_id", "model_id"), "tile_id", "left")


def search_by_vector(index: DataFrame, tiles: DataFrame, records: DataFrame, vector: list[float], k: int, where: TileFilter = TileFilter()) -> DataFrame:
    """Ranked hits among the tiles that pass the filter and have metadata; scores to 4 dp.

    Filtering and the metadata check come before scoring, so ranks have no gaps.
    """
    from pyspark.sql import Window

    hits = topk(candidates_semi(index, filter_tiles(tiles, where)), vector, k)
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "tile_id")))  # at most k rows
    return enrich_hits(ranked, tiles, records).withColumn("score", F.round("score", 4))


def search_by_id(index: DataFrame, queries: DataFrame, k: int, without_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """Top k for stored vectors used as queries (table of tile_id), and the ids that are not stored."""
    known = index.join(queries.select("tile_id"), "tile_id", "left_semi").select(F.col("tile_id").alias("query_id"), "v")
    missing = queries.select("tile_id").join(index.select("tile_id"), "tile_id", "left_anti").withColumn("error", F.lit("unknown tile id"))
    hits = topk_batch(known, index.select(F.col("tile_id").alias("gallery_id"), "v"), k, without_self)
    return hits.withColumnRenamed("gallery_id", "tile_id"), missing


def search_counts(index: DataFrame, tiles: DataFrame, k: int, where: TileFilter = TileFilter()) -> DataFrame:
    """How many vectors are stored, pass the filter, are scored and are returned."""
    allowed = filter_tiles(tiles, where)
    parts = [
        index.select(F.lit("indexed").alias("what")), allowed.select(F.lit("filtered").alias("what")),
        candidates_semi(index, allowed).select(F.lit("scored").alias("what")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    counts = rows.agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("indexed", "filtered", "scored")])
    return counts.withColumn("returned", F.least("scored", F.lit(max(k, 0))))
