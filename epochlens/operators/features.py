"""Closed-form features of tiles and texts, and the embedder registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from epochlens.functions import vectors

FEATURES, EMBEDDING = 64, 512  # fixed values

# Signature of each known word.
URBAN = (0.8, 0.2, 0.1, 0.9, 0.7, 0.3)
GREEN = (0.1, 0.9, 0.1, 0.2, 0.2, 0.8)
WATER = (0.9, 0.1, 0.05, 0.05, 0.1, 0.05)
ROADS = (0.5, 0.5, 0.1, 0.8, 0.9, 0.2)
BARE = (0.3, 0.3, 0.9, 0.3, 0.3, 0.1)
CONCEPTS = {
    "urban": URBAN, "city": URBAN, "vegetation": GREEN, "forest": GREEN, "trees": GREEN, "water": WATER, "lake": WATER, "river": WATER,
    "roads": ROADS, "infrastructure": ROADS, "cleared": BARE, "soil": BARE, "bare": BARE,
}


def projection_matrix(seed: int = 42) -> np.ndarray:
    """Orthonormal rows from a seeded normal matrix: FEATURES x EMBEDDING."""
    normal = np.random.RandomState(seed).randn(FEATURES, EMBEDDING).astype(np.float32)
    q, _ = np.linalg.qr(normal.T)
    return q.T[:FEATURES].astype(np.float64)


def _moments(band: np.ndarray) -> list[float]:
    mean, std = band.mean(), band.std()
    return [mean, std, band.min(), band.max(), (((band - mean) / (std + 1e-6)) ** 3).mean()]


def tile_features(bands: np.ndarray) -> np.ndarray:
    """Band moments, gradient texture and a band ratio of one tile (bands, height, width), as a unit vector."""
    count, height, width = bands.shape
    out = np.zeros(40)
    stats = np.concatenate([_moments(b) for b in bands[:8]])
    out[: len(stats)] = stats
    texture = [0.0] * 4
    if height > 2 and width > 2:
        slope = np.hypot(np.diff(bands[0], axis=1)[:-1], np.diff(bands[0], axis=0)[:, :-1])
        mean, std = slope.mean(), slope.std()
        texture = [mean, std, slope.max(), (slope > mean + std).mean()]
    ratio = ((bands[1] - bands[0]) / (bands[1] + bands[0] + 1e-6)).mean() if count >= 2 else 0.0
    head = np.concatenate([out, texture, [ratio]])
    full = np.concatenate([head, np.sin(np.arange(len(head), FEATURES))])
    length = np.linalg.norm(full)
    return full / length if length > 1e-6 else full


def spectral_spatial_features():
    """Pandas UDF (bands, height, width) -> ARRAY<DOUBLE> of FEATURES values."""

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bands, heights, widths in batches:
            yield pd.Series([
                tile_features(np.stack([np.asarray(b, dtype=np.float64) for b in one]).reshape(len(one), h, w)) for one, h, w in zip(bands, heights, widths)
            ])

    return features


def project(seed: int = 42):
    """Pandas UDF: FEATURES -> EMBEDDING values, unit length; the matrix is built once per worker."""

    @F.pandas_udf("array<double>")
    def projected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matrix = projection_matrix(seed)
        for batch in batches:
            out = (np.stack(batch.to_list()) if len(batch) else np.zeros((0, FEATURES))) @ matrix
            length = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list(np.where(length < 1e-12, 0.0, out / np.maximum(length, 1e-12))))

    return projected


def _one_of(names: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*names)


def concept_vector(text: Column) -> Column:
    """FEATURES values: summed signatures of the known words, else the bytes of the text's hash as fractions.

    A text is split once and hashed once at most. Known words are counted per signature in one fold, and there is no
    lambda inside another: a Python function may take the result as its argument.
    """
    words = F.split(F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), r"\s+", " ")), " ")
    groups: dict[tuple[float, ...], list[str]] = {}
    for word, signature in CONCEPTS.items():
        groups.setdefault(signature, []).append(word)
    names = [f"n{i}" for i in range(len(groups))]

    def padded(values):
        return F.array(*values, *[F.lit(0.0)] * (FEATURES - len(values)))

    def counted(counts, word):
        return F.struct(*[(counts[n] + F.when(word.isin(*known), 1).otherwise(0)).alias(n) for n, known in zip(names, groups.values())])

    def summed(counts):
        found, values = F.lit(0), [F.lit(0.0)] * len(URBAN)
        for n, signature in zip(names, groups):
            found = found + counts[n]
            values = [v + counts[n] * F.lit(x) for v, x in zip(values, signature)]
        return F.when(found > 0, padded(values))

    none = F.struct(*[F.lit(0).alias(n) for n in names])
    concepts = F.aggregate(F.filter(words, _one_of(list(CONCEPTS))), none, counted, summed)
    pairs = F.regexp_extract_all(F.sha2(text, 256), F.lit(".."), F.lit(0))
    hashed = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("double") / 255.0)
    hashed = F.coalesce(hashed, F.array_repeat(F.lit(None).cast("double"), 32))
    return F.coalesce(concepts, F.concat(hashed, F.array(*[F.lit(0.0)] * (FEATURES - 32))))


def text_concepts(text: Column) -> Column:
    """`concept_vector` at unit length."""
    return vectors.l2_normalize(concept_vector(text), "zero")


# Embedders are plug-in points: a name, whether it can run here, and a function from DataFrame to DataFrame
# that adds the column `v`.


@dataclass(frozen=True)
class Embedder:
    model_id: str
    dimension: int
    embed: Callable[[DataFrame], DataFrame]
    available: Callable[[], tuple[bool, str]] = lambda: (True, "ready")


_EMBEDDERS: dict[str, Embedder] = {}


def register_embedder(embedder: Embedder) -> None:
    _EMBEDDERS[embedder.model_id] = embedder


def embedder(model_id: str) -> Embedder:
    if model_id not in _EMBEDDERS:
        raise KeyError(f"unknown embedder {model_id!r}")
    return _EMBEDDERS[model_id]


def list_embedders(available: bool | None = None) -> list[Embedder]:
    return [e for e in _EMBEDDERS.values() if available is None or e.available()[0] is available]


def _embed_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("v", project()(spectral_spatial_features()("bands", "height", "width")))


def _embed_texts(texts: DataFrame) -> DataFrame:
    return texts.withColumn("v", project()(concept_vector(F.col("text"))))


register_embedder(Embedder("spectral-spatial", EMBEDDING, _embed_tiles))
register_embedder(Embedder("text-concepts", EMBEDDING, _embed_texts))


def custom_embedder(model_id: str, dimension: int, load: Callable[[], Callable[[pd.Series], list]], column: str) -> Embedder:
    """Embedder from user code: `load` runs once per worker and returns a function from a batch to vectors."""

    def embed(df: DataFrame) -> DataFrame:
        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield pd.Series(list(model(batch)))

        return df.withColumn("v", run(F.col(column)))

    return Embedder(model_id, dimension, embed)


def custom_scorer(aligned: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Change scores from user code: (bands, height, width) of both dates -> (height, width) scores, per block."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for earlier, later, heights, widths in batches:
            rows = []
            for e, l, h, w in zip(earlier, later, heights, widths):
                shape = (len(e), h, w)
                rows.append(np.asarray(score(np.stack(list(e)).reshape(shape), np.stack(list(l)).reshape(shape)), dtype=np.float64).ravel())
            yield pd.Series(rows)

    return aligned.where("error IS NULL").select("pair_id", "row0", "col0", "height", "width", "valid", "seen", run("earlier", "later", "height", "width").alias("scores"))


def refresh_embeddings(tiles: DataFrame, records: DataFrame, index: DataFrame, model_id: str, preprocessing: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recompute only stale tiles. Returns the new index, the new records and the counts by state."""
    from epochlens.operators.search import stale_embeddings
    from epochlens.sources.tables import upsert

    checked = stale_embeddings(tiles, records, model_id, preprocessing)
    stale = checked.where("state <> 'skipped'")
    fresh = embedder(model_id).embed(stale).select("tile_id", "v")
    new_records = stale.select("tile_id", F.col("sha256_hash").alias("source_hash"), F.lit(model_id).alias("model_id"), F.lit(preprocessing).alias("preprocessing"))
    counts = checked.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("new", "replaced", "skipped")])
    # One row per tile, so the source hash serves as version.
    hashed = fresh.join(new_records.select("tile_id", "source_hash"), "tile_id")
    return upsert(index, hashed, ["tile_id"], "source_hash"), upsert(records, new_records, ["tile_id"], "source_hash"), counts
