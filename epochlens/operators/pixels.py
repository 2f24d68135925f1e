"""Pixel change detection over raster blocks.

A raster is stored as blocks of bounded size: (obs_id, row0, col0, height, width, bands), where `bands` is an
ARRAY of one value ARRAY per band. Pairs are aligned block by block, per-pixel work stays inside the arrays,
and a pixel becomes a row only for statistics and for changed pixels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from epochlens.config import DetectionConfig
from epochlens.functions import geo, text
from epochlens.plans.components import label_pixels
from epochlens.plans.ordered import ordered
from epochlens.plans.quantiles import exact_quantiles
from epochlens.session import cut

BLOCK = ("row0", "col0")


def to_band_arrays(values: Column, height: Column, width: Column, channels: Column, channels_last: Column) -> Column:
    """Flat raster values as band arrays; interleaved (height, width, channel) input is regrouped by band."""

    def band(b):
        return F.transform(
            F.sequence(F.lit(0), height * width - 1),
            lambda i: F.get(values, F.when(channels_last, i * channels + b).otherwise(b * height * width + i)),
        )

    return F.transform(F.sequence(F.lit(0), channels - 1), band)


def channels_last(shape: Column) -> Column:
    """A three-axis shape is read as (height, width, channel) when its last axis is at most 16 and its first above 16."""
    return (F.size(shape) == 3) & (F.get(shape, F.lit(2)) <= 16) & (F.get(shape, F.lit(0)) > 16)


def explode_raster(blocks: DataFrame, *keys: str) -> DataFrame:
    """Pixel rows (keys, band, row, col, value) of raster blocks."""
    bands = blocks.select(*keys, "row0", "col0", "width", F.posexplode("bands").alias("band", "_values"))
    rows = bands.select(*keys, "row0", "col0", "width", "band", F.posexplode("_values").alias("_pos", "value"))
    return rows.select(*keys, "band", *_position(), "value")


def _position() -> list[Column]:
    return [
        (F.col("row0") + F.floor(F.col("_pos") / F.col("width"))).cast("int").alias("row"),
        (F.col("col0") + F.col("_pos") % F.col("width")).cast("int").alias("col"),
    ]


def align(pairs: DataFrame, rasters: DataFrame) -> DataFrame:
    """Blocks of both dates side by side; `error` names blocks that cannot be compared.

    `pairs` has pair_id, earlier_id, later_id. The block position is part of the join key.
    """
    shape = ("height", "width")

    def side(name):
        ids = pairs.select("pair_id", F.col(f"{name}_id").alias("obs_id"))
        return rasters.join(ids, "obs_id").select(
            "pair_id", *BLOCK, *[F.col(c).alias(f"{name}_{c}") for c in shape], F.col("bands").alias(name),
            F.col("nodata").alias(f"{name}_nodata") if "nodata" in rasters.columns else F.lit(None).cast("double").alias(f"{name}_nodata"),
        )

    both = side("earlier").join(side("later"), ["pair_id", *BLOCK], "full")
    mismatch = (F.col("earlier_height") != F.col("later_height")) | (F.col("earlier_width") != F.col("later_width"))
    error = F.when(F.col("earlier").isNull() | F.col("later").isNull() | mismatch, "spatial dimension mismatch")
    return both.select(
        "pair_id", *BLOCK,
        F.coalesce("earlier_height", "later_height").alias("height"),
        F.coalesce("earlier_width", "later_width").alias("width"),
        "earlier", "later", "earlier_nodata", "later_nodata", error.alias("error"),
    )


def select_bands(aligned: DataFrame, bands: tuple[int, ...] | None) -> DataFrame:
    """Keep the given 0-based bands; an index out of range, or differing band counts without a choice, is an error."""
    if bands is None:
        wrong = F.when(F.size("earlier") != F.size("later"), "band count mismatch")
        return aligned.withColumn("error", F.coalesce("error", wrong))
    top, low = max(bands), min(bands)
    outside = F.lit(low < 0) | (F.size("earlier") <= top) | (F.size("later") <= top)
    picked = {c: F.array(*[F.get(F.col(c), F.lit(b)) for b in bands]) for c in ("earlier", "later")}
    return aligned.withColumn("error", F.coalesce("error", F.when(outside, "band index out of range"))).withColumns(picked)


def _stacked(bands, n: int) -> np.ndarray:
    """Bands x n values of one block; what is missing or NULL is NaN."""
    out = np.full((len(bands), n), np.nan)
    for row, band in zip(out, bands):
        if band is not None:
            values = np.asarray(band, np.float64)[:n]
            row[: len(values)] = values
    return out


def valid_mask(aligned: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Add `valid`: per pixel, no band of either date is NaN, infinite or nodata; and `seen`: the later date is finite.

    The nodata value of a date counts for that date only, the configured one for both.
    """

    @F.pandas_udf("struct<valid: array<boolean>, seen: array<boolean>>")
    def mask(earlier: pd.Series, later: pd.Series, n: pd.Series, earlier_nodata: pd.Series, later_nodata: pd.Series) -> pd.DataFrame:
        valid, seen = [], []
        for e, l, size, *own in zip(earlier, later, n, earlier_nodata, later_nodata):
            dates = [_stacked(e, size), _stacked(l, size)]
            finite = [np.isfinite(x) for x in dates]
            usable = [f.copy() for f in finite]
            if config.quality_mask:
                for x, u, nodata in zip(dates, usable, own):
                    for v in (config.nodata, nodata):
                        if v is not None and not np.isnan(v):
                            u &= x != v
            valid.append(usable[0].all(axis=0) & usable[1].all(axis=0))
            seen.append(finite[1].all(axis=0))
        return pd.DataFrame({"valid": valid, "seen": seen})

    found = mask("earlier", "later", F.col("height") * F.col("width"), "earlier_nodata", "later_nodata")
    usable = aligned.where(F.col("error").isNull()).withColumn("_m", found)
    return usable.withColumns({"valid": F.col("_m.valid"), "seen": F.col("_m.seen")}).drop("_m")


def band_ranges(masked: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Lower and upper value per pair, date and band over valid pixels."""
    dates = F.array(
        F.struct(F.lit(0).alias("epoch"), F.col("earlier").alias("bands")),
        F.struct(F.lit(1).alias("epoch"), F.col("later").alias("bands")),
    )
    bands = masked.select("pair_id", "valid", F.explode(dates).alias("d")).select(
        "pair_id", "valid", "d.epoch", F.posexplode("d.bands").alias("band", "_values")
    )
    usable = F.zip_with("_values", "valid", lambda v, ok: F.when(ok, v))
    keys = ["pair_id", "epoch", "band"]
    if config.normalization == "min_max":
        return bands.groupBy(*keys).agg(F.min(F.array_min(usable)).alias("low"), F.max(F.array_max(usable)).alias("high"))
    values = bands.select(*keys, F.explode(usable).alias("value"))
    marks = {"low": config.percentile_lower / 100.0, "high": config.percentile_upper / 100.0}
    return exact_quantiles(values, keys, "value", marks)


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def normalized(value: Column, low: Column, high: Column, config: DetectionConfig) -> Column:
    if config.normalization == "none":
        return _unit(value)
    return F.when(high > low, _unit((value - low) / (high - low))).otherwise(0.0)


def with_ranges(masked: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Blocks with `low` / `high`: per date, an ARRAY by band."""
    if config.normalization == "none":
        empty = F.array().cast("array<double>")
        return masked.withColumns({f"{side}_{d}": empty for side in ("low", "high") for d in (0, 1)})
    ranges = band_ranges(masked, config)

    def by_band(date, side):
        entries = F.array_sort(F.collect_list(F.when(F.col("epoch") == date, F.struct("band", side))))
        return F.transform(entries, lambda e: e[side]).alias(f"{side}_{date}")

    per_pair = ranges.groupBy("pair_id").agg(*[by_band(d, s) for d in (0, 1) for s in ("low", "high")])
    return masked.join(per_pair, "pair_id", "left")


def score_map(masked: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Blocks with `scores`: mean absolute band difference in 0..1 per pixel, 0 where the pixel is not valid."""
    ranged = with_ranges(masked, config)

    def unit(x: np.ndarray, low, high) -> np.ndarray:
        if config.normalization == "none":
            return np.clip(x, 0.0, 1.0)
        low, high = (np.asarray(v, np.float64)[:, None] for v in (low, high))
        with np.errstate(all="ignore"):
            return np.where(high > low, np.clip((x - low) / (high - low), 0.0, 1.0), 0.0)

    @F.pandas_udf("array<double>")
    def mean_difference(
        earlier: pd.Series, later: pd.Series, valid: pd.Series, low_0: pd.Series, high_0: pd.Series, low_1: pd.Series, high_1: pd.Series
    ) -> pd.Series:
        out = []
        for e, l, ok, *marks in zip(earlier, later, valid, low_0, high_0, low_1, high_1):
            if not len(e) or any(m is None for m in marks):
                out.append(np.zeros(len(ok)))
                continue
            apart = np.abs(unit(_stacked(l, len(ok)), marks[2], marks[3]) - unit(_stacked(e, len(ok)), marks[0], marks[1]))
            out.append(np.where(np.asarray(ok, bool), np.clip(apart.sum(axis=0) / len(e), 0.0, 1.0), 0.0))
        return pd.Series(out)

    scores = mean_difference("earlier", "later", "valid", "low_0", "high_0", "low_1", "high_1")
    return ranged.select("pair_id", *BLOCK, "height", "width", "valid", "seen", scores.alias("scores"))


def score_pixels(scored: DataFrame, *extra: str) -> DataFrame:
    """Pixel rows (pair_id, row, col, valid, score)."""
    zipped = F.arrays_zip("valid", "scores")
    rows = scored.select("pair_id", "row0", "col0", "width", *extra, F.posexplode(zipped).alias("_pos", "_px"))
    return rows.select("pair_id", *_position(), F.col("_px.valid").alias("valid"), F.col("_px.scores").alias("score"), *extra)


def threshold(scored: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Per pair the score from which a pixel counts as changed; NULL when nothing changed at all."""
    pixels = score_pixels(scored).where("valid")
    stats = pixels.groupBy("pair_id").agg(
        F.max("score").alias("top"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")
    )
    if config.threshold_method == "fixed":
        raw = F.lit(float(config.fixed_threshold))
    elif config.threshold_method == "statistical":
        raw = F.when(F.col("std") == 0, F.col("mean")).otherwise(F.col("mean") + config.std_multiplier * F.col("std"))
    else:
        marks = exact_quantiles(pixels, ["pair_id"], "score", {"mark": config.threshold_percentile / 100.0})
        stats = stats.join(marks, "pair_id")
        raw = F.col("mark")
    return stats.select("pair_id", F.when(F.col("top") > 0, _unit(raw)).alias("threshold"))


def change_pixels(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Valid pixels with a score above zero and not below the threshold of their pair."""
    rows = score_pixels(scored.join(thresholds, "pair_id"), "threshold")
    return rows.where("valid AND score > 0 AND score >= threshold").select("pair_id", "row", "col", "score")


def label_regions(changed: DataFrame, config: DetectionConfig = DetectionConfig(), block: int = 512) -> DataFrame:
    """Connected changed pixels with `label`; components below the minimum area are left out."""
    labelled = label_pixels(changed, "pair_id", config.connectivity, block)
    sizes = labelled.groupBy("pair_id", "label").agg(F.count(F.lit(1)).alias("_area"))
    return labelled.join(sizes.where(F.col("_area") >= config.min_region_area), ["pair_id", "label"]).drop("_area")


def region_ids(labelled: DataFrame) -> DataFrame:
    """Per label its region id: numbered by area (largest first), then first row, then first column."""
    regions = labelled.groupBy("pair_id", "label").agg(
        (-F.count(F.lit(1))).alias("_order"), F.min("row").alias("_row"), F.min("col").alias("_col")
    ).withColumn("_tie", F.struct("_row", "_col", "label"))
    # Regions of one pair are numbered in slices of equal area and row band, never all in one task.
    slices = F.struct("_order", F.floor(F.col("_row") / 512))
    numbered = ordered(regions, ["pair_id"], "_order", "_tie", rank="_n", chunk=slices)
    return numbered.select("pair_id", "label", F.format_string("reg_%04d", "_n").alias("region_id"))


def with_region_ids(labelled: DataFrame) -> DataFrame:
    return labelled.join(region_ids(labelled), ["pair_id", "label"])


@dataclass(frozen=True)
class Detection:
    """The stage tables of one detection run over all pairs; `aligned` holds the blocks that can be compared, with their masks."""

    aligned: DataFrame
    scored: DataFrame
    thresholds: DataFrame
    members: DataFrame


def detect(pairs: DataFrame, rasters: DataFrame, config: DetectionConfig = DetectionConfig(), block: int = 512) -> Detection:
    """Pixel differences to numbered regions, for every pair at once.

    Aligned blocks are written once with their masks, so that the bands of both dates are shuffled in one place, whatever
    reads them; so are scores, because thresholds, changed pixels, metrics and context all read them.
    """
    aligned = cut(valid_mask(select_bands(align(pairs, rasters), config.bands), config))
    scored = cut(score_map(aligned, config))
    thresholds = threshold(scored, config)
    members = with_region_ids(label_regions(change_pixels(scored, thresholds), config, block))
    return Detection(aligned, scored, thresholds, members)


def region_stats(members: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per region. `frames` has pair_id, frame_height, frame_width, box columns and resolution_m."""
    px = members.groupBy("pair_id", "region_id").agg(
        F.count(F.lit(1)).alias("area_px"),
        F.min("row").alias("min_row"), F.min("col").alias("min_col"), F.max("row").alias("max_row"), F.max("col").alias("max_col"),
        F.avg("row").alias("_r"), F.avg("col").alias("_c"),
        F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.max("score"), 4).alias("max_score"),
    )
    joined = px.join(frames, "pair_id", "left")
    frame = geo.box(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    size = (F.col("frame_height"), F.col("frame_width"), frame)
    ul = geo.pixel_to_lonlat(F.col("min_row"), F.col("min_col"), *size, offset="ul")
    lr = geo.pixel_to_lonlat(F.col("max_row"), F.col("max_col"), *size, offset="lr")
    mid = geo.pixel_to_lonlat(F.col("_r"), F.col("_c"), *size)
    return joined.select(
        "pair_id", "region_id", "area_px", "min_row", "min_col", "max_row", "max_col",
        F.round("_r", 2).alias("centroid_row"), F.round("_c", 2).alias("centroid_col"), "mean_score", "max_score",
        F.round(F.col("area_px") * F.col("resolution_m") * F.col("resolution_m"), 2).alias("area_m2"),
        F.round(F.least(ul["lon"], lr["lon"]), 6).alias("min_lon"), F.round(F.least(ul["lat"], lr["lat"]), 6).alias("min_lat"),
        F.round(F.greatest(ul["lon"], lr["lon"]), 6).alias("max_lon"), F.round(F.greatest(ul["lat"], lr["lat"]), 6).alias("max_lat"),
        F.round(mid["lon"], 6).alias("lon"), F.round(mid["lat"], 6).alias("lat"),
        "frame_height", "frame_width",
    )


def with_geometry(regions: DataFrame) -> DataFrame:
    b = geo.box(*[F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])
    return regions.withColumn("geometry", geo.bbox_polygon(b))


def valid_counts(scored: DataFrame) -> DataFrame:
    ok = F.size(F.filter("valid", lambda v: v))
    return scored.groupBy("pair_id").agg(F.sum(ok).alias("valid_pixels"))


def change_metrics(scored: DataFrame, members: DataFrame, thresholds: DataFrame, frames: DataFrame) -> DataFrame:
    """Per pair: pixel counts, changed share of valid pixels, scores over retained regions, area."""
    counts = scored.select(
        "pair_id", F.size("valid").alias("n"), F.size(F.filter("valid", lambda v: v)).alias("ok")
    ).groupBy("pair_id").agg(F.sum("n").alias("total_pixels"), F.sum("ok").alias("valid_pixels"))
    changed = members.groupBy("pair_id", "region_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.max("score").alias("m")
    ).groupBy("pair_id").agg(
        F.sum("n").alias("changed_pixels"), F.count(F.lit(1)).alias("regions"), (F.sum("s") / F.sum("n")).alias("mean"), F.max("m").alias("max")
    )
    out = counts.join(thresholds, "pair_id", "left").join(changed, "pair_id", "left").join(frames.select("pair_id", "resolution_m"), "pair_id", "left")
    px = F.coalesce("changed_pixels", F.lit(0))
    return out.select(
        "pair_id", "total_pixels", "valid_pixels", (F.col("total_pixels") - F.col("valid_pixels")).alias("invalid_pixels"),
        px.alias("changed_pixels"), F.coalesce("regions", F.lit(0)).alias("regions"),
        F.when(F.col("valid_pixels") > 0, F.round(px / F.col("valid_pixels"), 4)).otherwise(0.0).alias("changed_fraction"),
        F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("mean_score"), F.round(F.coalesce("max", F.lit(0.0)), 4).alias("max_score"),
        F.round(F.coalesce("threshold", F.lit(0.0)), 4).alias("threshold_used"),
        F.round(px * F.col("resolution_m") * F.col("resolution_m"), 2).alias("changed_area_m2"),
    )


def filtered_mask(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pixels that stay in the mask: 1 retained, 2 flagged or undecided; suppressed pixels fall back to 0."""
    joined = members.join(decisions.select("pair_id", "region_id", "decision"), ["pair_id", "region_id"], "left")
    value = (
        F.when(F.lower("decision") == "suppressed", 0)
        .when(F.lower("decision").isin("flagged", "insufficient_evidence"), 2)
        .otherwise(1)
    )
    return joined.select("pair_id", "row", "col", value.alias("mask"))


# Tiling


def tile_grid(pixels: DataFrame, size: int) -> DataFrame:
    """Pixels with their tile position and the position inside the tile."""
    return pixels.select(
        "*",
        F.floor(F.col("row") / size).alias("tile_row"), F.floor(F.col("col") / size).alias("tile_col"),
        ((F.col("row") % size) * size + F.col("col") % size).alias("pos"),
    )


def pad_tiles(gridded: DataFrame, key: str, size: int, fill: Column | float = 0.0) -> DataFrame:
    """One row per tile and band with exactly size*size values; missing positions are filled."""
    tiles = gridded.groupBy(key, "tile_row", "tile_col", "band").agg(
        F.collect_list(F.struct("pos", "value")).alias("_px"),
        F.count(F.lit(1)).alias("pixels"), (F.max("col") - F.min("col") + 1).alias("width"), (F.max("row") - F.min("row") + 1).alias("height"),
    )
    fill = fill if isinstance(fill, Column) else F.lit(float(fill))

    @F.pandas_udf("array<double>")
    def padded(places: pd.Series, values: pd.Series, fills: pd.Series) -> pd.Series:
        out = []
        for at, held, blank in zip(places, values, fills):
            full, held = np.full(size * size, blank, np.float64), np.asarray(held, np.float64)
            known = ~np.isnan(held)
            full[np.asarray(at, np.int64)[known]] = held[known]
            out.append(full)
        return pd.Series(out)

    return tiles.withColumn("values", padded("_px.pos", "_px.value", fill.cast("double"))).drop("_px")


def tile_hash(padded: DataFrame, key: str) -> DataFrame:
    """SHA-256 over the canonical text of the padded tile, bands in order."""
    bands = F.array_sort(F.collect_list(F.struct("band", "values")))
    body = F.array_join(F.transform(bands, lambda b: F.array_join(F.transform(b["values"], lambda v: v.cast("string")), ",")), ";")
    return padded.groupBy(key, "tile_row", "tile_col").agg(F.sha2(body, 256).alias("sha256_hash"))


def tile_nodata(pixels: DataFrame, key: str, nodata: float | None) -> DataFrame:
    """Nodata pixels of the first band and the valid share (4 dp) per tile."""
    first = pixels.where("band = 0")
    close = F.lit(False) if nodata is None else F.abs(F.col("value") - nodata) <= 1e-8 + 1e-5 * abs(nodata)
    return first.groupBy(key, "tile_row", "tile_col").agg(F.count_if(close).alias("nodata_pixels"), F.count(F.lit(1)).alias("_n")).select(
        key, "tile_row", "tile_col", "nodata_pixels", F.round(1.0 - F.col("nodata_pixels") / F.col("_n"), 4).alias("valid_pixel_ratio")
    )


def nodata_of_blocks(blocks: DataFrame, key: str, size: int, nodata: float | None) -> DataFrame:
    """`tile_nodata` of raster blocks: every block is counted tile by tile in place, and only those counts are shuffled."""

    @F.pandas_udf("array<struct<tile_row: bigint, tile_col: bigint, nodata: bigint, n: bigint>>")
    def counted(first: pd.Series, row0: pd.Series, col0: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for values, r, c, w in zip(first, row0, col0, width):
            values = np.asarray([] if values is None else values, np.float64)
            at = np.arange(len(values))
            tiles = np.stack([(r + at // max(w, 1)) // size, (c + at % max(w, 1)) // size])
            which, place = np.unique(tiles, axis=1, return_inverse=True)
            close = np.zeros(len(values), bool) if nodata is None else np.abs(values - nodata) <= 1e-8 + 1e-5 * abs(nodata)
            blank, n = np.bincount(place.ravel()[close], minlength=which.shape[1]), np.bincount(place.ravel(), minlength=which.shape[1])
            out.append([{"tile_row": int(i), "tile_col": int(j), "nodata": int(b), "n": int(m)} for i, j, b, m in zip(*which, blank, n)])
        return pd.Series(out)

    tiles = blocks.select(key, F.explode(counted(F.get("bands", F.lit(0)), "row0", "col0", "width")).alias("_t")).select(key, "_t.*")
    return tiles.groupBy(key, "tile_row", "tile_col").agg(F.sum("nodata").alias("nodata_pixels"), F.sum("n").alias("_n")).select(
        key, "tile_row", "tile_col", "nodata_pixels", F.round(1.0 - F.col("nodata_pixels") / F.col("_n"), 4).alias("valid_pixel_ratio")
    )


def rescale_blocks(blocks: DataFrame, *keys: str) -> DataFrame:
    """`rescale_8bit` of raster blocks, all bands of a group between its extremes; only one pair of extremes for each block is shuffled."""
    flat = F.flatten("bands")
    limits = blocks.groupBy(*keys).agg(F.min(F.array_min(flat)).alias("_lo"), F.max(F.array_max(flat)).alias("_hi"))

    def stretch(v):
        byte = F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255.0).cast("int")
        return F.when(F.col("_hi") > F.col("_lo"), byte).otherwise(0)

    scaled = F.transform("bands", lambda band: F.transform(band, stretch))
    return blocks.join(limits, list(keys)).withColumn("bands", scaled).drop("_lo", "_hi")


def rescale_8bit(pixels: DataFrame, *keys: str) -> DataFrame:
    """Values stretched to 0..255 between the extremes of their group; a constant group becomes 0."""
    limits = pixels.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    stretched = F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255.0).cast("int")
    return pixels.join(limits, list(keys)).withColumn("byte", F.when(F.col("_hi") > F.col("_lo"), stretched).otherwise(0)).drop("_lo", "_hi")


def result_id(pair: Column, earlier: Column, later: Column, changed: Column, used: Column, algorithm: str = "pixel_difference", version: str = "1.0.0") -> Column:
    return text.content_id("res_", pair, earlier, later, changed, used, F.lit(algorithm), F.lit(version))
