"""Shape, spectral and context evidence of change regions.

`members` holds the pixels of all regions: (pair_id, region_id, row, col, score).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from epochlens.config import EvidenceConfig

REGION = ("pair_id", "region_id")


def region_perimeter(members: DataFrame) -> DataFrame:
    """Pixels with a neighbour (up, down, left, right) outside the region.

    Every pixel marks itself and its four neighbours; marks are counted per position, so no join is needed.
    """
    here = F.struct(F.col("row"), F.col("col"), F.lit(0).alias("n"))
    around = [
        F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(1).alias("n"))
        for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))
    ]
    marks = members.select(*REGION, F.explode(F.array(here, *around)).alias("m")).select(*REGION, "m.row", "m.col", "m.n")
    seen = marks.groupBy(*REGION, "row", "col").agg(F.min("n").alias("other"), F.sum("n").alias("neighbours"))
    return seen.where("other = 0").groupBy(*REGION).agg(F.greatest(F.count_if(F.col("neighbours") < 4), F.lit(1)).alias("perimeter_px"))


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def shape_descriptors(regions: DataFrame, perimeters: DataFrame) -> DataFrame:
    """Size and outline figures from area, box and perimeter (`regions` as made by region_stats)."""
    width, height = F.col("max_col") - F.col("min_col") + 1, F.col("max_row") - F.col("min_row") + 1
    area, around = F.col("area_px"), F.col("perimeter_px")
    edge = F.least(
        F.col("min_row"), F.col("frame_height") - 1 - F.col("max_row"), F.col("min_col"), F.col("frame_width") - 1 - F.col("max_col")
    )
    return regions.join(perimeters, list(REGION)).select(
        *REGION, "area_px", width.alias("width_px"), height.alias("height_px"), around.cast("double").alias("perimeter_px"),
        F.round(F.greatest(width, height) / F.least(width, height), 4).alias("aspect_ratio"),
        F.round(_clamp(F.lit(4.0 * math.pi) * area / (around * around)), 4).alias("compactness"),
        F.round(_clamp(area / (width * height)), 4).alias("rectangularity"),
        F.round(F.least(F.lit(1.0), 2.0 * F.sqrt(F.lit(math.pi) * area) / around), 4).alias("shape_regularity"),
        F.round(around / F.sqrt(area), 4).alias("fragmentation"),
        edge.cast("double").alias("border_distance_px"),
    )


def moments(members: DataFrame) -> DataFrame:
    """Principal axes from central second moments, with rows counted upwards."""
    m = members.groupBy(*REGION).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("col").alias("xx"), F.var_pop("row").alias("yy"), (F.lit(0.0) - F.covar_pop("col", "row")).alias("xy")
    )
    total, gap = F.col("xx") + F.col("yy"), F.col("xx") - F.col("yy")
    spread = F.sqrt(gap * gap + 4.0 * F.col("xy") * F.col("xy"))
    big, small = F.greatest(F.lit(0.0), (total + spread) / 2.0), F.greatest(F.lit(0.0), (total - spread) / 2.0)
    several = F.col("n") > 1
    major, minor = F.when(several, 4.0 * F.sqrt(big)).otherwise(1.0), F.when(several, 4.0 * F.sqrt(small)).otherwise(1.0)
    linear = F.when(several & (big + small > 1e-6), _clamp((big - small) / (big + small))).otherwise(0.0)

    def settled(x):  # a direction that is only rounding noise is no direction
        return F.when(F.abs(x) < 1e-9, 0.0).otherwise(x)

    angle = F.when(several, F.degrees(0.5 * F.atan2(2.0 * settled(F.col("xy")), settled(gap)))).otherwise(0.0)
    return m.select(
        *REGION, F.round(major, 2).alias("major_axis"), F.round(minor, 2).alias("minor_axis"),
        F.round(F.when(several, major / F.greatest(F.lit(1e-6), minor)).otherwise(1.0), 4).alias("axis_ratio"),
        F.round(linear, 4).alias("linearity_score"), F.round(angle, 2).alias("orientation_deg"),
    )


def region_neighbors(regions: DataFrame, buffer: int = 15, cell: int = 64) -> DataFrame:
    """Other regions of the pair whose box lies within `buffer` pixels (larger of row and column gap).

    Boxes grown by the buffer are listed in the grid cells they meet; a pair of boxes is counted only in the
    cell of the corner where their grown boxes start to overlap.
    """
    reach = buffer / 2.0

    def grid(prefix):
        def span(low, high):
            return F.sequence(F.floor((low - reach) / cell), F.floor((high + reach) / cell))

        rows = regions.select(*REGION, "min_row", "min_col", "max_row", "max_col").withColumn("cr", F.explode(span(F.col("min_row"), F.col("max_row"))))
        rows = rows.withColumn("cc", F.explode(span(F.col("min_col"), F.col("max_col"))))
        return rows.select("pair_id", "cr", "cc", *[F.col(c).alias(prefix + c) for c in ("region_id", "min_row", "min_col", "max_row", "max_col")])

    def gap(low, high):
        return F.greatest(F.lit(0), F.col("a" + low) - F.col("b" + high), F.col("b" + low) - F.col("a" + high))

    met = grid("a").join(grid("b"), ["pair_id", "cr", "cc"]).where(F.col("aregion_id") != F.col("bregion_id"))
    owner = (F.floor((F.greatest("amin_row", "bmin_row") - reach) / cell) == F.col("cr")) & (
        F.floor((F.greatest("amin_col", "bmin_col") - reach) / cell) == F.col("cc")
    )
    near = F.greatest(gap("min_row", "max_row"), gap("min_col", "max_col")) <= buffer
    counted = met.where(owner & near).groupBy("pair_id", F.col("aregion_id").alias("region_id")).agg(F.count(F.lit(1)).alias("neighbors"))
    return regions.select(*REGION).join(counted, list(REGION), "left").withColumn("neighbors", F.coalesce("neighbors", F.lit(0)))


def region_spectra(members: DataFrame, aligned: DataFrame, block: int = 512, nodata: float | None = None) -> DataFrame:
    """Region pixels with their band values of both dates (`e`, `l`), without NaN, infinite or nodata pixels.

    The pixels of a block are packed before the join, so raster blocks meet one row and are never repeated
    per pixel.
    """
    row0, col0 = (F.floor(F.col(c) / block) * block for c in ("row", "col"))
    packed = members.groupBy("pair_id", row0.cast("int").alias("row0"), col0.cast("int").alias("col0")).agg(
        F.collect_list(F.struct("region_id", "row", "col")).alias("_px")
    )
    both = packed.join(aligned.where(F.col("error").isNull()), ["pair_id", "row0", "col0"])

    def values(px, bands):
        at = (px["row"] - F.col("row0")) * F.col("width") + px["col"] - F.col("col0")
        return F.transform(bands, lambda b: F.get(b, at.cast("int")))

    rows = both.select(
        "pair_id",
        F.explode(
            F.transform("_px", lambda p: F.struct(p["region_id"].alias("region_id"), values(p, "earlier").alias("e"), values(p, "later").alias("l")))
        ).alias("p"),
    ).select("pair_id", "p.*")

    def usable(v):
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        return ok if nodata is None else ok & (v != nodata)

    return rows.where(F.forall("e", usable) & F.forall("l", usable))


def spectral_means(spectra: DataFrame, names: list[str], roles: dict[str, int] | None = None) -> DataFrame:
    """Per region and band: mean of both dates and their difference; role names repeat their band."""
    long = spectra.select(*REGION, F.posexplode(F.arrays_zip("e", "l")).alias("band", "v"))
    means = long.groupBy(*REGION, "band").agg(F.avg("v.e").alias("e"), F.avg("v.l").alias("l"))
    listed = [(n, i, True) for i, n in enumerate(names)] + [(r, i, False) for r, i in (roles or {}).items()]
    labels = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("at"), F.lit(own).alias("own")) for n, i, own in listed])
    named = means.withColumn("_n", F.explode(F.filter(labels, lambda x: x["at"] == F.col("band"))))
    return named.select(
        *REGION, F.col("_n.name").alias("name"), F.col("_n.own").alias("is_band"),
        F.round("e", 4).alias("earlier"), F.round("l", 4).alias("later"),
        F.round(F.col("l") - F.col("e"), 4).alias("delta"), F.round(F.abs(F.col("l") - F.col("e")), 4).alias("abs_delta"),
    )


def spectral_maps(means: DataFrame) -> DataFrame:
    """The band means of a region as MAPs by band name."""
    def as_map(c):
        return F.map_from_entries(F.collect_list(F.struct("name", c))).alias(c + "_by_band")

    return means.groupBy(*REGION).agg(*[as_map(c) for c in ("earlier", "later", "delta", "abs_delta")])


def _index(a: Column, b: Column) -> Column:
    return (a - b) / F.greatest(F.lit(1e-6), a + b)


def spectral_indices(spectra: DataFrame, config: EvidenceConfig) -> DataFrame:
    """NDVI and its change, NDWI and the share of water-like pixels; NULL where the bands have no role."""
    roles = config.band_roles

    def band(date, role):
        return F.get(F.col(date), F.lit(roles[role]))

    none = F.lit(None).cast("double")
    ndvi = delta = ndwi = water = none
    if {"nir", "red"} <= roles.keys():
        later, earlier = _index(band("l", "nir"), band("l", "red")), _index(band("e", "nir"), band("e", "red"))
        ndvi, delta = F.avg(later), F.avg(later - earlier)
    if {"green", "nir"} <= roles.keys():
        wet = _index(band("l", "green"), band("l", "nir"))
        ndwi, water = F.avg(wet), F.avg((wet > config.water_threshold).cast("double"))
    out = spectra.groupBy(*REGION).agg(F.count(F.lit(1)).alias("spectral_pixels"), *[
        F.round(c, 4).alias(n) if c is not none else F.max(none).alias(n)
        for n, c in (("ndvi_mean", ndvi), ("ndvi_delta", delta), ("ndwi_mean", ndwi), ("water_fraction", water))
    ])
    return out.withColumn("has_wavelength", F.lit(bool(roles)))


VISIBLE = ("red", "green", "blue", "band_1", "band_2", "band_3")


def brightness_delta(means: DataFrame) -> DataFrame:
    """Mean change of the visible bands, or of all bands when none is known to be visible."""
    visible = F.lit(False)
    for word in VISIBLE:
        visible = visible | F.contains(F.lower("name"), F.lit(word))
    shown = F.when(visible & F.col("is_band"), F.col("delta"))
    return means.groupBy(*REGION).agg(F.round(F.coalesce(F.avg(shown), F.avg("delta")), 4).alias("brightness_delta"))


def _window_sums():
    @F.pandas_udf("array<struct<region_id: string, n: bigint, total: double>>")
    def sums(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        """Count and sum of unchanged pixels inside each window, from summed-area tables of the block."""

        def corner(table, r0, r1, c0, c1):
            return table[r1, c1] - table[r0, c1] - table[r1, c0] + table[r0, c0]

        for batch in batches:
            out = []
            for scores, seen, height, width, rows, cols, ids, r0, r1, c0, c1 in zip(*batch):
                open_px = np.asarray(seen, dtype=bool).reshape(height, width).copy()
                if rows is not None:
                    open_px[np.asarray(rows), np.asarray(cols)] = False
                values = np.where(open_px, np.asarray(scores, dtype=np.float64).reshape(height, width), 0.0)
                area, total = np.zeros((height + 1, width + 1), np.int64), np.zeros((height + 1, width + 1))
                area[1:, 1:], total[1:, 1:] = open_px.cumsum(0).cumsum(1), values.cumsum(0).cumsum(1)
                box = (np.clip(r0, 0, height), np.clip(np.asarray(r1) + 1, 0, height), np.clip(c0, 0, width), np.clip(np.asarray(c1) + 1, 0, width))
                out.append([{"region_id": i, "n": int(n), "total": float(t)} for i, n, t in zip(ids, corner(area, *box), corner(total, *box))])
            yield pd.Series(out)

    return sums


def _surroundings(blocks: DataFrame, values: str, members: DataFrame, regions: DataFrame, buffer: int, block: int, *keys: str) -> DataFrame:
    """Per region (and `keys`) the number of unchanged pixels in its box grown by the buffer, and the sum of `values` there.

    Windows and changed pixels are packed per raster block, meet the block once, and each block answers for its
    windows; only one count and sum per window and block are exchanged.
    """

    def span(low, high):
        return F.sequence(F.floor((F.col(low) - buffer) / block), F.floor((F.col(high) + buffer) / block))

    placed = regions.select(*REGION, "min_row", "min_col", "max_row", "max_col").withColumn("_br", F.explode(span("min_row", "max_row")))
    placed = placed.withColumn("_bc", F.explode(span("min_col", "max_col"))).select(
        *REGION, (F.col("_br") * block).cast("int").alias("row0"), (F.col("_bc") * block).cast("int").alias("col0"), "min_row", "min_col", "max_row", "max_col"
    )
    at = ("pair_id", "row0", "col0")
    windows = placed.groupBy(*at).agg(F.collect_list(F.struct(
        "region_id", (F.col("min_row") - buffer - F.col("row0")).alias("r0"), (F.col("max_row") + buffer - F.col("row0")).alias("r1"),
        (F.col("min_col") - buffer - F.col("col0")).alias("c0"), (F.col("max_col") + buffer - F.col("col0")).alias("c1"),
    )).alias("_w"))
    row0, col0 = ((F.floor(F.col(c) / block) * block).cast("int") for c in ("row", "col"))
    taken = members.groupBy("pair_id", row0.alias("row0"), col0.alias("col0")).agg(
        F.collect_list(F.struct((F.col("row") % block).alias("r"), (F.col("col") % block).alias("c"))).alias("_t")
    )
    met = blocks.join(windows, list(at)).join(taken, list(at), "left")
    sums = _window_sums()(
        values, "seen", "height", "width", F.col("_t.r"), F.col("_t.c"), F.col("_w.region_id"), F.col("_w.r0"), F.col("_w.r1"), F.col("_w.c0"), F.col("_w.c1")
    )
    return met.select("pair_id", *keys, F.explode(sums).alias("s")).groupBy("pair_id", F.col("s.region_id").alias("region_id"), *keys).agg(
        F.sum("s.n").alias("context_pixels"), F.sum("s.total").alias("_total")
    )


def background_means(scored: DataFrame, aligned: DataFrame, members: DataFrame, regions: DataFrame, config: EvidenceConfig = EvidenceConfig(), block: int = 512) -> DataFrame:
    """Per region and band the mean of the later date over its unchanged surroundings, where these are large enough."""
    at = ["pair_id", "row0", "col0"]
    later = aligned.where(F.col("error").isNull()).select(*at, F.posexplode("later").alias("band", "values"))
    bands = scored.select(*at, "height", "width", "seen").join(later, at)
    around = _surroundings(bands, "values", members, regions, config.buffer_px, block, "band")
    enough = around.where(F.col("context_pixels") >= config.min_context_pixels)
    return enough.select(*REGION, "band", F.round(F.col("_total") / F.col("context_pixels"), 4).alias("background_mean"))


def context_contrast(scored: DataFrame, members: DataFrame, regions: DataFrame, config: EvidenceConfig = EvidenceConfig(), block: int = 512) -> DataFrame:
    """Unchanged surroundings of each region and how the region stands out from them."""
    around = _surroundings(scored, "scores", members, regions, config.buffer_px, block)
    enough = F.col("context_pixels") >= config.min_context_pixels
    mean = F.col("_total") / F.col("context_pixels")
    out = regions.select(*REGION, "mean_score").join(around, list(REGION), "left")
    return out.select(
        *REGION, F.coalesce("context_pixels", F.lit(0)).alias("context_pixels"),
        F.coalesce(enough, F.lit(False)).alias("context_available"),
        F.when(enough, F.round(mean, 4)).alias("surrounding_change"),
        F.when(enough, F.round(F.abs(F.col("mean_score") - mean), 4)).alias("contrast"),
    )


def region_score_stats(members: DataFrame, valid_pixels: DataFrame) -> DataFrame:
    """Change score figures; `valid_pixels` is (pair_id, valid_pixels)."""
    stats = members.groupBy(*REGION).agg(
        F.count(F.lit(1)).alias("_n"), F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.max("score"), 4).alias("max_score"), F.round(F.stddev_pop("score"), 4).alias("score_std"),
    )
    return stats.join(valid_pixels, "pair_id").select(
        *REGION, "mean_score", "max_score", "score_std",
        F.round(F.col("_n") / F.greatest(F.lit(1), F.col("valid_pixels")), 4).alias("changed_fraction"),
    )


# Unit, source and method of each reported feature.
FEATURES = {
    "area_px": ("px", "geometry", "pixel_count"),
    "width_px": ("px", "geometry", "bbox_width"),
    "height_px": ("px", "geometry", "bbox_height"),
    "aspect_ratio": (None, "geometry", "max_dim_over_min_dim"),
    "perimeter_px": ("px", "geometry", "contour_pixel_count"),
    "compactness": (None, "morphology", "isoperimetric_quotient"),
    "rectangularity": (None, "morphology", "area_over_bbox"),
    "linearity_score": (None, "morphology", "moment_inertia_ratio"),
    "orientation_deg": ("deg", "morphology", "principal_moment_angle"),
    "shape_regularity": (None, "morphology", "circle_perimeter_ratio"),
    "fragmentation": (None, "morphology", "perimeter_over_sqrt_area"),
    "ndvi_mean": ("index_score", "spectral", "(nir - red) / (nir + red)"),
    "ndvi_delta": ("index_delta", "spectral", "delta_ndvi"),
    "ndwi_mean": ("index_score", "spectral", "(green - nir) / (green + nir)"),
    "water_fraction": ("fraction", "spectral", "fraction_ndwi_gt_threshold"),
    "brightness_delta": (None, "spectral", "mean_visible_band_delta"),
    "contrast": (None, "context", "abs(region_score - background_score)"),
}


def feature_long(wide: DataFrame) -> DataFrame:
    """One row per region and feature with unit, source, method and availability."""
    present = [f for f in FEATURES if f in wide.columns]
    rows = wide.select(*REGION, *[F.col(f).cast("double") for f in present]).unpivot(list(REGION), present, "feature", "value")

    def lookup(i):
        table = F.create_map(*[F.lit(x) for f in present if FEATURES[f][i] for x in (f, FEATURES[f][i])])
        return F.try_element_at(table, F.col("feature"))

    return rows.select(
        *REGION, "feature", F.round("value", 4).alias("value"), lookup(0).alias("unit"), lookup(1).alias("source"), lookup(2).alias("method"),
        F.col("value").isNotNull().alias("available"),
        F.when(F.col("value").isNull(), "required input is missing").alias("reason"),
    )


def extract(scored: DataFrame, members: DataFrame, regions: DataFrame, aligned: DataFrame, valid_pixels: DataFrame,
            names: list[str], config: EvidenceConfig = EvidenceConfig(), block: int = 512, nodata: float | None = None) -> DataFrame:
    """All evidence of every region in one wide row."""
    spectra = region_spectra(members, aligned, block, nodata)
    means = spectral_means(spectra, names, config.band_roles)
    later = means.groupBy(*REGION).agg(F.map_from_entries(F.collect_list(F.struct("name", "later"))).alias("bands"))
    wide = shape_descriptors(regions, region_perimeter(members))
    for part in (
        moments(members), region_neighbors(regions, config.buffer_px), spectral_indices(spectra, config), brightness_delta(means), later,
        context_contrast(scored, members, regions, config, block), region_score_stats(members, valid_pixels),
    ):
        wide = wide.join(part, list(REGION), "left")
    return wide.withColumn("spectral_available", F.col("spectral_pixels").isNotNull()).withColumn(
        "has_wavelength", F.coalesce("has_wavelength", F.lit(False))
    )
