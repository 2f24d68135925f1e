"""Matching a candidate region to the regions of other pairs by place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from epochlens.config import TimelineConfig
from epochlens.functions import geo
from epochlens.session import cut

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
METERS_PER_DEGREE = 111_000.0  # slightly short, so a reach in degrees is never too small


def box_of(prefix: str = "") -> Column:
    return geo.box(*[F.col(prefix + c) for c in BOX])


def spatial_correspondence(
    box_a: Column, lon_a: Column, lat_a: Column, box_b: Column, lon_b: Column, lat_b: Column, grid: Column,
    distance_px: Column, config: TimelineConfig = TimelineConfig(),
) -> Column:
    """How two places compare: STRUCT<status, relationship, compatible, iou, distance_m>.

    `grid` is the result of geo.grid_compat; boxes and centres may be NULL.
    """
    boxes = box_a.isNotNull() & box_b.isNotNull()
    iou = F.when(boxes, geo.metric_iou(box_a, box_b)).otherwise(0.0)
    meters = geo.haversine_m(lon_a, lat_a, lon_b, lat_b)
    near = F.coalesce(meters <= config.max_distance_m, F.lit(False))
    compatible = (iou >= config.min_iou) | near
    status = (
        F.when(~compatible & F.coalesce(meters > 2.0 * config.max_distance_m, F.lit(False)), "DISJOINT")
        .when(grid["compatible"] & distance_px.isNotNull(), "EXACT_PIXEL_GRID")
        .when(boxes, "GEOREFERENCED_BBOX")
        .when(meters.isNotNull(), "GEOREFERENCED_CENTROID_ONLY")
        .when(box_a.isNull() & lon_a.isNull(), "INSUFFICIENT_METADATA")
        .otherwise("DISJOINT")
    )
    return F.struct(
        status.alias("status"), F.when(~compatible & (iou == 0.0), "NONE").otherwise("MATCHED").alias("relationship"),
        compatible.alias("compatible"), iou.alias("iou"), meters.alias("distance_m"),
    )


def candidate_x_regions(candidates: DataFrame, regions: DataFrame, config: TimelineConfig = TimelineConfig()) -> DataFrame:
    """Candidates with the regions of their target pair that overlap them or lie within reach, also across 180 degrees.

    candidates: candidate_id, pair_id, box, lon, lat; regions: pair_id, region_id, box, lon, lat. A box belongs to the
    level of the cell hierarchy at which it meets 16 cells at most, so wide boxes are listed in coarse cells. Boxes
    of different levels meet at the coarser one: each side is also listed above its own level, but only at levels
    that boxes of the other side have. A couple is kept only in the cell of the corner where its boxes begin to
    overlap, so nothing is compared twice and no pair is compared whole.
    """
    reach = config.max_distance_m / METERS_PER_DEGREE

    def boxed(df, prefix, keys, lon_pad, lat_pad):
        lon, lat = F.coalesce("min_lon", "lon"), F.coalesce("min_lat", "lat")
        grown = geo.box(lon - lon_pad, lat - lat_pad, F.coalesce("max_lon", "lon") + lon_pad, F.coalesce("max_lat", "lat") + lat_pad)
        rows = df.select(*keys, F.struct(*[F.col(c) for c in (*BOX, "lon", "lat")]).alias(prefix), grown.alias(f"{prefix}_grown"))
        return rows.withColumn("own", geo.cell_level(F.col(f"{prefix}_grown"))).where(F.col(f"{prefix}_grown.min_lon").isNotNull() & F.col(f"{prefix}_grown.min_lat").isNotNull())

    widest = F.greatest(F.lit(0.01), F.cos(F.radians(F.coalesce("lat", "min_lat"))))
    a = boxed(candidates, "a", ["candidate_id", "pair_id"], F.lit(reach) / widest, F.lit(reach))
    b = boxed(regions, "b", ["pair_id", "region_id"], F.lit(0.0), F.lit(0.0))

    def levels_of(rows):
        return rows.select(F.collect_set("own")).scalar()  # at most `geo.LEVELS` numbers

    def listed(rows, prefix, others, here):
        """The cells of a box at its own level as the side `here`, and at coarser levels of the other side as guest."""
        own = [F.struct(F.col("own").alias("level"), F.lit(host).alias("host")) for host in range(here + 1)]
        above = F.transform(F.sequence(F.col("own"), F.lit(geo.LEVELS - 1)), lambda v: F.struct(v.alias("level"), F.lit(1 - here).alias("host")))
        at = rows.withColumn("_at", F.explode(F.concat(F.array(*own), F.slice(above, 2, geo.LEVELS))))
        at = at.where((F.col("_at.level") == F.col("own")) | F.array_contains(others, F.col("_at.level")))
        cells = at.withColumn("_cell", F.explode(geo.cells(F.col(f"{prefix}_grown"), F.col("_at.level"))))
        return cells.select(*rows.drop("own").columns, "_at.level", "_at.host", "_cell.cx", "_cell.cy")

    # Host 0: the candidate is at its own level and the region at its own or above; host 1: the region is, the candidate above.
    left, right = listed(a, "a", levels_of(b), 0), listed(b, "b", levels_of(a), 1)
    p, q = F.col("a_grown"), F.col("b_grown")
    turn = F.round((p["min_lon"] + p["max_lon"] - q["min_lon"] - q["max_lon"]) / 720.0) * 360.0
    west, south = F.greatest(p["min_lon"], q["min_lon"] + turn), F.greatest(p["min_lat"], q["min_lat"])
    touching = (west <= F.least(p["max_lon"], q["max_lon"] + turn)) & (south <= F.least(p["max_lat"], q["max_lat"]))
    corner = geo.cell_of(west, south, F.col("level"))
    here = (corner["cx"] == F.col("cx")) & (corner["cy"] == F.col("cy"))
    met = left.join(right, ["pair_id", "level", "host", "cx", "cy"]).where(touching & here)
    boxes = F.col("a.min_lon").isNotNull() & F.col("b.min_lon").isNotNull()
    return met.select(
        "candidate_id", "pair_id", "region_id",
        F.when(boxes, geo.metric_iou(F.col("a"), F.col("b"))).otherwise(0.0).alias("iou"),
        geo.haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")).alias("distance_m"),
    )


#: Cubes of the nearest search: edge at the first level (the unit sphere meets about a hundred), division, and levels.
CUBE, CUBE_SPLIT, CUBE_LEVELS = 0.5, 8, 6
_AXES = ("x", "y", "z")
#: Pairs of so many regions are compared whole, without the hierarchy.
FEW_REGIONS = 64


def nearest_regions(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """(candidate_id, pair_id, distance_m): the distance to the nearest region centre of the target pair, however far.

    candidates: candidate_id, pair_id, lon, lat; regions: pair_id, region_id, lon, lat; rows without a place take no part.
    Centres are points of the unit sphere in a hierarchy of cubes, so nothing is special about poles or the meridian.
    Each candidate begins with all occupied cubes of the first level in its pair and goes down: the cubes in its
    frontier are replaced by their occupied parts, and a part stays only if it can hold a point as near as the
    farthest point of the best part can be. The frontier narrows to a ring of small cubes; only their points are compared.
    Places are searched for once, however many candidates and regions share them. Candidates of a pair with `FEW_REGIONS`
    regions or fewer are compared with all of them.
    """
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    all_points = regions.where(placed).select("pair_id", "lon", "lat")
    all_asked = candidates.where(placed).select("candidate_id", "pair_id", "lon", "lat")
    sizes = cut(all_points.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n")))
    few, many = (sizes.where(c).select("pair_id") for c in (F.col("_n") <= FEW_REGIONS, F.col("_n") > FEW_REGIONS))
    others = all_points.select("pair_id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    apart = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    key = ["candidate_id", "pair_id"]
    whole = all_asked.join(few, "pair_id", "left_semi").join(others, "pair_id").groupBy(*key).agg(F.min(apart).alias("distance_m"))

    vector = geo.unit_vector(F.col("lon"), F.col("lat")).alias("u")
    points = all_points.join(many, "pair_id", "left_semi").distinct().select("pair_id", "lon", "lat", vector)
    searching = all_asked.join(many, "pair_id", "left_semi")
    asked = searching.select("pair_id", "lon", "lat").distinct().select("pair_id", "lon", "lat", vector)

    def cube(level):
        return F.struct(*[F.floor(F.col("u")[c] / (CUBE / CUBE_SPLIT**level)).alias(c) for c in _AXES])

    def parent(name):
        return F.struct(*[F.floor(F.col(name)[c] / CUBE_SPLIT).alias(c) for c in _AXES])

    last = CUBE_LEVELS - 1
    leaves = cut(points.withColumn("cube", cube(last)))
    occupied = [leaves.select("pair_id", "cube").distinct()]
    for _ in range(last):
        occupied.append(occupied[-1].select("pair_id", parent("cube").alias("cube")).distinct())
    occupied.reverse()

    def narrowed(found, level):
        """Drop the cubes that the best one of the candidate beats."""
        edge = CUBE / CUBE_SPLIT**level
        apart = F.sqrt(sum((F.col("u")[c] - (F.col("cube")[c] + 0.5) * edge) ** 2 for c in _AXES))
        slack = edge * math.sqrt(3) / 2 + 1e-9
        kept = found.withColumn("_apart", apart).groupBy("pair_id", "lon", "lat", "u").agg(
            F.min("_apart").alias("_best"), F.collect_list(F.struct("cube", "_apart")).alias("_cubes")
        )
        near = F.filter("_cubes", lambda c: c["_apart"] - F.lit(slack) <= F.col("_best") + F.lit(slack))
        return kept.select("pair_id", "lon", "lat", "u", F.explode(F.transform(near, lambda c: c["cube"])).alias("cube"))

    frontier = narrowed(asked.join(occupied[0], "pair_id"), 0)
    for level in range(1, CUBE_LEVELS):
        parts = occupied[level].withColumn("_parent", parent("cube"))
        wider = frontier.withColumnRenamed("cube", "_parent").join(parts, ["pair_id", "_parent"]).drop("_parent")
        frontier = narrowed(wider, level)
    ends = leaves.select("pair_id", "cube", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    met = frontier.join(ends, ["pair_id", "cube"])
    found = met.groupBy("pair_id", "lon", "lat").agg(F.min(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))).alias("distance_m"))
    distant = searching.join(found, ["pair_id", "lon", "lat"]).groupBy(*key).agg(F.min("distance_m").alias("distance_m"))
    return whole.unionByName(distant)


def with_nearest(matches: DataFrame, candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Matches whose NONE rows carry the distance to the nearest region of their pair. Only candidates without a region
    in reach are searched for."""
    key = ["candidate_id", "pair_id"]
    matches = cut(matches)
    alone = matches.where((F.col("relationship") == "NONE") & (F.col("status") != "INSUFFICIENT_METADATA")).select(*key)
    found = nearest_regions(candidates.join(alone, key, "left_semi"), regions).withColumnRenamed("distance_m", "_nearest")
    rows = matches.join(found, key, "left")
    none = (F.col("relationship") == "NONE") & F.col("_nearest").isNotNull()
    return rows.withColumn("distance_m", F.when(none, F.col("_nearest")).otherwise(F.col("distance_m"))).select(matches.columns)


def match_scores(met: DataFrame) -> DataFrame:
    """The IoU of every compared region, for audit (one row each)."""
    return met.select("candidate_id", "pair_id", "region_id", "iou")


def resolve_match(candidates: DataFrame, met: DataFrame, config: TimelineConfig = TimelineConfig(), regions: DataFrame | None = None) -> DataFrame:
    """One row per candidate and target pair: the matched region, or why there is none.

    With `regions` (pair_id), a target pair without any region is disjoint, whatever is known of the candidate; only
    then does a candidate without a place lack metadata. The best two by IoU decide, else the nearest two by centre distance; a lead below the margin is ambiguous.
    The rows of one candidate and pair are the regions within reach of one place.
    """
    key = ["candidate_id", "pair_id"]

    one = F.struct("region_id", "iou", "distance_m")
    overlapping, near = F.col("iou") >= config.min_iou, F.col("distance_m") <= config.max_distance_m

    def order(flag, measure):
        return Window.partitionBy(*key).orderBy(F.when(flag, 0).otherwise(1), measure, "region_id")

    ranked = met.withColumns({
        "_o": F.row_number().over(order(overlapping, F.desc("iou"))), "_d": F.row_number().over(order(near, F.asc("distance_m"))),
    })
    # Both orders and the sums share one exchange on (candidate, pair).
    seen = ranked.groupBy(*key).agg(
        F.max(F.when(overlapping & (F.col("_o") == 1), one)).alias("o"), F.max(F.when(overlapping & (F.col("_o") == 2), F.col("iou"))).alias("o_second"),
        F.max(F.when(near & (F.col("_d") == 1), one)).alias("d"), F.max(F.when(near & (F.col("_d") == 2), F.col("distance_m"))).alias("d_second"),
        F.max("iou").alias("_iou"), F.min("distance_m").alias("_distance"),
    )
    rows = candidates.join(seen, key, "left").withColumn("_bare", F.lit(False))
    if regions is not None:
        occupied = regions.groupBy("pair_id").agg(F.lit(True).alias("_held"))
        rows = rows.drop("_bare").join(occupied, "pair_id", "left").withColumn("_bare", F.col("_held").isNull())
    blind = F.col("min_lon").isNull() & F.col("lon").isNull()
    has_o, has_d = F.col("o").isNotNull(), F.col("d").isNotNull()
    o_clear = F.col("o_second").isNull() | (F.col("o.iou") - F.col("o_second") >= config.ambiguity_margin)
    d_clear = F.col("d_second").isNull() | (F.col("d_second") - F.col("d.distance_m") >= config.distance_margin_m)
    pick = F.when(has_o & o_clear, F.col("o")).when(~has_o & has_d & d_clear, F.col("d"))
    return rows.select(
        *key,
        F.when(F.col("_bare"), "DISJOINT").when(blind, "INSUFFICIENT_METADATA").when(has_o, "GEOREFERENCED_BBOX").when(has_d, "GEOREFERENCED_CENTROID_ONLY").otherwise("DISJOINT").alias("status"),
        F.when(pick.isNotNull(), "MATCHED").when(has_o | has_d, "AMBIGUOUS").otherwise("NONE").alias("relationship"),
        pick["region_id"].alias("matched_region_id"),
        F.when(pick.isNotNull(), pick["iou"]).when(has_o, F.col("o.iou")).when(has_d, 0.0).otherwise(F.coalesce("_iou", F.lit(0.0))).alias("iou"),
        F.when(pick.isNotNull(), pick["distance_m"]).when(has_o, F.col("o.distance_m")).when(has_d, F.col("d.distance_m")).otherwise(F.col("_distance")).alias("distance_m"),
    )


def correspondence_summary(matches: DataFrame) -> DataFrame:
    """Per candidate: mean IoU, largest drift, shifted ids, and whether the place is stable (mean at least 0.5).

    matches: candidate_id, region_id (of the candidate), matched_region_id, iou, distance_m.
    """
    iou = F.coalesce("iou", F.when(F.col("matched_region_id").isNotNull(), 1.0).otherwise(0.0))
    shifted = F.coalesce(F.col("matched_region_id") != F.col("region_id"), F.lit(False))
    return matches.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("epochs"), F.round(F.avg(iou), 2).alias("average_iou"),
        F.round(F.max(F.coalesce("distance_m", F.lit(0.0))), 1).alias("max_drift_m"),
        F.count_if(shifted).alias("shifted_ids"), (F.avg(iou) >= 0.5).alias("is_stable"),
    )
