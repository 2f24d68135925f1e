"""Boxes, distances and pixel coordinates. A box is a STRUCT<min_lon, min_lat, max_lon, max_lat>."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6371000.0  # fixed value
M_PER_DEG_LAT = 110540.0  # fixed value
M_PER_DEG_LON = 111320.0  # fixed value


def box(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    return F.struct(
        min_lon.alias("min_lon"), min_lat.alias("min_lat"), max_lon.alias("max_lon"), max_lat.alias("max_lat")
    )


def center(b: Column) -> tuple[Column, Column]:
    return (b["min_lon"] + b["max_lon"]) / 2.0, (b["min_lat"] + b["max_lat"]) / 2.0


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def bbox_overlap(a: Column, b: Column) -> Column:
    """Areas, shared box and overlap ratios in degrees; boxes that only touch do not overlap."""
    zero = F.lit(0.0)

    def area(x):
        return F.greatest(zero, x["max_lon"] - x["min_lon"]) * F.greatest(zero, x["max_lat"] - x["min_lat"])

    shared = box(
        F.greatest(a["min_lon"], b["min_lon"]),
        F.greatest(a["min_lat"], b["min_lat"]),
        F.least(a["max_lon"], b["max_lon"]),
        F.least(a["max_lat"], b["max_lat"]),
    )
    area_a, area_b = area(a), area(b)
    overlapping = (
        (shared["min_lon"] < shared["max_lon"]) & (shared["min_lat"] < shared["max_lat"]) & (area_a > 0) & (area_b > 0)
    )
    common = (shared["max_lon"] - shared["min_lon"]) * (shared["max_lat"] - shared["min_lat"])

    def ratio(denominator):
        return F.when(overlapping, F.round(_unit(common / denominator), 4)).otherwise(zero)

    def reported(x):
        return F.when(overlapping, F.round(x, 8)).otherwise(F.greatest(x, F.lit(1e-12)))

    return F.struct(
        F.when(overlapping, box(*[F.round(shared[k], 6) for k in ("min_lon", "min_lat", "max_lon", "max_lat")])).alias("bounds"),
        F.when(overlapping, F.round(common, 8)).otherwise(zero).alias("area"),
        reported(area_a).alias("earlier_area"),
        reported(area_b).alias("later_area"),
        ratio(area_a).alias("ratio_earlier"),
        ratio(area_b).alias("ratio_later"),
        ratio(area_a + area_b - common).alias("ratio_iou"),
        ratio(F.least(area_a, area_b)).alias("ratio_min"),
        overlapping.alias("overlapping"),
    )


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.round(F.lit(EARTH_RADIUS_M * 2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)), 2)


def metric_bbox(b: Column, origin_lon: Column, origin_lat: Column) -> Column:
    """Box in metres around a given origin; compared boxes must share the origin."""
    per_lon = F.lit(M_PER_DEG_LON) * F.greatest(F.lit(0.01), F.cos(F.radians(origin_lat)))
    return F.struct(
        ((b["min_lon"] - origin_lon) * per_lon).alias("x0"),
        ((b["min_lat"] - origin_lat) * M_PER_DEG_LAT).alias("y0"),
        ((b["max_lon"] - origin_lon) * per_lon).alias("x1"),
        ((b["max_lat"] - origin_lat) * M_PER_DEG_LAT).alias("y1"),
    )


def metric_iou(a: Column, b: Column) -> Column:
    """Box IoU in square metres, 4 dp, both boxes projected around the centre of `a`."""
    lon, lat = center(a)
    p, q = metric_bbox(a, lon, lat), metric_bbox(b, lon, lat)
    wide = F.least(p["x1"], q["x1"]) - F.greatest(p["x0"], q["x0"])
    high = F.least(p["y1"], q["y1"]) - F.greatest(p["y0"], q["y0"])

    def area(m):
        return F.greatest(F.lit(1e-6), (m["x1"] - m["x0"]) * (m["y1"] - m["y0"]))

    common = wide * high
    return F.when((wide > 0) & (high > 0), F.round(_unit(common / (area(p) + area(q) - common)), 4)).otherwise(0.0)


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.floor((lon + 180.0) / 6.0).cast("int") + 1
    return F.when(lat >= 0, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)


def grid_compat(crs_a, crs_b, gsd_a, gsd_b, transform_a, transform_b) -> Column:
    """STRUCT<crs, gsd, transform, compatible>; unknown sizes and transforms do not object, unknown CRS does.

    A transform is an ARRAY of six numbers: x origin, pixel width, skew, y origin, skew, pixel height.
    """
    known = (F.coalesce(crs_a, F.lit("")) != "") & (F.coalesce(crs_b, F.lit("")) != "")
    crs = known & (F.upper(F.trim(crs_a)) == F.upper(F.trim(crs_b)))
    larger = F.greatest(gsd_a, gsd_b)
    gsd = F.when(gsd_a.isNull() | gsd_b.isNull(), True).otherwise(
        F.when(larger > 0, F.abs(gsd_a - gsd_b) / larger <= 0.01).otherwise(False)
    )

    def near(i, eps):
        return F.abs(F.try_element_at(transform_a, F.lit(i)) - F.try_element_at(transform_b, F.lit(i))) < eps

    comparable = (F.coalesce(F.size(transform_a), F.lit(0)) >= 6) & (F.coalesce(F.size(transform_b), F.lit(0)) >= 6)
    same = F.when(comparable, near(2, 1e-4) & near(6, 1e-4) & near(1, 1e-2) & near(4, 1e-2)).otherwise(True)
    gsd, same = known & gsd, known & same
    return F.struct(
        F.coalesce(crs, F.lit(False)).alias("crs"),
        gsd.alias("gsd"),
        same.alias("transform"),
        F.coalesce(crs & gsd & same, F.lit(False)).alias("compatible"),
    )


_OFFSETS = {"ul": 0.0, "center": 0.5, "lr": 1.0}


def pixel_to_lonlat(row: Column, col: Column, height: Column, width: Column, bounds: Column, offset: str = "center") -> Column:
    shift = _OFFSETS[offset]
    return F.struct(
        (bounds["min_lon"] + (col + shift) / width * (bounds["max_lon"] - bounds["min_lon"])).alias("lon"),
        (bounds["max_lat"] - (row + shift) / height * (bounds["max_lat"] - bounds["min_lat"])).alias("lat"),
    )


def bbox_polygon(b: Column, digits: int = 6) -> Column:
    """GeoJSON polygon of a box as text: a closed ring of five points."""
    lon0, lat0, lon1, lat1 = (F.round(b[k], digits) for k in ("min_lon", "min_lat", "max_lon", "max_lat"))
    ring = F.array(*[F.array(x, y) for x, y in ((lon0, lat0), (lon1, lat0), (lon1, lat1), (lon0, lat1), (lon0, lat0))])
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def bbox_extent(b: Column) -> Column:
    lon, lat = center(b)
    return F.when(
        b.isNotNull(),
        F.struct(
            F.round(F.abs(b["max_lon"] - b["min_lon"]), 5).alias("lon_span"),
            F.round(F.abs(b["max_lat"] - b["min_lat"]), 5).alias("lat_span"),
            F.round(lon, 5).alias("center_lon"),
            F.round(lat, 5).alias("center_lat"),
        ),
    )


def ground_resolution(earlier_m: Column, later_m: Column, pixel_width: Column, pixel_height: Column) -> Column:
    """Metres per pixel from the earlier record, else the later one, else from a metric pixel size."""
    from_pixels = F.when(F.abs(pixel_width) > 0.1, (F.abs(pixel_width) + F.abs(pixel_height)) / 2.0)
    return F.coalesce(earlier_m, later_m, from_pixels)


def tile_bounds(origin_x, origin_y, pixel_width, pixel_height, col_off, row_off, width, height) -> Column:
    """Bounds of a pixel window, each side ordered and kept to 6 dp."""
    x0 = origin_x + col_off * pixel_width
    y0 = origin_y + row_off * pixel_height
    x1, y1 = x0 + width * pixel_width, y0 + height * pixel_height
    return box(*[F.round(v, 6) for v in (F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))])


#: Cells around the world at the finest level; each level has a quarter of them, so all levels close at 180 degrees.
CELLS_AROUND, LEVELS = 1 << 15, 8


def cell_size(level: Column) -> Column:
    """Degrees of a cell of a level."""
    return F.lit(360.0 / CELLS_AROUND) * F.pow(F.lit(4.0), level)


def cell_level(b: Column) -> Column:
    """The finest level at which a box meets at most four cells along each axis."""
    span = F.greatest(b["max_lon"] - b["min_lon"], b["max_lat"] - b["min_lat"]) / (3.0 * 360.0 / CELLS_AROUND)
    return F.when(span > 1, F.least(F.lit(LEVELS - 1), F.ceil(F.log(4.0, span)).cast("int"))).otherwise(0)


def cell_of(lon: Column, lat: Column, level: Column) -> Column:
    """STRUCT<cx, cy>: the cell of a place; longitudes wrap."""
    size = cell_size(level)
    around = (F.lit(CELLS_AROUND) / F.pow(F.lit(4.0), level)).cast("bigint")
    return F.struct(F.pmod(F.floor(lon / size), around).alias("cx"), F.floor((lat + 90.0) / size).alias("cy"))


def cells(b: Column, level: Column) -> Column:
    """Distinct cells of a level met by a box, as ARRAY<STRUCT<cx, cy>>, for equi-joins on space. At the box's own level
    and above there are 16 at most."""
    size = cell_size(level)
    around = (F.lit(CELLS_AROUND) / F.pow(F.lit(4.0), level)).cast("bigint")
    xs = F.array_distinct(F.transform(F.sequence(F.floor(b["min_lon"] / size), F.floor(b["max_lon"] / size)), lambda x: F.pmod(x, around)))
    ys = F.sequence(F.floor((b["min_lat"] + 90.0) / size), F.floor((b["max_lat"] + 90.0) / size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def unit_vector(lon: Column, lat: Column) -> Column:
    """STRUCT<x, y, z> on the unit sphere: straight distances grow with those over ground, poles and meridian included."""
    flat = F.cos(F.radians(lat))
    return F.struct((flat * F.cos(F.radians(lon))).alias("x"), (flat * F.sin(F.radians(lon))).alias("y"), F.sin(F.radians(lat)).alias("z"))


def meters_to_lat(m: float) -> float:
    return m / (2.0 * math.pi * EARTH_RADIUS_M / 360.0)
