"""Identifiers, name parsing, tag lookups and canonical text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Tag names, time formats and name patterns that decide what is recognised.
TIME_TAGS = ("TIFFTAG_DATETIME", "DATETIME", "ACQUISITION_DATETIME", "acquisition_time")
TIME_FORMATS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss")
NAME_TIME = r"(\d{4})[_-]?(\d{2})[_-]?(\d{2})(?:[T_](\d{2})(\d{2})(\d{2}))?"
SENSOR_TAGS = ("SENSOR", "INSTRUMENT")
PLATFORM_TAGS = ("PLATFORM", "SATELLITE")
NAME_SENSORS = (
    (("S2A", "SENTINEL-2A"), "Sentinel-2A MSI", "Sentinel-2"),
    (("S2B", "SENTINEL-2B"), "Sentinel-2B MSI", "Sentinel-2"),
    (("LC08", "LANDSAT_8", "LANDSAT8"), "Landsat-8 OLI/TIRS", "Landsat-8"),
    (("LC09", "LANDSAT_9", "LANDSAT9"), "Landsat-9 OLI-2/TIRS-2", "Landsat-9"),
)
CLOUD_TAGS = ("CLOUD_COVER", "CLOUD_COVER_PERCENTAGE", "cloud_cover")
CLOUD_KEYS = ("cloud_fraction", "cloud_cover_percentage", "cloud_cover", "cloud_ratio")
VALID_KEYS = ("valid_pixel_ratio", "valid_pixel_fraction", "valid_pixels_fraction", "data_coverage")


def _tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def _tag_any_case(tags: Column, name: str) -> Column:
    """Value of a key whatever its case; of several spellings the last one counts."""
    same = F.filter(F.map_entries(tags), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(same, F.lit(-1))["value"]


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def parse_acquisition_time(tags: Column, stem: Column) -> Column:
    """First readable time tag, else a date (with optional clock) in the name, else NULL."""
    from_tags = [
        F.try_to_timestamp(F.trim(_tag(tags, tag)), F.lit(form)) for tag in TIME_TAGS for form in TIME_FORMATS
    ]
    part = [F.regexp_extract(stem, NAME_TIME, i) for i in range(7)]
    number = [F.coalesce(F.try_to_number(_filled(p), F.lit("9999")).cast("int"), F.lit(0)) for p in part]
    from_name = F.when(
        (part[0] != "") & number[1].between(1970, 2050),
        F.try_make_timestamp(number[1], number[2], number[3], number[4], number[5], number[6].cast("decimal(8,6)")),
    )
    return F.coalesce(*from_tags, from_name)


def parse_name_time(stem: Column) -> Column:
    return parse_acquisition_time(F.create_map().cast("map<string,string>"), stem)


def detect_sensor_platform(tags: Column, stem: Column) -> Column:
    """STRUCT<sensor, platform>; tags win over the name, and nothing is invented."""
    sensor, platform = (
        _filled(F.coalesce(*[_tag_any_case(tags, t) for t in names])) for names in (SENSOR_TAGS, PLATFORM_TAGS)
    )
    name = F.upper(stem)
    by_name = F.struct(F.lit("unknown").alias("sensor"), F.lit("unknown").alias("platform"))
    for patterns, instrument, satellite in reversed(NAME_SENSORS):
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | F.contains(name, F.lit(pattern))
        by_name = F.when(
            hit, F.struct(F.lit(instrument).alias("sensor"), F.lit(satellite).alias("platform"))
        ).otherwise(by_name)
    unknown = F.lit("unknown")
    return F.when(
        sensor.isNotNull() | platform.isNotNull(),
        F.struct(F.coalesce(sensor, unknown).alias("sensor"), F.coalesce(platform, unknown).alias("platform")),
    ).otherwise(by_name)


def scene_id(stem: Column, file_hash: Column) -> Column:
    return F.concat(F.regexp_replace(stem, "[^a-zA-Z0-9_-]", "_"), F.lit("_"), F.substring(file_hash, 1, 8))


def is_synthetic(stem: Column, tags: Column) -> Column:
    name = F.lower(stem)
    flagged = F.lower(F.coalesce(_tag(tags, "IS_SYNTHETIC"), F.lit(""))).isin("true", "1")
    return F.contains(name, F.lit("synthetic")) | F.contains(name, F.lit("demo")) | flagged


def cloud_pct(tags: Column) -> Column:
    return F.coalesce(*[_tag(tags, t) for t in CLOUD_TAGS]).try_cast("double")


def tile_id(scene: Column, col: Column, row: Column, zoom: Column) -> Column:
    return F.format_string("tile_%s_c%04d_r%04d_z%02d", scene, col, row, zoom)


def observation_id(tile: Column, sha256: Column) -> Column:
    return F.concat(F.lit("obs_"), tile, F.lit("_"), F.substring(sha256, 1, 8))


def grid_key(min_lon, min_lat, max_lon, max_lat, col, row, zoom, tile) -> Column:
    """Series anchor: box centre with grid position, read from columns or from the tile name."""
    lon, lat = (min_lon + max_lon) / 2.0, (min_lat + max_lat) / 2.0

    def anchored(c, r, z):
        return F.format_string(
            "grid_lon%.2f_lat%.2f_c%04d_r%04d_z%d", F.round(lon, 2), F.round(lat, 2), c.cast("int"), r.cast("int"), z
        )

    part = [F.regexp_extract(tile, r"c(\d+)_r(\d+)_z(\d+)", i) for i in range(4)]
    return (
        F.when(col.isNotNull() & row.isNotNull(), anchored(col, row, F.coalesce(zoom, F.lit(14)).cast("int")))
        .when(part[0] != "", anchored(part[1], part[2], part[3].cast("int")))
        .otherwise(
            F.concat(
                F.lit("geo_lon"), F.round(lon, 4).cast("string"), F.lit("_lat"), F.round(lat, 4).cast("string")
            )
        )
    )


def pair_id(earlier: Column, later: Column) -> Column:
    return F.concat(F.lit("pair_"), earlier, F.lit("__"), later)


def split_pair_id(pair: Column) -> Column:
    """STRUCT<earlier, later> of a pair id; NULL parts when the id has no separator."""
    parts = F.split(F.regexp_replace(pair, "^pair_", ""), "__", 2)
    paired = F.contains(pair, F.lit("__"))
    return F.struct(F.when(paired, parts[0]).alias("earlier"), F.when(paired, F.try_element_at(parts, F.lit(2))).alias("later"))


def content_id(prefix: str, *parts: Column) -> Column:
    """`prefix` + first 16 hex digits of the SHA-256 of the parts joined by a colon."""
    seed = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(seed, 256), 1, 16))


def sorted_ids(ids: Column) -> Column:
    return F.array_join(F.array_sort(ids), ";")


_LANES = 8


def set_digest(value: Column) -> Column:
    """Aggregate: order-free digest of distinct strings, with constant state per group; NULLs are left out.

    The eight 32-bit lanes of each SHA-256 are summed, so partial results combine before the shuffle and no list of
    ids is ever built; sums and count are hashed. A value that comes twice counts twice: remove repeats first.
    """
    return digest_of_lanes([F.sum(x) for x in lanes_of(value)], F.count(value))


def lanes_of(value: Column) -> list[Column]:
    """The eight 32-bit lanes of a string's SHA-256 as longs."""
    sha = F.sha2(value, 256)
    return [F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(_LANES)]


def digest_of_lanes(sums: Sequence[Column], count: Column) -> Column:
    """What `set_digest` makes of the summed lanes of a set's strings and of their number."""
    lanes = [F.lpad(F.lower(F.hex(F.coalesce(x, F.lit(0).cast("bigint")))), 16, "0") for x in sums]
    return F.sha2(F.concat(*lanes, F.coalesce(count, F.lit(0)).cast("string")), 256)


def band_at(keys: Column, values: Column, aliases: Sequence[str]) -> Column:
    """`band_lookup` on lower-case keys and their values, both in reverse order so that the last spelling counts."""
    value = F.coalesce(*[F.get(values, F.array_position(keys, a.lower()).cast("int") - 1) for a in aliases])
    return F.when(value > 1.0, value / 255.0).otherwise(value)


def band_lookup(bands: Column, aliases: Sequence[str]) -> Column:
    """First alias present, ignoring case; a value above one is taken as 0..255."""
    return band_at(F.reverse(F.transform(F.map_keys(bands), F.lower)), F.reverse(F.map_values(bands)), aliases)


def quality_meta(metadata: Column) -> Column:
    """STRUCT<cloud, valid, known>; percentages become fractions, missing stays missing."""

    def first_of(keys):
        value = F.coalesce(*[_tag(metadata, k) for k in keys]).try_cast("double")
        return F.when(value > 1.0, value / 100.0).otherwise(value)

    cloud, valid = first_of(CLOUD_KEYS), first_of(VALID_KEYS)
    return F.struct(cloud.alias("cloud"), valid.alias("valid"), (cloud.isNotNull() & valid.isNotNull()).alias("known"))


def normalize_decision(text: Column) -> Column:
    word = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(word.isin("CONFIRM", "CONFIRMED"), "CONFIRMED")
        .when(word.isin("REJECT", "REJECTED"), "REJECTED")
        .otherwise("PENDING")
    )


def canonical_json(**fields: Column) -> Column:
    """One-line JSON with keys in alphabetical order and NULL written as an empty text."""
    filled = []
    for name in sorted(fields):
        column = fields[name]
        filled.append(F.coalesce(column, F.lit("")).alias(name) if name != "revisionNumber" else F.coalesce(column, F.lit(1)).alias(name))
    return F.to_json(F.struct(*filled))


def band_names(descriptions: Column, count: Column, image: Column, prefix: str = "Band_") -> Column:
    """Description, else a positional name; plain images of 3 or 4 bands get colour names."""
    positional = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.coalesce(_filled(F.try_element_at(descriptions, i.cast("int"))), F.concat(F.lit(prefix), i.cast("string"))),
    )
    colours = [F.lit(c) for c in ("Red", "Green", "Blue", "Alpha")]
    return (
        F.when(image & (count == 3), F.array(*colours[:3]))
        .when(image & (count == 4), F.array(*colours))
        .otherwise(positional)
    )
