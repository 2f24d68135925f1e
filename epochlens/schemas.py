"""Declared schemas of the stored documents as DDL text; readers never infer."""

from __future__ import annotations

BOX = "struct<min_lon: double, min_lat: double, max_lon: double, max_lat: double>"

SCENE = (
    f"""scene_id string, sensor string, platform string, acquisition_time timestamp, crs string, bounds_wgs84 {BOX}, spatial_resolution_m double,
    cloud_cover_percentage double, bands array<string>, source_file_path string, is_cog boolean, tile_count int, nodata_value double,
    quality_info map<string, string>, file_hash string, processing_warnings array<string>, is_synthetic boolean, created_at timestamp"""
)
TILE = (
    f"""tile_id string, source_scene_id string, tile_col int, tile_row int, zoom_level int,
    dimensions struct<width_px: int, height_px: int, channels: int>, crs string, bounds_wgs84 {BOX}, acquisition_time timestamp, sensor string,
    file_path string, sha256_hash string, nodata_pixel_count bigint, valid_pixel_ratio double, is_synthetic boolean"""
)
PROVENANCE = (
    """provenance_id string, target_id string, source_scene_id string, processing_stage string, pipeline_version string, parameters string,
    executed_by string, timestamp timestamp"""
)
CORRUPT = "_corrupt_record"


def with_corrupt(schema: str) -> str:
    return f"{schema}, {CORRUPT} string"
