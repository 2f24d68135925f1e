"""Operator settings. Rendered as literals, never shipped as data.

Defaults are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PairingConfig:
    min_separation_s: float = 0.0
    max_separation_s: float | None = None
    min_overlap: float = 0.5
    overlap_metric: str = "iou"  # iou | min | earlier | later; any other text means iou
    require_same_sensor: bool = False
    require_same_platform: bool = False


@dataclass(frozen=True)
class DetectionConfig:
    normalization: str = "robust_percentile"  # robust_percentile | min_max | none
    percentile_lower: float = 2.0
    percentile_upper: float = 98.0
    threshold_method: str = "statistical"  # fixed | statistical | percentile
    fixed_threshold: float = 0.2
    std_multiplier: float = 2.0
    threshold_percentile: float = 95.0
    min_region_area: int = 20
    connectivity: int = 8
    bands: tuple[int, ...] | None = None
    nodata: float | None = None
    quality_mask: bool = True

    def __post_init__(self) -> None:
        if self.connectivity not in (4, 8):
            raise ValueError("connectivity must be 4 or 8")
        if self.normalization not in ("robust_percentile", "min_max", "none"):
            raise ValueError(f"unknown normalization {self.normalization!r}")
        if self.threshold_method not in ("fixed", "statistical", "percentile"):
            raise ValueError(f"unknown threshold method {self.threshold_method!r}")


@dataclass(frozen=True)
class EvidenceConfig:
    buffer_px: int = 15
    min_context_pixels: int = 10
    water_threshold: float = 0.0
    band_roles: dict[str, int] = field(default_factory=dict)  # e.g. {"red": 0, "nir": 3}


@dataclass(frozen=True)
class ClassifierConfig:
    min_area_px: int = 10
    min_score: float = 0.45
    ambiguity_margin: float = 0.15
    construction_min_rectangularity: float = 0.60
    road_min_linearity: float = 0.75
    road_min_aspect: float = 5.0
    road_max_minor_axis: float = 30.0
    clearance_max_ndvi_delta: float = -0.15
    water_min_fraction: float = 0.40


@dataclass(frozen=True)
class ScreeningConfig:
    min_area_px: int = 10
    high_risk: float = 0.70
    flag_risk: float = 0.35
    shear_overlap: float = 0.70
    shear_max_width: float = 2.0
    shear_max_compactness: float = 0.08
    cloud_whiteness: float = 0.15
    cloud_reflectance: float = 0.35
    cloud_cirrus: float = 0.015
    snow_ndsi: float = 0.40
    shadow_vis: float = 0.10
    shadow_nir: float = 0.12
    illumination_coupling: float = 0.75
    illumination_median: float = 0.20
    contrast_margin: float = 0.15


@dataclass(frozen=True)
class TimelineConfig:
    min_persistent: int = 2
    min_support_score: float = 0.45
    min_iou: float = 0.30
    max_distance_m: float = 60.0
    max_cloud: float = 0.10
    min_valid: float = 0.90
    max_gap_days: float = 90.0
    ambiguity_margin: float = 0.05
    distance_margin_m: float = 15.0
