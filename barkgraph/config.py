"""Thresholds of the profile stage: the defaults and the preset that published results used."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ProfileConfig:
    visual_similarity: float = 0.65
    max_reid_gap_sec: float = 120.0
    duplicate_iou: float = 0.60
    duplicate_appearance: float = 0.45
    part_appearance: float = 0.88
    part_min_iou: float = 0.08
    part_min_ios: float = 0.25
    part_max_center_distance: float = 0.50
    min_common_frames: int = 2
    different_dog_iou: float = 0.20
    substantial_frames: int = 3
    static_min_duration_sec: float = 5.0
    static_max_motion: float = 0.15
    sparse_max_density: float = 0.02
    sparse_max_rows: int = 20
    boundary_window_sec: float = 8.0
    internal_motion: float = 1.5
    min_track_rows: int = 2
    suppress_likely_images: bool = False


DEFAULT = ProfileConfig()
FROZEN = replace(DEFAULT, duplicate_iou=0.35, duplicate_appearance=0.75, boundary_window_sec=15.0)


@dataclass(frozen=True)
class FusionConfig:
    audio_threshold: float = 0.60
    min_duration: float = 0.25
    max_duration: float = 5.0
