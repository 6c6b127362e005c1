"""Thresholds of the jobs, as data.  The defaults, and those of ``hands``, are fixed values of the method."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def _even_weights() -> dict[str, float]:
    return {"top": 1.0, "bottom": 1.0, "left": 1.0, "right": 1.0}


@dataclass(frozen=True)
class Config:
    class_max: int | None = None
    candidate_pool_width: int = 4
    duplicate_overlap_threshold: float = 0.6
    min_area_px2: float = 400.0
    max_area_px2: float = 400_000.0
    max_aspect_ratio: float = 3.0
    stereo_enabled: bool = False
    reach_disparity_threshold_px: float | None = None
    stereo_match_min_confidence: float = 0.5
    max_speed_px_per_frame: float = 250.0
    association_iou_weight: float = 0.5
    min_track_len_supported: int = 3
    static_window_frames: int = 15
    static_motion_px_threshold: float = 3.0
    camera_speed_moving_thresh: float = 0.02
    camera_ang_moving_thresh_deg: float = 0.15
    max_dropout_frames: int = 10
    resume_gate_px: float = 60.0
    border_margin_px: float = 40.0
    border_weights: dict[str, float] = field(default_factory=_even_weights)
    outward_velocity_min_px_per_frame: float = 2.0

    @property
    def give_up_frames(self) -> int:
        """Frames of silence after which a track ends."""
        return int(self.max_dropout_frames * 2) + 1

    def but(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)

    def loose(self) -> Config:
        """Merging only: every other gate is open, so that continuity alone makes the tracks."""
        return self.but(min_area_px2=0.0, max_area_px2=1e12, max_aspect_ratio=1e6, stereo_enabled=False, max_speed_px_per_frame=600.0, max_dropout_frames=90, resume_gate_px=250.0)


def hands() -> Config:
    """The preset for two hands seen from a head-mounted camera."""
    return Config(class_max=2, max_aspect_ratio=2.2, stereo_enabled=True, border_margin_px=50.0, border_weights={"top": 0.6, "bottom": 1.6, "left": 1.0, "right": 1.0})


def load_config(spark: SparkSession, path: str, missing: Config | None = None) -> Config:
    """Reads one JSON object; unknown keys are ignored.  Without such a file, ``missing`` or the hands preset."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path, wholetext=True).collect()  # one small file
    except AnalysisException:
        lines = []
    if not lines:
        return missing or hands()
    names = {f.name for f in dataclasses.fields(Config)}
    return Config(**{k: v for k, v in json.loads(lines[0].value).items() if k in names})


def save_config(spark: SparkSession, config: Config, path: str) -> None:
    spark.createDataFrame([(json.dumps(dataclasses.asdict(config)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
