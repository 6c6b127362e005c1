"""Calibrating a configuration from a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trackmend.config import Config, hands
from trackmend.operators import calibration as c
from trackmend.operators.tracking import build_loose_tracks, stable_tracks


def calibrate(detections: DataFrame, frames: DataFrame, vio: DataFrame, disparity: DataFrame | None = None, base: Config | None = None, stable_frames: int = 30, dev_clips: DataFrame | None = None, loose: Config | None = None) -> tuple[DataFrame, Config]:
    """(one row of derived thresholds, the configuration).  The camera's percentiles are read first: the static
    threshold depends on them.  ``dev_clips`` (cid) are the clips whose frames of many boxes, all of them, say what the
    stereo signal is worth, all clips if not given; ``loose`` has other gates for the tracks that the thresholds are mined from."""
    found, config = report(detections, frames, vio, disparity, base, stable_frames, dev_clips, loose)
    return found["derived"], config


def report(
    detections: DataFrame, frames: DataFrame, vio: DataFrame, disparity: DataFrame | None = None, base: Config | None = None, stable_frames: int = 30, dev_clips: DataFrame | None = None, loose: Config | None = None
) -> tuple[dict[str, DataFrame], Config]:
    """(the statistics by name, one row each, with the thresholds that follow as ``derived``; the configuration)."""
    base = base or hands()
    tracks = build_loose_tracks(detections, frames, base, loose).persist()
    stable = stable_tracks(tracks, stable_frames)
    spark = detections.sparkSession

    def held(rows: DataFrame) -> DataFrame:
        """One row, computed once."""
        return spark.createDataFrame(rows.collect(), rows.schema).coalesce(1)  # else a join of several has a task for each combination

    camera = held(c.camera_motion_stats(vio))
    still = camera.first()
    at = base.but(camera_speed_moving_thresh=still.speed_p40 or 0.0, camera_ang_moving_thresh_deg=still.ang_rate_p40 or 0.0)
    given = disparity if disparity is not None else c.no_disparity(spark)
    if dev_clips is not None:
        given = given.join(dev_clips.select("cid").distinct(), "cid", "left_semi")
    sizes, gaps, static = (held(row) for row in c.track_stats(stable, vio, at))
    found = {
        "sizes": sizes,
        "gaps": gaps,
        "pool": held(c.pool_width_stats(detections, tracks)),
        "camera": camera,
        "static": static,
        "disparity": held(c.pick_disparity_threshold(c.label_disparity(given, tracks, detections, max_frames=None))),
    }
    found["derived"] = held(c.derived(*(found[k] for k in ("sizes", "gaps", "pool", "camera", "static", "disparity"))))
    tracks.unpersist()
    return found, c.config_from(found["derived"].first(), base)
