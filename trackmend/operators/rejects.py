"""Rejects of single boxes.  A row is rejected once: ``reject_stage`` names the first rule that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmend.config import Config
from trackmend.functions.geometry import aspect_ratio, box, box_area
from trackmend.operators.merge import merge_duplicates

_BOX = ["x1", "y1", "x2", "y2"]


def _stage(rows: DataFrame):
    return F.col("reject_stage") if "reject_stage" in rows.columns else F.lit(None).cast("string")


def reject_size(rows: DataFrame, config: Config) -> DataFrame:
    a = box_area(box())
    return rows.withColumn("reject_stage", F.coalesce(_stage(rows), F.when((a < config.min_area_px2) | (a > config.max_area_px2), "size")))


def reject_shape(rows: DataFrame, config: Config) -> DataFrame:
    return rows.withColumn("reject_stage", F.coalesce(_stage(rows), F.when(aspect_ratio(box()) > config.max_aspect_ratio, "shape")))


def reject_reach(rows: DataFrame, config: Config, disparity: DataFrame | None) -> DataFrame:
    """Rejects boxes that the stereo signal says are out of reach; without a reliable signal a box stays.

    ``disparity``: (cid, frame, x1, y1, x2, y2, disp, match_conf).
    """
    if not config.stereo_enabled or config.reach_disparity_threshold_px is None or disparity is None:
        return rows.withColumn("reject_stage", _stage(rows))
    seen = disparity.dropDuplicates(["cid", "frame", *_BOX]).select("cid", "frame", *_BOX, "disp", "match_conf")
    far = (F.col("match_conf") >= config.stereo_match_min_confidence) & (F.col("disp") < config.reach_disparity_threshold_px)
    return rows.join(seen, ["cid", "frame", *_BOX], "left").withColumn("reject_stage", F.coalesce(_stage(rows), F.when(far, "stereo_reach"))).drop("disp", "match_conf")


def geometric_reject(detections: DataFrame, config: Config, disparity: DataFrame | None = None) -> DataFrame:
    """Merged candidates, each with the stage that rejects it or null.  Boxes with a number that isn't finite are rejected
    by themselves."""
    return judged(merge_duplicates(detections, config), config, disparity)


def judged(merged: DataFrame, config: Config, disparity: DataFrame | None = None) -> DataFrame:
    """``geometric_reject`` of boxes that are merged already."""
    rows = merged.withColumn("reject_stage", F.when(F.col("cand_idx").isNull(), "not_finite"))
    return reject_reach(reject_shape(reject_size(rows, config), config), config, disparity)
