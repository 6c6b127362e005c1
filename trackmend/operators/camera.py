"""Camera motion from pose samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmend.config import Config
from trackmend.functions.geometry import wrap_deg


def vio_angular_rate(vio: DataFrame) -> DataFrame:
    """Pose samples with ``ang_rate``, degrees a frame: the length of the wrapped differences of the three angles."""
    placed = Window.partitionBy("cid").orderBy("idx")
    turn = [wrap_deg(F.col(c) - F.lag(c).over(placed)) for c in ("yaw", "pitch", "roll")]
    return vio.withColumn("ang_rate", F.coalesce(F.sqrt(sum((d * d for d in turn), F.lit(0.0))), F.lit(0.0)))


def camera_moving(config: Config) -> Column:
    return (F.col("speed") > config.camera_speed_moving_thresh) | (F.col("ang_rate") > config.camera_ang_moving_thresh_deg)


def vio_at_frame(frames: DataFrame, vio: DataFrame, config: Config) -> DataFrame:
    """Rows of (cid, frame, ...) with the speed, angular rate and ``camera_moving`` of the pose at their frame; frames
    beyond the last pose get that one.  Clips without poses count as still."""
    rates = vio_angular_rate(vio).select("cid", "idx", "speed", "ang_rate")
    last = vio.groupBy("cid").agg(F.max("idx").alias("last"))
    at = frames.join(last, "cid", "left").withColumn("idx", F.greatest(F.lit(0).cast("long"), F.least("frame", "last")))
    return at.join(rates, ["cid", "idx"], "left").withColumn("camera_moving", F.coalesce(camera_moving(config), F.lit(False))).drop("idx", "last")
