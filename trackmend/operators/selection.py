"""The strongest tracks of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmend.config import Config
from trackmend.operators.temporal import with_stage

_TRACK = ["cid", "track_id"]


def track_support(tracked: DataFrame) -> DataFrame:
    """(cid, track_id, n_frames, mean_confidence)."""
    return tracked.groupBy(*_TRACK).agg(F.count(F.lit(1)).alias("n_frames"), F.avg("confidence").alias("mean_confidence"))


def rank_tracks_per_frame(tracked: DataFrame) -> DataFrame:
    """Rows with ``track_rank`` in their frame: longest track first, then most confident, then list order."""
    of = Window.partitionBy(*_TRACK)
    rows = tracked.withColumn("n_frames", F.count(F.lit(1)).over(of)).withColumn("mean_confidence", F.avg("confidence").over(of))
    order = Window.partitionBy("cid", "frame").orderBy(F.desc("n_frames"), F.desc("mean_confidence"), "track_ord")
    return rows.withColumn("track_rank", F.row_number().over(order).cast("long"))


def top_tracks_per_frame(tracked: DataFrame, n: int = 2) -> DataFrame:
    return rank_tracks_per_frame(tracked).where(F.col("track_rank") <= n)


def select_cap(rows: DataFrame, config: Config) -> DataFrame:
    """Rejects, frame by frame, boxes of tracks beyond ``class_max``.  Support is that of the rows still live."""
    rows = with_stage(rows)
    if config.class_max is None:
        return rows
    of = Window.partitionBy(*_TRACK, "_live")
    w = rows.withColumn("_live", F.col("reject_stage").isNull()).withColumn("_n", F.count(F.lit(1)).over(of)).withColumn("_c", F.avg("confidence").over(of))
    rank = F.row_number().over(Window.partitionBy("cid", "frame", "_live").orderBy(F.desc("_n"), F.desc("_c"), "track_ord"))
    return w.withColumn("_rank", rank).withColumn("reject_stage", F.coalesce("reject_stage", F.when(F.col("_rank") > config.class_max, "cap"))).drop("_live", "_n", "_c", "_rank")
