"""Rejects that need a track: jumps, short tracks, and static scenery.

Rows are candidates with ``track_id`` and ``track_ord``.  They are rejected in place: ``reject_stage`` is set, and later
rules look at the rows where it is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trackmend.config import Config
from trackmend.functions.geometry import box, box_centroid, distance

_TRACK = ["cid", "track_id"]


def with_stage(rows: DataFrame) -> DataFrame:
    return rows if "reject_stage" in rows.columns else rows.withColumn("reject_stage", F.lit(None).cast("string"))


def track_motion(tracked: DataFrame) -> DataFrame:
    """Adds the frame before in the track, elapsed frames, displacement, speed, and velocity (0 for the first row)."""
    placed = Window.partitionBy(*_TRACK).orderBy("frame")
    x, y = box_centroid(box())
    rows = tracked.withColumn("_x", x).withColumn("_y", y)
    rows = rows.withColumn("prev_frame", F.lag("frame").over(placed)).withColumn("_px", F.lag("_x").over(placed)).withColumn("_py", F.lag("_y").over(placed))
    elapsed = F.col("frame") - F.col("prev_frame")
    steps = F.greatest(F.lit(1).cast("long"), elapsed)
    moved = distance((F.col("_x"), F.col("_y")), (F.col("_px"), F.col("_py")))
    rows = rows.withColumn("elapsed", elapsed).withColumn("displacement", moved).withColumn("speed_px", moved / steps)
    rows = rows.withColumn("vx", F.coalesce((F.col("_x") - F.col("_px")) / steps, F.lit(0.0))).withColumn("vy", F.coalesce((F.col("_y") - F.col("_py")) / steps, F.lit(0.0)))
    return rows.drop("_x", "_y", "_px", "_py")


class _Fold:
    """Compares each box of a track with the last one that stayed; boxes come by track and frame, a batch at a time.

    Where a box stayed, the next one is compared with it, which is done for all rows at once; a loop runs only from a
    fast step to the next box that stays.
    """

    def __init__(self, config: Config):
        self.most = config.max_speed_px_per_frame
        self.of, self.held = None, None

    def gone(self, cid: pa.Array, track: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, clip = len(track), cid.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        out = np.zeros(n, bool)
        same = np.append(False, (clip[1:] == clip[:-1]) & (track[1:] == track[:-1]))
        dx, dy, elapsed = (np.diff(v, prepend=v[0]) for v in (x, y, frame))
        fast = np.flatnonzero(same & (np.sqrt(dx * dx + dy * dy) / np.maximum(1, elapsed) > self.most))
        held, done = None, 0

        def run(k: int) -> int:
            """The first row from ``k`` on that stays, or is another track's."""
            begin = k
            while k < n and (k == begin or same[k]):
                d, e = x[k] - held[1], y[k] - held[2]
                if not math.sqrt(d * d + e * e) / max(1, frame[k] - held[0]) > self.most:
                    return k
                out[k] = True
                k += 1
            return k

        if self.of is not None and self.of == (cid[0].as_py(), int(track[0])):
            held = self.held
            done = run(0)
        for k in fast.tolist():
            if k > done or (k == done and not out[k - 1]):
                held = frame[k - 1], x[k - 1], y[k - 1]
                done = run(k)
        self.of = cid[n - 1].as_py(), int(track[-1])
        if not out[-1]:
            self.held = frame[-1], x[-1], y[-1]
        else:
            self.held = held
        return out


def reject_displacement(tracked: DataFrame, config: Config, dealt: bool = False) -> DataFrame:
    """Rejects boxes that are too far from the last one that stayed, in one pass over the rows of each clip.

    ``dealt`` says that rows of a clip are in one partition already.
    """
    rows = with_stage(tracked)
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Fold(config)
        for batch in batches:
            live = np.flatnonzero(batch.column("reject_stage").is_null().to_numpy(zero_copy_only=False) & batch.column("track_id").is_valid().to_numpy(zero_copy_only=False))
            if len(live):
                at = pa.array(live)
                x1, y1, x2, y2 = (batch.column(c).take(at).to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2"))
                gone = np.zeros(batch.num_rows, bool)
                gone[live] = state.gone(batch.column("cid").take(at), batch.column("track_id").take(at).to_numpy(), batch.column("frame").take(at).to_numpy(), (x1 + x2) / 2, (y1 + y2) / 2)
                stage = pc.if_else(pa.array(gone), "displacement", batch.column("reject_stage"))
                batch = batch.set_column(batch.schema.get_field_index("reject_stage"), "reject_stage", stage)
            yield batch

    rows = rows if dealt else rows.repartition("cid")
    return rows.sortWithinPartitions(*_TRACK, "frame").mapInArrow(fold, schema).repartition("cid")


def reject_unsupported(rows: DataFrame, config: Config) -> DataFrame:
    """Rejects what is left of tracks that are too short."""
    rows = with_stage(rows)
    n = F.sum(F.when(F.col("reject_stage").isNull(), 1).otherwise(0)).over(Window.partitionBy(*_TRACK))
    return rows.withColumn("_n", n).withColumn("reject_stage", F.coalesce("reject_stage", F.when(F.col("_n") < config.min_track_len_supported, "unsupported"))).drop("_n")


def reject_static(rows: DataFrame, config: Config) -> DataFrame:
    """Rejects boxes that hardly move, in a window around them, while the camera does (``camera_moving``)."""
    rows = with_stage(rows)
    h = config.static_window_frames // 2
    live = F.col("reject_stage").isNull()
    # rejected rows stand apart, so that a window holds rows of the live track only
    placed = Window.partitionBy(*_TRACK, "_live").orderBy("frame")
    around, pairs = placed.rowsBetween(-h, h), placed.rowsBetween(-h + 1, h)
    x, y = box_centroid(box())
    w = rows.withColumn("_live", live).withColumn("_x", x).withColumn("_y", y)
    steps = F.greatest(F.lit(1).cast("long"), F.col("frame") - F.lag("frame").over(placed))
    speed = distance((F.col("_x"), F.col("_y")), (F.lag("_x").over(placed), F.lag("_y").over(placed))) / steps
    w = w.withColumn("_speed", speed).withColumn("_moving", F.when(F.col("_speed").isNotNull(), F.col("camera_moving").cast("double")))
    w = w.withColumn("_n", F.count(F.lit(1)).over(around)).withColumn("_span", F.max("frame").over(around) - F.min("frame").over(around))
    w = w.withColumn("_mean", F.avg("_speed").over(pairs)).withColumn("_share", F.avg("_moving").over(pairs)).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*_TRACK, "_live")))
    dense = (F.col("_n") >= max(3, h)) & (F.col("_span") > 0) & (F.col("_n") / (F.col("_span") + 1) >= 0.5) & (F.col("_len") >= 2)
    static = dense & (F.col("_mean") < config.static_motion_px_threshold) & (F.col("_share") > 0.6)
    return w.withColumn("reject_stage", F.coalesce("reject_stage", F.when(F.coalesce(static, F.lit(False)), "static"))).drop("_live", "_x", "_y", "_speed", "_moving", "_n", "_span", "_mean", "_share", "_len")


def reject_temporal(rows: DataFrame, config: Config, dealt: bool = False) -> DataFrame:
    """The three rules in order."""
    return reject_static(reject_unsupported(reject_displacement(rows, config, dealt), config), config)
