"""Reading clip bundles: one folder for each clip with hand_boxes.json, frame_ts.json, vio_pose.json and meta.json.

Every reader takes ``clips``, the names of the clips to read: only their folders are listed and opened, so that one clip
of a large corpus costs as much as one of a small one.  Without it all folders are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOXES = "video_frame_count BIGINT, frames ARRAY<STRUCT<frame: BIGINT, detections: ARRAY<STRUCT<xyxy: ARRAY<DOUBLE>, class: INT, handedness: STRING, confidence: DOUBLE>>>>"
FRAME_TS = "frame_ts MAP<STRING, BIGINT>"
VIO = "t ARRAY<DOUBLE>, speed ARRAY<DOUBLE>, yaw ARRAY<DOUBLE>, pitch ARRAY<DOUBLE>, roll ARRAY<DOUBLE>"
META = "width BIGINT, height BIGINT"


def _cid() -> Column:
    """The name of the folder that a file is in; of a partition folder, its value."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/(?:cid=)?([^/]+)/[^/]+$", 1).alias("cid")


def _read(spark: SparkSession, root: str, name: str, schema: str, clips: Sequence[str] | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True)
    if clips is None:
        return reader.json(f"{root}/*/{name}")
    if not clips:
        return spark.createDataFrame([], schema).withColumn("_metadata", F.lit(None).cast("struct<file_path:string>"))
    special = str.maketrans({c: f"\\{c}" for c in "*?[]{}\\"})
    # a folder is called after its clip, or as a partition of it
    return reader.json([f"{root}/{{,cid=}}{str(c).translate(special)}/{name}" for c in dict.fromkeys(clips)])


def assign_det_ids(boxes: DataFrame) -> DataFrame:
    """Numbers each clip's boxes from 0 in document order, given ``frame_pos`` and ``det_pos``."""
    order = Window.partitionBy("cid").orderBy("frame_pos", "det_pos")
    return boxes.withColumn("det_id", F.row_number().over(order).cast("long") - 1)


def read_detections(spark: SparkSession, root: str, name: str = "hand_boxes.json", clips: Sequence[str] | None = None) -> DataFrame:
    """(cid, frame, det_id, x1, y1, x2, y2, cls, handedness, confidence).

    A clip is one document; its rows are numbered by a window after it is taken apart, which is linear in its size.
    """
    raw = _read(spark, root, name, BOXES, clips).select(_cid(), F.posexplode("frames").alias("frame_pos", "f"))
    boxes = raw.select("cid", "frame_pos", F.col("f.frame").alias("frame"), F.posexplode("f.detections").alias("det_pos", "d"))
    corners = [F.col("d.xyxy")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return assign_det_ids(boxes).select("cid", "frame", "det_id", *corners, F.col("d.class").alias("cls"), F.coalesce("d.handedness", F.lit("")).alias("handedness"), F.col("d.confidence").alias("confidence"))


def read_frames(spark: SparkSession, root: str, name: str = "hand_boxes.json", clips: Sequence[str] | None = None) -> DataFrame:
    """(cid, frame) of all frames, those without boxes too."""
    return _read(spark, root, name, BOXES, clips).select(_cid(), F.explode("frames.frame").alias("frame"))


def read_vio(spark: SparkSession, root: str, name: str = "vio_pose.json", clips: Sequence[str] | None = None) -> DataFrame:
    """(cid, idx, speed, yaw, pitch, roll)."""
    raw = _read(spark, root, name, VIO, clips).select(_cid(), F.posexplode(F.arrays_zip("speed", "yaw", "pitch", "roll")).alias("idx", "p"))
    return raw.select("cid", F.col("idx").cast("long").alias("idx"), "p.speed", "p.yaw", "p.pitch", "p.roll")


def read_frame_ts(spark: SparkSession, root: str, name: str = "frame_ts.json", clips: Sequence[str] | None = None) -> DataFrame:
    """(cid, frame, ts_ns)."""
    raw = _read(spark, root, name, FRAME_TS, clips).select(_cid(), F.explode("frame_ts").alias("frame", "ts_ns"))
    return raw.select("cid", F.col("frame").cast("bigint").alias("frame"), "ts_ns")


def read_clips(spark: SparkSession, root: str, name: str = "hand_boxes.json", meta_root: str | None = None, meta: str = "meta.json", clips: Sequence[str] | None = None) -> DataFrame:
    """(cid, frame_count, width, height) with the default size where a clip's meta names none."""
    counts = _read(spark, root, name, BOXES, clips).select(_cid(), F.col("video_frame_count").alias("frame_count"))
    sizes = _read(spark, meta_root or root, meta, META, clips).select(_cid(), "width", "height")
    size = [F.coalesce(F.col(c), F.lit(d)).cast("double").alias(c) for c, d in (("width", 1920), ("height", 1200))]
    return counts.join(sizes, "cid", "left").select("cid", "frame_count", *size)
