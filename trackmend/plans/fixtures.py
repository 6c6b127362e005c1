"""Boxes, frames, poses and tracks derived from the order tables: 500 order keys are a clip, an order is a frame, its
lines are boxes in lanes.  The same text runs in Spark SQL and DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from trackmend.config import Config

DETECTIONS = """
SELECT cid, frame, CAST(row_number() OVER (PARTITION BY cid ORDER BY frame, lane, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS det_id,
       lane, cx - w/2 AS x1, cy - h/2 AS y1, cx + w/2 AS x2, cy + h/2 AS y2, confidence, kind
FROM (SELECT CAST(floor(l_orderkey / 500) AS BIGINT) AS cid, CAST(l_orderkey % 500 AS BIGINT) AS frame,
             CAST(l_linenumber AS BIGINT) AS lane, l_partkey, l_suppkey, l_quantity, l_extendedprice,
             CAST(l_partkey % 97 AS INT) AS kind,
             (14 + l_quantity) / CAST(64 AS DOUBLE) AS confidence,
             CAST(250 * l_linenumber + ((l_suppkey % 9) - 4) AS DOUBLE) + CAST(abs((l_orderkey % 40) - 20) AS DOUBLE) * CAST(1.5 AS DOUBLE) AS cx,
             CAST(600 + ((l_partkey % 11) - 5) + CASE WHEN l_partkey % 97 = 2 THEN 300 ELSE 0 END AS DOUBLE) AS cy,
             CASE WHEN l_partkey % 97 = 0 THEN CAST(20 AS DOUBLE) WHEN l_partkey % 97 = 1 THEN CAST(30 AS DOUBLE) ELSE 120 + l_quantity END AS w,
             CASE WHEN l_partkey % 97 = 0 THEN CAST(20 AS DOUBLE) ELSE CAST(140 + (l_partkey % 30) AS DOUBLE) END AS h
      FROM {lineitem}) t"""
FRAMES = "SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS cid, CAST(o_orderkey % 500 AS BIGINT) AS frame FROM {orders}"
VIO = """
SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS cid, CAST(o_orderkey % 500 AS BIGINT) AS idx,
       CAST(o_custkey % 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS speed,
       CAST((floor((o_orderkey % 500) / 10) * 50) % 360 - 180 AS DOUBLE) AS yaw,
       CAST(0 AS DOUBLE) AS pitch, CAST(0 AS DOUBLE) AS roll
FROM {orders} WHERE o_orderkey % 500 < 497"""
CLIPS = "SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS cid, CAST(count(*) AS BIGINT) AS frame_count, CAST(1850 AS DOUBLE) AS width, CAST(1000 AS DOUBLE) AS height FROM {orders} GROUP BY 1"
TRACKED = """
SELECT cid, frame, track_id, track_ord, det_id, x1, y1, x2, y2, confidence, n > 1 AS was_merged FROM (
 SELECT cid, frame, lane AS track_id, lane AS track_ord, det_id, x1, y1, x2, y2, confidence,
        count(*) OVER (PARTITION BY cid, frame, lane) AS n,
        row_number() OVER (PARTITION BY cid, frame, lane ORDER BY confidence DESC, det_id) AS rk
 FROM {fx_detections} WHERE kind > 1) u WHERE rk = 1"""
#: Three lanes that move to and fro, far apart: two with few gaps, one with many.
STEADY_BOXES = """
SELECT cid, frame, CAST(row_number() OVER (PARTITION BY cid ORDER BY frame, lane) - 1 AS BIGINT) AS det_id, lane, cx - 60 AS x1, cy - 70 AS y1, cx + 60 AS x2, cy + 70 AS y2, confidence, CAST(5 AS INT) AS kind
FROM (SELECT CAST(floor(o_orderkey / 500) AS BIGINT) AS cid, CAST(o_orderkey % 500 AS BIGINT) AS frame, lane,
             CAST(250 + 600 * (lane - 1) + o_custkey % 5 AS DOUBLE) + CAST(abs((o_orderkey % 40) - 20) AS DOUBLE) * CAST(6 AS DOUBLE) AS cx,
             CAST(500 + o_custkey % 7 AS DOUBLE) AS cy, (20 + o_custkey % 40) / CAST(64 AS DOUBLE) AS confidence
      FROM (SELECT *, CAST(1 AS BIGINT) AS lane FROM {orders} WHERE o_custkey % 53 <> 0
            UNION ALL SELECT *, CAST(2 AS BIGINT) AS lane FROM {orders} WHERE o_custkey % 29 <> 0
            UNION ALL SELECT *, CAST(3 AS BIGINT) AS lane FROM {orders} WHERE o_custkey % 3 = 0) o) t"""
#: A stereo signal for each distinct box.
DISPARITY = """
SELECT cid, frame, x1, y1, x2, y2, CASE WHEN det_id % 11 = 0 THEN NULL ELSE CAST((det_id * 7) % 60 AS DOUBLE) + CASE WHEN lane <= 2 THEN 25 ELSE 0 END END AS disp, CAST(det_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS match_conf
FROM (SELECT cid, frame, x1, y1, x2, y2, min(det_id) AS det_id, min(lane) AS lane FROM {fx_detections} GROUP BY cid, frame, x1, y1, x2, y2) b"""

#: Thresholds under which all rules have something to reject in these tables.
CONFIG = Config(
    class_max=2, duplicate_overlap_threshold=0.6, min_area_px2=1000.0, max_area_px2=27000.0, max_aspect_ratio=3.0, max_speed_px_per_frame=100.0, resume_gate_px=60.0, min_track_len_supported=3,
    static_window_frames=15, static_motion_px_threshold=4.0, camera_speed_moving_thresh=0.078, camera_ang_moving_thresh_deg=0.34, max_dropout_frames=3, border_margin_px=50.0,
    border_weights={"top": 0.6, "bottom": 1.6, "left": 1.0, "right": 1.0}, outward_velocity_min_px_per_frame=2.0,
)
#: Under which tracks are just the lanes, cut where they are silent for more than five frames.
LANES = CONFIG.but(max_speed_px_per_frame=0.0, resume_gate_px=120.0, max_dropout_frames=2)
#: The same for whole jobs: a candidate is never further than 87 px from where its own lane's track is expected and never
#: nearer than 160 px to another's (boxes displaced by 300 px are lanes of their own), while gates go from 83 to 115 px.
CHAIN = CONFIG.but(max_speed_px_per_frame=8.0, resume_gate_px=75.0, max_dropout_frames=2)
#: For ``steady``: lanes are 600 px apart and never further than 112 px from where they are expected; gates go up to 340 px.
STEADY = CONFIG.but(max_speed_px_per_frame=40.0)


class Fixture:
    """The derived tables of a folder of order tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def detections(self) -> DataFrame:
        return self.spark.sql(DETECTIONS, lineitem=self._table("lineitem"))

    @cached_property
    def frames(self) -> DataFrame:
        return self.spark.sql(FRAMES, orders=self._table("orders"))

    @cached_property
    def vio(self) -> DataFrame:
        return self.spark.sql(VIO, orders=self._table("orders"))

    @cached_property
    def clips(self) -> DataFrame:
        return self.spark.sql(CLIPS, orders=self._table("orders"))

    @cached_property
    def tracked(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.spark.sql(TRACKED, fx_detections=self.detections).withColumn("source_ids", F.array("det_id"))

    @cached_property
    def steady(self) -> DataFrame:
        return self.spark.sql(STEADY_BOXES, orders=self._table("orders"))

    @cached_property
    def disparity(self) -> DataFrame:
        return self.spark.sql(DISPARITY, fx_detections=self.detections)


#: Opens a DuckDB query with the same tables.
PREFIX = (
    "WITH RECURSIVE fx_detections AS (" + DETECTIONS.format(lineitem="lineitem") + "), fx_frames AS (" + FRAMES.format(orders="orders") + "), fx_vio AS (" + VIO.format(orders="orders")
    + "), fx_clips AS (" + CLIPS.format(orders="orders") + "), fx_tracked AS (" + TRACKED.format(fx_detections="fx_detections") + "), fx_steady AS (" + STEADY_BOXES.format(orders="orders") + "), fx_disparity AS (" + DISPARITY.format(fx_detections="fx_detections") + ")"
)
