"""The registered queries of the detection jobs, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmend.config import Config
from trackmend.functions import geometry as g
from trackmend.operators import audit, calibration, camera, gaps, merge, rejects, selection, stereo, temporal, tracking, validation
from trackmend.plans import oracles as o
from trackmend.plans.correct import correct_detections, finish_accepted, stage_survivor_ids, staged
from trackmend.plans.fixtures import CHAIN, CONFIG, LANES, STEADY, Fixture
from trackmend.sources import bundles, sinks, staging
from trackmend.streaming.associate import associate_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_BOX = ["x1", "y1", "x2", "y2"]
#: Gates for loose tracks that SQL can follow: two tiny boxes of a lane may stand apart, so these are left out.
LOOSE = CONFIG.loose().but(min_area_px2=CONFIG.min_area_px2, max_speed_px_per_frame=CHAIN.max_speed_px_per_frame, resume_gate_px=CHAIN.resume_gate_px, max_dropout_frames=CHAIN.max_dropout_frames)


def query(sql: str | None = None) -> Callable[[Callable[[Fixture], DataFrame]], Callable[[Fixture], DataFrame]]:
    """Registers a function of the derived tables under its name."""

    def add(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",").alias(ids)


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="trackmend-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# projections


@query(o.q("", f"SELECT cid, det_id, {o.r6(o.area(), 'area')}, {o.r6(o.cx(), 'cx')}, {o.r6(o.cy(), 'cy')}, {o.r6('x2 - x1', 'w')}, {o.r6('y2 - y1', 'h')}, {o.r6(o.aspect(), 'aspect')}, {o.r6(o.diag(), 'diag')} FROM fx_detections"))
def box_measures(fx: Fixture) -> DataFrame:
    b = g.box()
    (x, y), (w, h) = g.box_centroid(b), g.box_wh(b)
    return fx.detections.select("cid", "det_id", r6(g.box_area(b), "area"), r6(x, "cx"), r6(y, "cy"), r6(w, "w"), r6(h, "h"), r6(g.aspect_ratio(b), "aspect"), r6(g.box_diag(b), "diag"))


@query(o.q("", f"SELECT a.cid, a.det_id AS det_a, b.det_id AS det_b, {o.r6(o.dist('a.', 'b.'), 'dist')}, {o.r6(o.iou('a.', 'b.'), 'iou')}, {o.r6(o.overlap('a.', 'b.'), 'overlap')} FROM fx_detections a JOIN fx_detections b ON a.cid = b.cid AND a.frame = b.frame AND a.det_id < b.det_id"))
def box_pair_measures(fx: Fixture) -> DataFrame:
    a = fx.detections.select("cid", "frame", F.col("det_id").alias("det_a"), *[F.col(c).alias(f"a_{c}") for c in _BOX])
    b = fx.detections.select("cid", "frame", F.col("det_id").alias("det_b"), *[F.col(c).alias(f"b_{c}") for c in _BOX])
    p, q = g.box("a_"), g.box("b_")
    return a.join(b, ["cid", "frame"]).where("det_a < det_b").select("cid", "det_a", "det_b", r6(g.centroid_distance(p, q), "dist"), r6(g.iou(p, q), "iou"), r6(g.overlap_ratio(p, q), "overlap"))


_NEXT = ", ".join(f"lead({c}) OVER w AS n_{c}" for c in _BOX)


@query(o.q("", f"SELECT cid, frame, track_id, {', '.join(f'round({c} + (n_{c} - {c}) * 0.25, 6) AS {c}' for c in _BOX)} FROM (SELECT *, {_NEXT} FROM fx_tracked WINDOW w AS (PARTITION BY cid, track_id ORDER BY frame)) t WHERE n_x1 IS NOT NULL"))
def lerp_box(fx: Fixture) -> DataFrame:
    from pyspark.sql import Window

    placed = Window.partitionBy("cid", "track_id").orderBy("frame")
    rows = fx.tracked.select("*", *[F.lead(c).over(placed).alias(f"n_{c}") for c in _BOX]).where("n_x1 is not null")
    return rows.select("cid", "frame", "track_id", *[r6(b, c) for b, c in zip(g.lerp_box(g.box(), g.box("n_"), F.lit(0.25)), _BOX, strict=True)])


@query(o.q("", f"SELECT cid, idx, {o.r6(o.wrap('yaw * 3 + idx'), 'wrapped')} FROM fx_vio"))
def wrap_deg(fx: Fixture) -> DataFrame:
    return fx.vio.select("cid", "idx", r6(g.wrap_deg(F.col("yaw") * 3 + F.col("idx")), "wrapped"))


# merging and rejects of single boxes


@query(o.q(o.PAIRS, "SELECT * FROM pairs"))
def duplicate_pairs(fx: Fixture) -> DataFrame:
    return merge.duplicate_pairs(fx.detections, CONFIG)


@query(o.q(o.merged(), "SELECT cid, frame, det_id, first FROM comp"))
def duplicate_components(fx: Fixture) -> DataFrame:
    return merge.duplicate_components(fx.detections, CONFIG)


_CAND = f"cid, frame, cand_idx, {o.BOX6}, {o.r6('confidence', 'confidence')}, array_to_string(source_ids, ',') AS source_ids, was_merged"


def _candidate(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select("cid", "frame", "cand_idx", *[r6(c) for c in _BOX], r6("confidence"), joined("source_ids"), "was_merged", *more)


@query(o.q(o.merged(), f"SELECT {_CAND} FROM cand"))
def merge_duplicates(fx: Fixture) -> DataFrame:
    return _candidate(merge.merge_duplicates(fx.detections, CONFIG))


@query(o.q("", f"SELECT cid, det_id, CASE WHEN {o.area()} < 1000 OR {o.area()} > 27000 THEN 'size' END AS reject_stage FROM fx_detections"))
def reject_size(fx: Fixture) -> DataFrame:
    return rejects.reject_size(fx.detections, CONFIG).select("cid", "det_id", "reject_stage")


@query(o.q("", f"SELECT cid, det_id, CASE WHEN {o.area()} < 1000 OR {o.area()} > 27000 THEN 'size' WHEN {o.aspect()} > 3.0 THEN 'shape' END AS reject_stage FROM fx_detections"))
def reject_shape(fx: Fixture) -> DataFrame:
    return rejects.reject_shape(rejects.reject_size(fx.detections, CONFIG), CONFIG).select("cid", "det_id", "reject_stage")


@query(o.q("", "SELECT d.cid, d.det_id, CASE WHEN s.match_conf >= 0.5 AND s.disp < 40 THEN 'stereo_reach' END AS reject_stage FROM fx_detections d JOIN fx_disparity s ON d.cid = s.cid AND d.frame = s.frame AND d.x1 = s.x1 AND d.y1 = s.y1 AND d.x2 = s.x2 AND d.y2 = s.y2"))
def reject_reach(fx: Fixture) -> DataFrame:
    config = CONFIG.but(stereo_enabled=True, reach_disparity_threshold_px=40.0)
    return rejects.reject_reach(fx.detections, config, fx.disparity).select("cid", "det_id", "reject_stage")


@query(o.q(o.merged() + ", " + o.GEO, f"SELECT {_CAND}, stage AS reject_stage FROM geo"))
def geometric_reject(fx: Fixture) -> DataFrame:
    return _candidate(rejects.geometric_reject(fx.detections, CONFIG), "reject_stage")


@query(o.q(o.merged() + ", " + o.GEO, "SELECT cid, CASE WHEN stage IS NOT NULL THEN 'rejected' WHEN was_merged THEN 'merged' ELSE 'reported' END AS status, CAST(count(*) AS BIGINT) AS n FROM geo GROUP BY 1, 2"))
def status_counts(fx: Fixture) -> DataFrame:
    rows = rejects.geometric_reject(fx.detections, CONFIG)
    return audit.status_counts(rows.withColumn("status", F.when(F.col("reject_stage").isNotNull(), "rejected").when(F.col("was_merged"), "merged").otherwise("reported")))


@query(o.q(o.merged() + ", " + o.GEO, "SELECT cid, stage AS reject_stage, CAST(count(*) AS BIGINT) AS n FROM geo WHERE stage IS NOT NULL GROUP BY ROLLUP (cid, stage)"))
def reject_stage_counts(fx: Fixture) -> DataFrame:
    return audit.reject_stage_counts(rejects.geometric_reject(fx.detections, CONFIG))


# camera


@query(o.q(o.RATE, f"SELECT cid, idx, {o.r6('speed', 'speed')}, {o.r6('ang_rate', 'ang_rate')} FROM rate"))
def vio_angular_rate(fx: Fixture) -> DataFrame:
    return camera.vio_angular_rate(fx.vio).select("cid", "idx", r6("speed"), r6("ang_rate"))


@query(o.q(o.RATE, f"SELECT f.cid, f.frame, {o.r6('speed', 'speed')}, {o.r6('ang_rate', 'ang_rate')}, {o.MOVING} AS camera_moving FROM fx_frames f JOIN lastpose l USING (cid) JOIN rate r ON r.cid = f.cid AND r.idx = greatest(0, least(f.frame, l.last))"))
def vio_at_frame(fx: Fixture) -> DataFrame:
    return camera.vio_at_frame(fx.frames, fx.vio, CONFIG).select("cid", "frame", r6("speed"), r6("ang_rate"), "camera_moving")


# tracking


def _candidates(fx: Fixture) -> DataFrame:
    return rejects.geometric_reject(fx.detections, CHAIN).where("reject_stage is null").drop("reject_stage")


@query(o.q(o.LANE_TRACKS, "SELECT cid, frame, cand_idx, track_id, track_ord FROM tk"))
def associate(fx: Fixture) -> DataFrame:
    return tracking.associate(_candidates(fx), fx.frames, CHAIN).select("cid", "frame", "cand_idx", "track_id", "track_ord")


@query(o.q(o.LANE_TRACKS, "SELECT cid, frame, cand_idx, track_id, false AS late FROM tk"))
def associate_stream_query(fx: Fixture) -> DataFrame:
    return _streamed(fx, _candidates(fx), CHAIN)


@query(o.q(o.merged(), "SELECT cid, frame, cand_idx, false AS late, true AS same FROM cand"))
def associate_all_candidates(fx: Fixture) -> DataFrame:
    """Boxes that single-box rules would reject, too: whether the stream gives each candidate the batch operator's number."""
    candidates = merge.merge_duplicates(fx.detections, LANES)
    batch = tracking.associate(candidates, fx.frames, LANES).select("cid", "frame", "cand_idx", F.col("track_id").alias("number"))
    both = _streamed(fx, candidates, LANES).join(batch, ["cid", "frame", "cand_idx"], "full")
    return both.select("cid", "frame", "cand_idx", "late", F.col("track_id").eqNullSafe(F.col("number")).alias("same"))


def _streamed(fx: Fixture, candidates: DataFrame, config: Config) -> DataFrame:
    spark = fx.spark
    source, out, marks = (_folder(spark, f"stream-{n}") for n in ("in", "out", "marks"))
    candidates.write.parquet(source)
    live = spark.readStream.schema(candidates.schema).parquet(source)
    associate_stream(live, config).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query()
def build_loose_tracks(fx: Fixture) -> DataFrame:
    """With the open gates of production, under which lanes compete for boxes: no SQL."""
    return tracking.build_loose_tracks(fx.detections, fx.frames, CONFIG).select("cid", "frame", "cand_idx", "track_id", "track_ord")


@query(o.q(o.LOOSE_TRACKS, "SELECT cid, frame, cand_idx, track_id, track_ord FROM tk"))
def build_loose_tracks_of_lanes(fx: Fixture) -> DataFrame:
    return tracking.build_loose_tracks(fx.detections, fx.frames, CONFIG, LOOSE).select("cid", "frame", "cand_idx", "track_id", "track_ord")


@query(o.q(o.STABLE, "SELECT cid, track_id, frame FROM stable"))
def stable_tracks(fx: Fixture) -> DataFrame:
    return tracking.stable_tracks(fx.tracked).select("cid", "track_id", "frame")


# rejects of tracks


@query(o.q(o.motion("fx_tracked"), "SELECT cid, track_id, frame, prev_frame, elapsed, round(displacement, 6) AS displacement, round(displacement / greatest(1, elapsed), 6) AS speed_px, round(vx, 6) AS vx, round(vy, 6) AS vy FROM mot"))
def track_motion(fx: Fixture) -> DataFrame:
    return temporal.track_motion(fx.tracked).select("cid", "track_id", "frame", "prev_frame", "elapsed", r6("displacement"), r6("speed_px"), r6("vx"), r6("vy"))


@query(o.q(o.DISPLACED, "SELECT cid, track_id, frame, CASE WHEN gone THEN 'displacement' END AS reject_stage FROM fold"))
def reject_displacement(fx: Fixture) -> DataFrame:
    return temporal.reject_displacement(fx.tracked, CONFIG).select("cid", "track_id", "frame", "reject_stage")


@query(o.q("", "SELECT cid, track_id, frame, CASE WHEN count(*) OVER (PARTITION BY cid, track_id) < 3 THEN 'unsupported' END AS reject_stage FROM (SELECT cid, frame, CAST(track_id * 100000 + floor(frame / 4) AS BIGINT) AS track_id FROM fx_tracked) t"))
def reject_unsupported(fx: Fixture) -> DataFrame:
    short = fx.tracked.withColumn("track_id", (F.col("track_id") * 100000 + F.floor(F.col("frame") / 4)).cast("long"))
    return temporal.reject_unsupported(short, CONFIG).select("cid", "track_id", "frame", "reject_stage")


@query(o.q(o.STATIC, f"SELECT cid, track_id, frame, CASE WHEN {o.IS_STATIC} THEN 'static' END AS reject_stage FROM win"))
def reject_static(fx: Fixture) -> DataFrame:
    rows = camera.vio_at_frame(fx.tracked, fx.vio, CONFIG)
    return temporal.reject_static(rows, CONFIG).select("cid", "track_id", "frame", "reject_stage")


@query(o.q(o.temporal("fx_tracked"), "SELECT cid, track_id, frame, st2 AS reject_stage FROM tmp"))
def reject_temporal(fx: Fixture) -> DataFrame:
    rows = camera.vio_at_frame(fx.tracked, fx.vio, CONFIG)
    return temporal.reject_temporal(rows, CONFIG).select("cid", "track_id", "frame", "reject_stage")


@query(o.q("", "SELECT cid, track_id, CAST(count(*) AS BIGINT) AS n_frames, round(avg(confidence), 6) AS mean_confidence FROM fx_tracked GROUP BY 1, 2"))
def track_support(fx: Fixture) -> DataFrame:
    return selection.track_support(fx.tracked).select("cid", "track_id", "n_frames", r6("mean_confidence"))


@query(o.q(o.RANKED, "SELECT cid, frame, track_id, track_rank FROM ranked"))
def rank_tracks_per_frame(fx: Fixture) -> DataFrame:
    return selection.rank_tracks_per_frame(fx.tracked).select("cid", "frame", "track_id", "track_rank")


@query(o.q(o.RANKED, "SELECT cid, frame, track_id FROM ranked WHERE track_rank <= 2"))
def top_tracks_per_frame(fx: Fixture) -> DataFrame:
    return selection.top_tracks_per_frame(fx.tracked).select("cid", "frame", "track_id")


@query(o.q(o.RANKED, "SELECT cid, frame, track_id, CASE WHEN track_rank > 2 THEN 'cap' END AS reject_stage FROM ranked"))
def select_cap(fx: Fixture) -> DataFrame:
    return selection.select_cap(fx.tracked, CONFIG).select("cid", "frame", "track_id", "reject_stage")


# gaps


@query(o.q("", "SELECT cid, track_id, CAST(row_number() OVER (PARTITION BY cid, track_id ORDER BY min(frame)) - 1 AS BIGINT) AS run, min(frame) AS start, max(frame) AS \"end\", CAST(count(*) AS BIGINT) AS length FROM (SELECT *, frame - row_number() OVER (PARTITION BY cid, track_id ORDER BY frame) AS i FROM fx_tracked) t GROUP BY cid, track_id, i"))
def contiguous_runs(fx: Fixture) -> DataFrame:
    return gaps.contiguous_runs(fx.tracked)


@query(o.q(o.gaps("fx_tracked"), "SELECT cid, track_id, frame, next_frame, gap, leaving, can_fill FROM gap"))
def classify_gaps(fx: Fixture) -> DataFrame:
    return gaps.classify_gaps(fx.tracked, fx.clips, CONFIG).select("cid", "track_id", "frame", "next_frame", "gap", "leaving", "can_fill")


@query(o.q(o.gaps("fx_tracked") + "," + o.SPLIT, "SELECT cid, track_id, frame, out_id FROM spl"))
def split_track_ids(fx: Fixture) -> DataFrame:
    return gaps.split_track_ids(gaps.classify_gaps(fx.tracked, fx.clips, CONFIG)).select("cid", "track_id", "frame", "out_id")


@query(o.q(o.gaps("fx_tracked") + "," + o.SPLIT + "," + o.FILL, f"SELECT cid, frame, track_id, {o.BOX6} FROM fil"))
def interpolate_gaps(fx: Fixture) -> DataFrame:
    return gaps.interpolate_gaps(gaps.split_track_ids(gaps.classify_gaps(fx.tracked, fx.clips, CONFIG))).select("cid", "frame", "track_id", *[r6(c) for c in _BOX])


@query(o.q(o.gaps("fx_tracked") + "," + o.SPLIT, "SELECT cid, frame, CASE WHEN was_merged THEN 'merged' ELSE 'reported' END AS status, out_id AS track_id, round(confidence, 6) AS confidence FROM spl"))
def finalize_tracks(fx: Fixture) -> DataFrame:
    return gaps.finalize_tracks(gaps.split_track_ids(gaps.classify_gaps(fx.tracked, fx.clips, CONFIG))).select("cid", "frame", "status", "track_id", r6("confidence"))


def _final(fx: Fixture) -> DataFrame:
    return gaps.interpolate_tracks(fx.tracked, fx.clips, CONFIG)


_FIN = o.gaps("fx_tracked") + "," + o.SPLIT + "," + o.FILL + "," + o.FINAL


@query(o.q(_FIN, f"SELECT cid, frame, status, track_id, {o.BOX6} FROM fin"))
def interpolate_tracks(fx: Fixture) -> DataFrame:
    return _final(fx).select("cid", "frame", "status", "track_id", *[r6(c) for c in _BOX])


# the account of boxes


@query(o.q("", "SELECT cid, det_id, kind <> 5 OR lane > 2 AS in_input, CAST(CASE WHEN kind = 7 THEN 0 WHEN kind = 8 THEN 2 ELSE 1 END AS BIGINT) AS n_output FROM fx_detections WHERE NOT (kind = 7 AND NOT (kind <> 5 OR lane > 2))"))
def completeness_check(fx: Fixture) -> DataFrame:
    out = fx.detections.where("kind <> 7").select("cid", F.array("det_id").alias("source_ids"))
    twice = fx.detections.where("kind = 8").select("cid", F.array("det_id").alias("source_ids"))
    return audit.completeness_check(fx.detections.where("kind <> 5 or lane > 2"), out.unionByName(twice)).withColumn("n_output", F.col("n_output").cast("long"))


def _corrected(fx: Fixture) -> DataFrame:
    return correct_detections(fx.detections, fx.frames, fx.vio, fx.clips, CHAIN)


_ACCOUNT = "SELECT cid, CAST(count(*) AS BIGINT) AS total_raw, CAST(count(*) AS BIGINT) AS accounted, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS n_duplicated, true AS ok FROM fx_detections GROUP BY cid"
_SPOILT = "double(CASE WHEN det_id % 50 = 7 THEN 'NaN' WHEN det_id % 50 = 9 THEN 'Infinity' WHEN det_id % 50 <> 11 THEN x1 END)"


@query(o.q("", _ACCOUNT))
def correct_detections_account(fx: Fixture) -> DataFrame:
    """The whole correction accounts for each box once, in every clip."""
    out = correct_detections(fx.detections, fx.frames, fx.vio, fx.clips, CONFIG)
    return audit.completeness_summary(audit.completeness_check(fx.detections, out))


@query(o.q("", f"SELECT a.*, CAST(n AS BIGINT) AS not_finite FROM ({_ACCOUNT}) a JOIN (SELECT cid, count(*) FILTER (WHERE det_id % 50 IN (7, 9, 11)) AS n FROM fx_detections GROUP BY 1) u USING (cid)"))
def correct_spoilt_detections_account(fx: Fixture) -> DataFrame:
    """The same where every fiftieth coordinate isn't a number, every fiftieth is infinite and every fiftieth is missing."""
    spoilt = fx.detections.withColumn("x1", F.expr(_SPOILT))
    out = correct_detections(spoilt, fx.frames, fx.vio, fx.clips, CHAIN)
    odd = out.where("reject_stage = 'not_finite'").groupBy("cid").agg(F.count(F.lit(1)).alias("not_finite"))
    return audit.completeness_summary(audit.completeness_check(spoilt, out)).join(odd, "cid")


@query(o.q(o.CHAINED, f"SELECT cid, frame, {o.BOX6}, status, round(confidence, 6) AS confidence, track_id, reject_stage, array_to_string(source_ids, ',') AS source_ids FROM out"))
def correct_detections_rows(fx: Fixture) -> DataFrame:
    return audit.sort_finalized(_corrected(fx)).select("cid", "frame", *[r6(c) for c in _BOX], "status", r6("confidence"), "track_id", "reject_stage", joined("source_ids"))


_SUMMARY = f"{o.CHAINED}, acc AS ({_ACCOUNT}), cnt AS (SELECT cid, " + ", ".join(f"CAST(count(*) FILTER (WHERE status = '{s}') AS BIGINT) AS {s}" for s in ("reported", "merged", "rejected", "interpolated")) + " FROM out GROUP BY 1)"


@query(o.q(_SUMMARY, "SELECT * FROM acc JOIN cnt USING (cid)"))
def run_summary(fx: Fixture) -> DataFrame:
    return sinks.run_summary(fx.detections, _corrected(fx))


@query(o.q(_SUMMARY, "SELECT * FROM acc JOIN cnt USING (cid)"))
def write_run_summary(fx: Fixture) -> DataFrame:
    path = _folder(fx.spark, "summary")
    sinks.write_run_summary(fx.detections, _corrected(fx), path)
    return fx.spark.read.schema("cid long, total_raw long, accounted long, missing long, n_duplicated long, ok boolean, reported long, merged long, rejected long, interpolated long").json(path)


@query(o.q(_FIN, f"SELECT cid, frame, status, track_id, {o.BOX6} FROM fin"))
def corrected_documents(fx: Fixture) -> DataFrame:
    """One document for each clip, taken apart again."""
    rows = sinks.corrected_documents(_final(fx)).select("cid", F.explode("detections").alias("d"))
    return rows.select("cid", "d.frame", "d.status", "d.track_id", *[r6(F.col(f"d.{c}"), c) for c in _BOX])


@query(o.q("", f"SELECT cid, frame, {o.BOX6}, CAST(1234.5 AS DOUBLE) AS min_area_px2 FROM fx_detections WHERE {o.area()} >= 1234.5"))
def config_round_trip(fx: Fixture) -> DataFrame:
    """Boxes that pass a rule whose threshold was saved and loaded again."""
    from trackmend.config import load_config, save_config

    path = _folder(fx.spark, "config")
    save_config(fx.spark, CONFIG.but(min_area_px2=1234.5, max_area_px2=1e12), path)
    config = load_config(fx.spark, path)
    live = rejects.reject_size(fx.detections, config).where("reject_stage is null")
    return live.select("cid", "frame", *[r6(c) for c in _BOX], F.lit(config.min_area_px2).alias("min_area_px2"))


# calibration

_MOT = o.STABLE + "," + o.motion("stable")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[r6(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query(o.q(_MOT, f"SELECT CAST(count(*) AS BIGINT) AS n_boxes, {o.pct(o.area(), 'area', calibration.AREA)}, {o.pct(o.aspect(), 'aspect', calibration.ASPECT)}, {o.pct('displacement', 'speed', calibration.SPEED, 'elapsed = 1')} FROM mot"))
def size_shape_speed_stats(fx: Fixture) -> DataFrame:
    return _rounded(calibration.size_shape_speed_stats(tracking.stable_tracks(fx.tracked)))


_GAPS = _MOT + f", sc AS (SELECT *, greatest({o.diag()}, lag({o.diag()}) OVER (PARTITION BY cid, track_id ORDER BY frame)) AS s FROM mot), near AS (SELECT elapsed - 1 AS gap FROM sc WHERE elapsed > 1 AND s > 0 AND displacement <= 1.5 * s)"


@query(o.q(_GAPS, f"SELECT CAST(count(*) AS BIGINT) AS n_gaps, max(gap) AS max_gap, {o.pct('CAST(gap AS DOUBLE)', 'gap', calibration.GAP)} FROM near"))
def dropout_stats(fx: Fixture) -> DataFrame:
    return _rounded(calibration.dropout_stats(tracking.stable_tracks(fx.tracked)))


@query(o.q("", "SELECT cid, frame, det_id, CAST(row_number() OVER (PARTITION BY cid, frame ORDER BY confidence DESC, det_id) AS BIGINT) AS confidence_rank FROM fx_detections"))
def raw_confidence_rank(fx: Fixture) -> DataFrame:
    return calibration.raw_confidence_rank(fx.detections).select("cid", "frame", "det_id", "confidence_rank")


@query(o.q(o.MULTI, "SELECT * FROM multi"))
def multibox_frames(fx: Fixture) -> DataFrame:
    return calibration.multibox_frames(fx.detections)


_RANKS = f"{o.RANKED}, {o.MULTI}, cr AS (SELECT *, row_number() OVER (PARTITION BY cid, frame ORDER BY confidence DESC, det_id) AS confidence_rank FROM fx_detections), tb AS (SELECT r.cid, r.frame, r.track_id, CAST(min(c.confidence_rank) AS BIGINT) AS confidence_rank FROM ranked r JOIN multi m USING (cid, frame) JOIN cr c ON c.cid = r.cid AND c.frame = r.frame AND c.x1 = r.x1 AND c.y1 = r.y1 AND c.x2 = r.x2 AND c.y2 = r.y2 WHERE r.track_rank <= 2 GROUP BY 1, 2, 3)"


@query(o.q(_RANKS, "SELECT * FROM tb"))
def true_box_rank_match(fx: Fixture) -> DataFrame:
    return calibration.true_box_rank_match(fx.detections, fx.tracked)


@query(o.q(_RANKS, "SELECT CAST(count(*) AS BIGINT) AS n_ranks, round(quantile_cont(CAST(confidence_rank AS DOUBLE), 0.95), 6) AS rank_p95, CAST(floor(greatest(2.0, quantile_cont(CAST(confidence_rank AS DOUBLE), 0.95))) AS BIGINT) AS pool_width FROM tb"))
def pool_width_stats(fx: Fixture) -> DataFrame:
    return _rounded(calibration.pool_width_stats(fx.detections, fx.tracked))


@query(o.q(o.RATE, f"SELECT {o.pct('speed', 'speed', calibration.MOTION)}, {o.pct('ang_rate', 'ang_rate', calibration.MOTION)} FROM rate"))
def camera_motion_stats(fx: Fixture) -> DataFrame:
    return _rounded(calibration.camera_motion_stats(fx.vio))


_STILL = _MOT + f", {o.RATE}, mv AS (SELECT t.displacement FROM mot t JOIN lastpose l USING (cid) JOIN rate r ON r.cid = t.cid AND r.idx = greatest(0, least(t.frame, l.last)) WHERE t.elapsed = 1 AND {o.MOVING})"


@query(o.q(_STILL, f"SELECT CAST(count(*) AS BIGINT) AS n_static, {o.pct('displacement', 'static', calibration.STATIC)} FROM mv"))
def static_motion_stats(fx: Fixture) -> DataFrame:
    return _rounded(calibration.static_motion_stats(tracking.stable_tracks(fx.tracked), fx.vio, CONFIG))


_STRIDE = f"{o.MULTI}, nb AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY cid) AS c FROM multi), pick AS (SELECT DISTINCT cid, (j * c) // 150 AS i FROM (SELECT DISTINCT cid, c FROM nb) u, range(150) g(j)), st AS (SELECT nb.cid, nb.frame FROM nb LEFT JOIN pick p ON p.cid = nb.cid AND p.i = nb.i WHERE nb.c <= 150 OR p.i IS NOT NULL)"


@query(o.q(_STRIDE, "SELECT cid, frame FROM st"))
def stride_sample(fx: Fixture) -> DataFrame:
    return calibration.stride_sample(calibration.multibox_frames(fx.detections), 150, ["frame"]).select("cid", "frame")


_LABEL = f"{_STRIDE}, {o.RANKED}, lab AS (SELECT d.*, EXISTS (SELECT 1 FROM ranked r WHERE r.track_rank <= 2 AND r.cid = d.cid AND r.frame = d.frame AND r.x1 = d.x1 AND r.y1 = d.y1 AND r.x2 = d.x2 AND r.y2 = d.y2) AS is_wearer FROM fx_disparity d JOIN st ON st.cid = d.cid AND st.frame = d.frame WHERE d.disp IS NOT NULL AND d.match_conf >= 0.4)"


@query(o.q(_LABEL, f"SELECT cid, frame, {o.BOX6}, disp, match_conf, is_wearer FROM lab"))
def label_disparity(fx: Fixture) -> DataFrame:
    return calibration.label_disparity(fx.disparity, fx.tracked, fx.detections).select("cid", "frame", *[r6(c) for c in _BOX], "disp", "match_conf", "is_wearer")


_PICK = _LABEL + """, sd AS (SELECT min(disp) AS lo, max(disp) AS hi, count(*) FILTER (WHERE is_wearer) AS nw, count(*) FILTER (WHERE NOT is_wearer) AS nb, median(disp) FILTER (WHERE is_wearer) AS mw, median(disp) FILTER (WHERE NOT is_wearer) AS mb FROM lab),
th AS (SELECT i, CASE WHEN i = 199 THEN hi ELSE lo + i * (hi - lo) / 199 END AS t FROM sd, range(200) g(i)),
sc AS (SELECT i, t, (SELECT count(*) FROM lab WHERE is_wearer AND disp >= t) + (SELECT count(*) FROM lab WHERE NOT is_wearer AND disp < t) AS ok FROM th),
bst AS (SELECT i, t, CAST(ok AS DOUBLE) / (nw + nb) AS acc FROM sc, sd ORDER BY ok DESC, i LIMIT 1)"""


@query(o.q(_PICK, "SELECT CAST(nw AS BIGINT) AS n_wearer, CAST(nb AS BIGINT) AS n_bystander, round(mw, 6) AS wearer_median, round(mb, 6) AS bystander_median, round(t, 6) AS threshold, round(acc, 6) AS accuracy, mw > mb AND acc >= 0.68 AS trusted, CASE WHEN NOT mw > mb THEN 'wearers have no larger median disparity' WHEN acc < 0.68 THEN 'accuracy too low' END AS reason FROM sd, bst"))
def pick_disparity_threshold(fx: Fixture) -> DataFrame:
    return _rounded(calibration.pick_disparity_threshold(calibration.label_disparity(fx.disparity, fx.tracked, fx.detections)))


@query()
def derive_config(fx: Fixture) -> DataFrame:
    tracked = fx.tracked.select("cid", "frame", "track_id", "track_ord", *_BOX, "confidence").persist()  # for three statistics
    sizes, lengths, static = calibration.track_stats(tracking.stable_tracks(tracked), fx.vio, CONFIG)
    picked = calibration.pick_disparity_threshold(calibration.label_disparity(fx.disparity, tracked, fx.detections))
    found = _rounded(calibration.derived(sizes, lengths, calibration.pool_width_stats(fx.detections, tracked), calibration.camera_motion_stats(fx.vio), static, picked))
    row = fx.spark.createDataFrame(found.collect(), found.schema)
    tracked.unpersist()
    return row


ORACLES["derive_config"] = o.q(
    _PICK + ", " + _GAPS.replace("sc AS", "gsc AS").replace("FROM sc", "FROM gsc") + f", cr AS (SELECT *, row_number() OVER (PARTITION BY cid, frame ORDER BY confidence DESC, det_id) AS confidence_rank FROM fx_detections), tb AS (SELECT r.cid, r.frame, r.track_id, min(c.confidence_rank) AS confidence_rank FROM ranked r JOIN multi m USING (cid, frame) JOIN cr c ON c.cid = r.cid AND c.frame = r.frame AND c.x1 = r.x1 AND c.y1 = r.y1 AND c.x2 = r.x2 AND c.y2 = r.y2 WHERE r.track_rank <= 2 GROUP BY 1, 2, 3), {o.RATE}, mv AS (SELECT t.displacement FROM mot t JOIN lastpose l USING (cid) JOIN rate r ON r.cid = t.cid AND r.idx = greatest(0, least(t.frame, l.last)) WHERE t.elapsed = 1 AND {o.MOVING})",
    f"""SELECT round((SELECT quantile_cont({o.area()}, 0.01) FROM mot) * 0.5, 6) AS min_area_px2, round((SELECT quantile_cont({o.area()}, 0.995) FROM mot) * 1.5, 6) AS max_area_px2,
    round(greatest(1.5, (SELECT quantile_cont({o.aspect()}, 0.99) FROM mot) * 1.1), 6) AS max_aspect_ratio, round((SELECT quantile_cont(displacement, 0.995) FROM mot WHERE elapsed = 1) * 1.2, 6) AS max_speed_px_per_frame,
    CAST(greatest(2, ceil((SELECT quantile_cont(CAST(gap AS DOUBLE), 0.9) FROM near))) AS BIGINT) AS max_dropout_frames, CAST(floor(greatest(2.0, (SELECT quantile_cont(CAST(confidence_rank AS DOUBLE), 0.95) FROM tb))) AS BIGINT) AS candidate_pool_width,
    round((SELECT quantile_cont(speed, 0.4) FROM rate), 6) AS camera_speed_moving_thresh, round((SELECT quantile_cont(ang_rate, 0.4) FROM rate), 6) AS camera_ang_moving_thresh_deg,
    round(greatest(1.0, (SELECT quantile_cont(displacement, 0.1) FROM mv)), 6) AS static_motion_px_threshold, (mw > mb AND acc >= 0.68) AS stereo_enabled, CASE WHEN mw > mb AND acc >= 0.68 THEN round(t, 6) END AS reach_disparity_threshold_px FROM sd, bst""",
)


@query()
def calibrate(fx: Fixture) -> DataFrame:
    """With the open gates of production, under which lanes compete for boxes: no SQL."""
    from trackmend.plans.calibrate import calibrate as run

    return _rounded(run(fx.detections, fx.frames, fx.vio, fx.disparity, CONFIG)[0])


def _over(sql: str, tracks: str) -> str:
    """A query over ``fx_tracked``, over ``tk`` instead."""
    head, tail = sql[: len(o.PREFIX)], sql[len(o.PREFIX) :]
    return f"{head}, {tracks} {tail.replace('fx_tracked', 'tk')}"


# the static threshold depends on the camera's percentiles
_AT = "(speed > (SELECT quantile_cont(speed, 0.4) FROM rate) OR ang_rate > (SELECT quantile_cont(ang_rate, 0.4) FROM rate))"
# all frames of many boxes say what the stereo signal is worth
_ALL_FRAMES = f"{o.MULTI}, st AS (SELECT cid, frame FROM multi)"
ORACLES["calibrate_of_lanes"] = _over(ORACLES["derive_config"].replace(o.MOVING, _AT).replace(_STRIDE, _ALL_FRAMES), o.LOOSE_TRACKS)


@query(ORACLES["calibrate_of_lanes"])
def calibrate_of_lanes(fx: Fixture) -> DataFrame:
    from trackmend.plans.calibrate import calibrate as run

    return _rounded(run(fx.detections, fx.frames, fx.vio, fx.disparity, CONFIG, loose=LOOSE)[0])


# validation

_REAL = o.STABLE + ", rl AS (SELECT DISTINCT cid, det_id FROM stable), sv AS (SELECT cid, det_id, det_id % 13 <> 0 AS geometric, det_id % 13 <> 0 AND det_id % 7 <> 0 AS temporal, det_id % 13 <> 0 AND det_id % 7 <> 0 AND det_id % 3 <> 0 AS cap FROM fx_detections)"


def _survivors(fx: Fixture) -> DataFrame:
    a, b, c = (F.col("det_id") % n != 0 for n in (13, 7, 3))
    return fx.detections.select("cid", "det_id", a.alias("geometric"), (a & b).alias("temporal"), (a & b & c).alias("cap"))


def _real(fx: Fixture) -> DataFrame:
    return validation.real_ids(tracking.stable_tracks(fx.tracked))


@query(o.q(_REAL, "SELECT s.cid, s.det_id, r.det_id IS NOT NULL AS is_real FROM sv s LEFT JOIN rl r ON r.cid = s.cid AND r.det_id = s.det_id"))
def real_id_membership(fx: Fixture) -> DataFrame:
    return validation.real_id_membership(_survivors(fx), _real(fx)).select("cid", "det_id", "is_real")


_PROXY = _REAL + ", al AS (SELECT s.*, r.det_id IS NOT NULL AS real FROM sv s LEFT JOIN rl r ON r.cid = s.cid AND r.det_id = s.det_id), px AS (" + " UNION ALL ".join(f"SELECT cid, '{n}' AS stage, CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE {c} AND real) AS BIGINT) AS t, count(*) FILTER (WHERE real) AS nr FROM al GROUP BY 1" for n, c in (("raw", "true"), ("geometric", "geometric"), ("temporal", "temporal"), ("cap", "cap"))) + "), pr2 AS (SELECT cid, stage, n AS n_survivors, CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / n END AS precision_proxy, CASE WHEN nr > 0 THEN CAST(t AS DOUBLE) / nr END AS recall_proxy FROM px)"


@query(o.q(_PROXY, "SELECT cid, stage, n_survivors, round(precision_proxy, 6) AS precision_proxy, round(recall_proxy, 6) AS recall_proxy FROM pr2"))
def proxy_precision_recall(fx: Fixture) -> DataFrame:
    return _rounded(validation.proxy_precision_recall(fx.detections, _survivors(fx), _real(fx)))


@query(o.q(_PROXY, "SELECT stage, round(avg(precision_proxy), 6) AS mean_precision_proxy, round(avg(recall_proxy), 6) AS mean_recall_proxy FROM pr2 GROUP BY 1"))
def stage_summary(fx: Fixture) -> DataFrame:
    return _rounded(validation.stage_summary(validation.proxy_precision_recall(fx.detections, _survivors(fx), _real(fx))))


@query(o.q(f"{o.CHAINED}, {o.SURVIVORS}", "SELECT cid, det_id, geometric, temporal, cap FROM sv"))
def stage_survivor_ids_rows(fx: Fixture) -> DataFrame:
    return stage_survivor_ids(staged(fx.detections, fx.frames, fx.vio, CHAIN))




def _cover(stable: str, out: str) -> str:
    """A CTE ``cov``: whether each frame of a stable track has an output box near its own."""
    near = f"{o.dist('s.', 'f.')} <= greatest({o.diag('s.')}, 1.0)"
    return f"cov AS (SELECT s.cid, s.frame, s.track_id, coalesce(bool_or({near}), false) AS covered, coalesce(bool_or({near} AND f.status <> 'interpolated'), false) AS covered_without FROM {stable} s LEFT JOIN (SELECT * FROM {out} WHERE status <> 'rejected') f ON f.cid = s.cid AND f.frame = s.frame GROUP BY 1, 2, 3)"


_LOOSE_STABLE = f"live1 {o.LOOSE_LIVE}, {o.lanes('live1', '1')}, stable AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cid, track_id) AS tn FROM tk1) t WHERE tn >= 30)"
_COVER = f"{o.CHAINED}, {_LOOSE_STABLE}, {_cover('stable', 'out')}"


def _coverage(fx: Fixture) -> DataFrame:
    """Stable loose tracks against what the whole correction puts out."""
    stable = tracking.stable_tracks(tracking.build_loose_tracks(fx.detections, fx.frames, CONFIG, LOOSE))
    # rejected rows cover nothing
    return validation.frame_coverage(stable, finish_accepted(staged(fx.detections, fx.frames, fx.vio, CHAIN), fx.clips, CHAIN))


@query(o.q(_COVER, "SELECT * FROM cov"))
def frame_coverage(fx: Fixture) -> DataFrame:
    return _coverage(fx)


@query(o.q(_COVER, "SELECT cid, CAST(count(*) AS BIGINT) AS n_stable_track_frames, round(avg(CAST(covered_without AS DOUBLE)), 6) AS recall_without, round(avg(CAST(covered AS DOUBLE)), 6) AS recall_with, round(avg(CAST(covered AS DOUBLE)) - avg(CAST(covered_without AS DOUBLE)), 6) AS recall_gain FROM cov GROUP BY 1"))
def frame_coverage_recall(fx: Fixture) -> DataFrame:
    return _rounded(validation.frame_coverage_recall(_coverage(fx)))


@query(o.q(f"{_FIN}, {o.MULTI}, oc AS (SELECT cid, frame, count(*) AS c FROM fin GROUP BY 1, 2), mr AS (SELECT m.cid, CAST(count(*) AS BIGINT) AS n_multibox, round(avg(CASE WHEN coalesce(c, 0) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS frac_resolved FROM multi m LEFT JOIN oc USING (cid, frame) GROUP BY 1)", "SELECT cl.cid, coalesce(n_multibox, 0) AS n_multibox, frac_resolved FROM fx_clips cl LEFT JOIN mr USING (cid)"))
def multibox_resolution(fx: Fixture) -> DataFrame:
    return _rounded(validation.multibox_resolution(fx.detections, _final(fx), fx.clips))


_IR = f"{_FIN}, ir AS (SELECT cl.cid, coalesce(avg(CASE WHEN status = 'interpolated' THEN 1.0 WHEN status IS NOT NULL THEN 0.0 END), 0.0) AS interpolation_rate FROM fx_clips cl LEFT JOIN fin USING (cid) GROUP BY 1)"


@query(o.q(_IR, "SELECT cid, round(interpolation_rate, 6) AS interpolation_rate FROM ir"))
def interpolation_rate(fx: Fixture) -> DataFrame:
    return _rounded(validation.interpolation_rate(_final(fx), fx.clips))


@query(o.q(_IR, "SELECT cid, round(interpolation_rate, 6) AS interpolation_rate, round(m, 6) AS mean_rate, round(s, 6) AS std_rate, interpolation_rate > m + 3 * s OR interpolation_rate > 0.30 AS flagged FROM ir, (SELECT avg(interpolation_rate) AS m, stddev_pop(interpolation_rate) AS s FROM ir) z"))
def flag_interpolation_outliers(fx: Fixture) -> DataFrame:
    return _rounded(validation.flag_interpolation_outliers(validation.interpolation_rate(_final(fx), fx.clips), 0.30))


@query(o.q(f"{o.MULTI}, nm AS (SELECT cid, CAST(count(*) AS BIGINT) AS n FROM multi GROUP BY 1)", "SELECT c.cid, frame_count AS n_frames, coalesce(n, 0) AS n_multibox, round(CASE WHEN frame_count > 0 THEN coalesce(n, 0) / CAST(frame_count AS DOUBLE) ELSE 0.0 END, 6) AS frac FROM fx_clips c LEFT JOIN nm USING (cid)"))
def devset_ranking(fx: Fixture) -> DataFrame:
    return _rounded(validation.devset_ranking(fx.detections, fx.clips))


def _every_trial(fx: Fixture, k: int) -> DataFrame:
    """A trial for each run that is long enough, as the SQL has it."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("cid", "track_id"))
    runs = gaps.contiguous_runs(fx.tracked.withColumn("_n", n).where("_n >= 20")).where(F.col("length") >= k + 10)
    return runs.select(F.lit(k).cast("long").alias("k"), "cid", "track_id", (F.col("start") + 5).alias("gap_start"), F.xxhash64("cid", "track_id", "start").alias("trial"))


@query(o.q(o.dropout_sql(2), "SELECT cid, track_id, n_recovered, round(mean_iou, 6) AS mean_iou, round(mean_center_dist_px, 6) AS mean_center_dist_px FROM per"))
def synthetic_dropout_eval(fx: Fixture) -> DataFrame:
    found = validation.synthetic_dropout_eval(fx.tracked, fx.clips, CONFIG, _every_trial(fx, 2))
    return _rounded(found.select("cid", "track_id", "n_recovered", "mean_iou", "mean_center_dist_px"))


@query(o.q(o.dropout_sql(2), "SELECT CAST(2 AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n_trials, round(CAST(sum(n_recovered) AS DOUBLE) / (2 * count(*)), 6) AS recovery_rate, round(avg(mean_iou), 6) AS mean_iou, round(avg(mean_center_dist_px), 6) AS mean_center_dist_px FROM per HAVING count(*) > 0"))
def synthetic_dropout_summary(fx: Fixture) -> DataFrame:
    return _rounded(validation.synthetic_dropout_summary(validation.synthetic_dropout_eval(fx.tracked, fx.clips, CONFIG, _every_trial(fx, 2))))


@query(o.q(o.dropout_report_sql([1, 2, 3], "fx_tracked", 15, CONFIG), "SELECT * FROM rep"))
def synthetic_dropout_sampled(fx: Fixture) -> DataFrame:
    trials = validation.dropout_trials(fx.tracked, [1, 2, 3], 15)
    return _rounded(validation.synthetic_dropout_summary(validation.synthetic_dropout_eval(fx.tracked, fx.clips, CONFIG, trials)))


_REAL_LANES = f"live1 {o.LOOSE_LIVE}, {o.lanes('live1', '1')}"
_VALID = f"{o.CHAINED}, {o.SURVIVORS}, {_REAL_LANES}, rl AS (SELECT DISTINCT cid, unnest(source_ids) AS det_id FROM (SELECT *, count(*) OVER (PARTITION BY cid, track_id) AS n30 FROM tk1) t WHERE n30 >= 30), " + _PROXY[_PROXY.index("al AS") :]


@query(o.q(_VALID, "SELECT stage, round(avg(precision_proxy), 6) AS mean_precision_proxy, round(avg(recall_proxy), 6) AS mean_recall_proxy FROM pr2 GROUP BY 1"))
def validate_corpus_of_lanes(fx: Fixture) -> DataFrame:
    from trackmend.plans.validate import validate_corpus as run

    return _rounded(run(fx.detections, fx.frames, fx.vio, fx.clips, CHAIN, loose=LOOSE, only="stage_summary")["stage_summary"])


@query(o.q(f"{o.CHAINED}, dc AS (SELECT cid, status, CAST(count(*) AS BIGINT) AS n FROM out GROUP BY 1, 2)", "SELECT * FROM dc"))
def write_reports(fx: Fixture) -> DataFrame:
    """The reports of a validation, written; one of them read back."""
    from trackmend.plans.validate import validate_corpus as run

    path, scratch = _folder(fx.spark, "reports"), _folder(fx.spark, "validation")
    with staging.tidied(fx.spark):
        sinks.write_reports(run(fx.detections, fx.frames, fx.vio, fx.clips, CHAIN, loose=LOOSE, scratch=scratch), path)
    staging.drop(fx.spark, scratch)
    return fx.spark.read.schema("cid long, status string, n long").json(f"{path}/status_counts")


#: Over ``steady``: the correction, the tracks that stand for the truth (all boxes, as none is rejected before tracking), and
#: each report of a validation.
_STEADY = f"{o.chained('fx_steady', STEADY)}, stable AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cid, track_id) AS tn FROM tk) t WHERE tn >= 30)"
_HIDDEN, _PER_LENGTH = [2, 3, 5, 10, 13], 400


def _steady_report(fx: Fixture, name: str) -> DataFrame:
    from trackmend.plans.validate import validate_corpus as run

    loose = STEADY.loose().but(max_speed_px_per_frame=STEADY.max_speed_px_per_frame, resume_gate_px=STEADY.resume_gate_px, max_dropout_frames=STEADY.max_dropout_frames)
    return run(fx.steady, fx.frames, fx.vio, fx.clips, STEADY, loose=loose, hidden=tuple(_HIDDEN), per_length=_PER_LENGTH, only=name)[name]


@query(o.q(f"{_STEADY}, {o.dropout_report_sql(_HIDDEN, 'kept', _PER_LENGTH, STEADY)}", "SELECT * FROM rep"))
def validate_dropout_report(fx: Fixture) -> DataFrame:
    """Dropouts hidden in the tracks that the correction selects, drawn as in production."""
    return _rounded(_steady_report(fx, "synthetic_dropout"))


@query(o.q(f"{_STEADY}, {_cover('stable', 'out')}", "SELECT cid, CAST(count(*) AS BIGINT) AS n_stable_track_frames, round(avg(CAST(covered_without AS DOUBLE)), 6) AS recall_without, round(avg(CAST(covered AS DOUBLE)), 6) AS recall_with, round(avg(CAST(covered AS DOUBLE)) - avg(CAST(covered_without AS DOUBLE)), 6) AS recall_gain FROM cov GROUP BY 1"))
def validate_coverage_report(fx: Fixture) -> DataFrame:
    return _rounded(_steady_report(fx, "frame_coverage_recall"))


@query(o.q(f"{_STEADY}, multi AS (SELECT cid, frame FROM fx_steady GROUP BY 1, 2 HAVING count(*) >= 3), oc AS (SELECT cid, frame, count(*) AS c FROM out WHERE status <> 'rejected' GROUP BY 1, 2), mr AS (SELECT m.cid, CAST(count(*) AS BIGINT) AS n_multibox, round(avg(CASE WHEN coalesce(c, 0) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS frac_resolved FROM multi m LEFT JOIN oc USING (cid, frame) GROUP BY 1)", "SELECT cl.cid, coalesce(n_multibox, 0) AS n_multibox, frac_resolved FROM fx_clips cl LEFT JOIN mr USING (cid)"))
def validate_multibox_report(fx: Fixture) -> DataFrame:
    return _rounded(_steady_report(fx, "multibox_resolution"))


@query(o.q(f"{_STEADY}, ir AS (SELECT cl.cid, coalesce(avg(CASE WHEN status = 'interpolated' THEN 1.0 WHEN status IS NOT NULL THEN 0.0 END), 0.0) AS interpolation_rate FROM fx_clips cl LEFT JOIN out USING (cid) GROUP BY 1)", "SELECT cid, round(interpolation_rate, 6) AS interpolation_rate, round(m, 6) AS mean_rate, round(s, 6) AS std_rate, interpolation_rate > m + 3 * s OR interpolation_rate > 0.20 AS flagged FROM ir, (SELECT avg(interpolation_rate) AS m, stddev_pop(interpolation_rate) AS s FROM ir) z"))
def validate_interpolation_report(fx: Fixture) -> DataFrame:
    """With the default share of 0.20."""
    return _rounded(_steady_report(fx, "interpolation_rate"))


@query()
def validate_corpus(fx: Fixture) -> DataFrame:
    """All reports, with the open gates of production, under which lanes compete for boxes: no SQL."""
    from trackmend.plans.validate import in_one_table
    from trackmend.plans.validate import validate_corpus as run

    path, scratch = _folder(fx.spark, "reports"), _folder(fx.spark, "validation")
    reports = run(fx.detections, fx.frames, fx.vio, fx.clips, CONFIG, scratch=scratch)
    written = {name: staging.stored(rows, f"{path}/{name}") for name, rows in reports.items()}
    staging.drop(fx.spark, scratch)
    return _rounded(in_one_table(written))


# sources and sinks: the derived tables written as bundles and read back


def _bundles(fx: Fixture, *kinds: str) -> str:
    """A folder with the bundles of these kinds: ``boxes``, ``vio``, ``ts``, ``meta``."""
    root = _folder(fx.spark, "bundles")

    def write(kind: str, docs: DataFrame) -> None:
        # the folder is new, so tasks may put their files in place by themselves: a move of each by the driver takes longer
        docs.repartition("cid").write.partitionBy("cid").option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(f"{root}/{kind}")

    if "boxes" in kinds:
        boxed = F.struct(F.array(*_BOX).alias("xyxy"), F.lit(0).alias("class"), F.lit("left").alias("handedness"), "confidence")
        # a frame without boxes is one row without a box
        rows = fx.frames.withColumn("frame_only", F.lit(True)).unionByName(fx.detections.select("cid", "frame", "det_id", boxed.alias("b")), allowMissingColumns=True)
        # dealt by clip once, for frames and documents
        by_frame = rows.repartition("cid").groupBy("cid", "frame").agg(F.count("frame_only").alias("n"), F.sort_array(F.collect_list(F.when(F.col("det_id").isNotNull(), F.struct("det_id", "b")))).alias("d"))
        each = F.struct("frame", F.transform("d", lambda r: r["b"]).alias("detections"))
        write("boxes", by_frame.where("n > 0").groupBy("cid").agg(F.count(F.lit(1)).alias("video_frame_count"), F.sort_array(F.collect_list(each)).alias("frames")))
    if "vio" in kinds:
        order = F.sort_array(F.collect_list(F.struct("idx", "speed", "yaw", "pitch", "roll")))
        write("vio", fx.vio.groupBy("cid").agg(order.alias("p")).select("cid", F.expr("transform(p, x -> double(x.idx) / 30)").alias("t"), *[F.col(f"p.{c}").alias(c) for c in ("speed", "yaw", "pitch", "roll")]))
    if "ts" in kinds:
        stamps = F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), F.col("frame") * 33_000_000)))
        write("ts", fx.frames.groupBy("cid").agg(stamps.alias("frame_ts")))
    if "meta" in kinds:
        write("meta", fx.clips.where("cid % 3 <> 1").select("cid", F.col("width").cast("long").alias("width"), F.when(F.col("cid") % 3 == 0, F.col("height").cast("long")).alias("height")))
    return root


@query(o.q("", f"SELECT CAST(cid AS VARCHAR) AS cid, frame, det_id, {o.BOX6}, 0 AS cls, 'left' AS handedness, round(confidence, 6) AS confidence FROM fx_detections"))
def read_detections(fx: Fixture) -> DataFrame:
    return bundles.read_detections(fx.spark, f"{_bundles(fx, 'boxes')}/boxes", "*.json").select("cid", "frame", "det_id", *[r6(c) for c in _BOX], "cls", "handedness", r6("confidence"))


@query(o.q("", "SELECT cid, det_id FROM fx_detections"))
def assign_det_ids(fx: Fixture) -> DataFrame:
    """From flat rows in no order, numbered by their places in the document."""
    flat = fx.detections.select("cid", F.col("frame").alias("frame_pos"), F.col("det_id").alias("det_pos"))
    return bundles.assign_det_ids(flat).select("cid", "det_id")


@query(o.q("", "SELECT CAST(cid AS VARCHAR) AS cid, frame FROM fx_frames"))
def read_frames(fx: Fixture) -> DataFrame:
    return bundles.read_frames(fx.spark, f"{_bundles(fx, 'boxes')}/boxes", "*.json")


@query(o.q("", "SELECT CAST(cid AS VARCHAR) AS cid, CAST(row_number() OVER (PARTITION BY cid ORDER BY idx) - 1 AS BIGINT) AS idx, round(speed, 6) AS speed, yaw, pitch, roll FROM fx_vio"))
def read_vio(fx: Fixture) -> DataFrame:
    return bundles.read_vio(fx.spark, f"{_bundles(fx, 'vio')}/vio", "*.json").withColumn("speed", F.round("speed", 6))


@query(o.q("", "SELECT CAST(cid AS VARCHAR) AS cid, frame, frame * 33000000 AS ts_ns FROM fx_frames"))
def read_frame_ts(fx: Fixture) -> DataFrame:
    return bundles.read_frame_ts(fx.spark, f"{_bundles(fx, 'ts')}/ts", "*.json")


@query(o.q("", "SELECT CAST(cid AS VARCHAR) AS cid, frame_count, CASE WHEN cid % 3 = 1 THEN 1920.0 ELSE CAST(width AS DOUBLE) END AS width, CASE WHEN cid % 3 = 0 THEN CAST(height AS DOUBLE) ELSE 1200.0 END AS height FROM fx_clips"))
def read_clips(fx: Fixture) -> DataFrame:
    root = _bundles(fx, "boxes", "meta")
    return bundles.read_clips(fx.spark, f"{root}/boxes", "*.json", f"{root}/meta", "*.json")


@query(o.q(_FIN, f"SELECT cid, frame, status, track_id, {o.BOX6} FROM fin"))
def write_corrected(fx: Fixture) -> DataFrame:
    path = _folder(fx.spark, "corrected")
    sinks.write_corrected(_final(fx), path, "json")
    schema = "frame long, x1 double, y1 double, x2 double, y2 double, status string, confidence double, track_id long, reject_stage string, source_ids array<bigint>, cid long"
    return fx.spark.read.schema(schema).json(path).select("cid", "frame", "status", "track_id", *[r6(c) for c in _BOX])


_FIRST = "(SELECT min(cid) FROM fx_clips)"


def _first_clip(fx: Fixture) -> int:
    return fx.clips.agg(F.min("cid")).first()[0]


@query(o.q("", f"SELECT CAST(cid AS VARCHAR) AS cid, frame, det_id, {o.BOX6} FROM fx_detections WHERE cid = {_FIRST}"))
def read_one_clip(fx: Fixture) -> DataFrame:
    """One clip by its name: no other folder is opened."""
    rows = bundles.read_detections(fx.spark, f"{_bundles(fx, 'boxes')}/boxes", "*.json", clips=[str(_first_clip(fx))])
    return rows.select("cid", "frame", "det_id", *[r6(c) for c in _BOX])


@query(o.q(_FIN, f"SELECT cid, frame, status, track_id, {o.BOX6} FROM fin WHERE cid <> {_FIRST} OR status <> 'interpolated'"))
def replace_corrected(fx: Fixture) -> DataFrame:
    """All clips are written, and then the first one again, without what was filled in."""
    path, out = _folder(fx.spark, "corrected"), _final(fx)
    sinks.write_corrected(out, path, "json")
    sinks.replace_corrected(out.where((F.col("cid") == _first_clip(fx)) & (F.col("status") != "interpolated")), path)
    schema = "frame long, x1 double, y1 double, x2 double, y2 double, status string, confidence double, track_id long, reject_stage string, source_ids array<bigint>, cid long"
    return fx.spark.read.schema(schema).json(path).select("cid", "frame", "status", "track_id", *[r6(c) for c in _BOX])


@query(ORACLES["run_summary"])
def replace_run_summary(fx: Fixture) -> DataFrame:
    """The summary of all clips, of which the first one's row is written again."""
    path, staging = _folder(fx.spark, "summary"), _folder(fx.spark, "staging")
    out = correct_detections(fx.detections, fx.frames, fx.vio, fx.clips, CHAIN).persist()  # for two writes
    first = F.col("cid") == _first_clip(fx)
    # as if the first clip had been lost
    sinks.write_run_summary(fx.detections.where(~first), out.where(~first), path)
    sinks.replace_run_summary(fx.detections.where(first), out.where(first), path, staging)
    schema = sinks.run_summary(fx.detections, out).schema
    out.unpersist()
    return fx.spark.read.schema(schema).json(path)


# stereo


def _page_disparity(pages: DataFrame, width: int = 80, at: tuple[float, ...] = (20.0,)) -> DataFrame:
    """Whole pages as textures, ``width`` bytes a row, with boxes of 40 columns from ``at``: the right image is the left one shifted by a known number of columns.

    The box covers the middle two thirds of the rows.  Bytes after the last full row aren't part of the image.
    """
    shift = (F.col("cid") % 9).cast("int")
    images = pages.withColumn("h", F.floor(F.length("b") / width).cast("int"))
    rows = F.when(F.col("h") > 0, F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda r: F.substring(F.col("b"), r * width + 1, F.lit(width)))).otherwise(F.array().cast("array<binary>"))
    moved = F.transform(rows, lambda r: F.concat(F.substring(r, shift + 1, F.lit(width) - shift), F.substring(r, F.lit(1), shift)))
    pixels = images.select("cid", F.lit(0).cast("long").alias("frame"), F.lit(width).alias("w"), "h", F.substring(F.col("b"), F.lit(1), F.col("h") * width).alias("left"), F.aggregate(moved, F.lit(b""), lambda a, x: F.concat(a, x)).alias("right"))
    edge = F.floor(F.col("h") / 6)
    boxes = images.select("cid", F.lit(0).cast("long").alias("frame"), F.explode(F.array(*[F.lit(x) for x in at])).alias("x1"), edge.cast("double").alias("y1"), F.lit(0.0).alias("x2"), (F.col("h") - edge).cast("double").alias("y2"))
    return stereo.box_disparity(boxes.withColumn("x2", F.col("x1") + 40), pixels)


def _pages(fx: Fixture) -> DataFrame:
    return fx.spark.read.parquet(f"{fx.dir}/pages.parquet").select(F.col("page_id").alias("cid"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("b"))


@query(f"WITH {o.disparity_sql(80, (20,))} SELECT cid, CAST(0 AS BIGINT) AS frame, disp FROM dsp")
def box_disparity(fx: Fixture) -> DataFrame:
    """Every page; a box lower than 8 pixels, or almost flat, has no disparity; of equal places the topmost, then leftmost counts."""
    return _page_disparity(_pages(fx)).select("cid", "frame", "disp")


@query(f"WITH {o.disparity_sql(160, (20, 70))} SELECT cid, CAST(0 AS BIGINT) AS frame, x1, disp, round(match_conf, 6) AS match_conf FROM dsp")
def box_disparity_all_pages(fx: Fixture) -> DataFrame:
    """Every page in rows of 160 bytes, with two boxes each and their scores."""
    return _page_disparity(_pages(fx), 160, (20.0, 70.0)).select("cid", "frame", "x1", "disp", r6("match_conf"))
