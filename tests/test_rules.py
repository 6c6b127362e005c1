"""Edge cases by hand."""

import itertools
import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmend.config import Config, hands, load_config, save_config
from trackmend.functions import geometry as g
from trackmend.operators import audit, calibration, camera, gaps, merge, rejects, stereo, temporal, tracking
from trackmend.plans import registry
from trackmend.plans.correct import correct_detections
from trackmend.plans.fixtures import CONFIG, LANES, Fixture
from trackmend.sources import bundles, sinks
from trackmend.streaming.associate import associate_stream

SF = "/root/testdata/sf0.001"
DET = "cid long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double"
TRK = DET.replace("det_id", "track_id") + ", track_ord long, was_merged boolean, source_ids array<bigint>"


def boxes(spark, rows):
    return spark.createDataFrame([(1, f, i, float(a), float(b), float(c), float(d), conf) for i, (f, a, b, c, d, conf) in enumerate(rows)], DET)


def track(spark, at, tid=0, cid=1):
    """A track of 100-pixel boxes with centres (x, 500) at given frames."""
    return spark.createDataFrame([(cid, f, tid, x - 50.0, 450.0, x + 50.0, 550.0, 0.9, tid, False, [f]) for f, x in at], TRK)


def stages(df):
    return {r.frame: r.reject_stage for r in df.collect()}


def test_transitive_duplicates_are_one_group(spark):
    rows = merge.merge_duplicates(boxes(spark, [(0, 0, 0, 100, 100, 0.5), (0, 30, 0, 130, 100, 0.9), (0, 60, 0, 160, 100, 0.9), (0, 500, 0, 600, 100, 0.1)]), Config()).orderBy("cand_idx").collect()
    assert [(r.source_ids, r.was_merged, r.x1) for r in rows] == [([0, 1, 2], True, 30.0), ([3], False, 500.0)]  # equal confidence: the lower id


@pytest.mark.parametrize(("n", "batch"), [(60, 10_000), (400, 7), (3, 2)])
def test_groups_are_those_of_all_pairs(spark, n, batch):
    """Wide and narrow frames, several in a batch and several batches in a frame, flat and turned boxes among them."""
    rng = random.Random(n)
    rows = []
    for f in range(5):
        for _ in range(rng.randint(1, n)):
            x, y = rng.randint(0, 400), rng.randint(0, 400)
            rows.append((f, x, y, x + rng.choice([60, 60, 0, -5, 90]), y + rng.choice([60, 60, 0]), rng.choice([0.5, 0.25])))
    df = boxes(spark, rows)
    want = set()
    area = lambda b: max(0, b[3] - b[1]) * max(0, b[4] - b[2])
    for f in range(5):
        ids = [i for i, r in enumerate(rows) if r[0] == f]
        root = {i: i for i in ids}
        for i, j in itertools.combinations(ids, 2):
            a, b = rows[i], rows[j]
            common = max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
            if common > 0 and min(area(a), area(b)) > 0 and common / min(area(a), area(b)) >= Config().duplicate_overlap_threshold:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
        for number, first in enumerate(sorted(set(root.values()))):
            members = [i for i in ids if root[i] == first]
            best = min(members, key=lambda i: (-rows[i][5], i))
            want.add((f, number, float(rows[best][1]), rows[best][5], tuple(members), len(members) > 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.frame, r.cand_idx, r.x1, r.confidence, tuple(r.source_ids), r.was_merged) for r in merge.merge_duplicates(df, Config()).collect()}
        firsts = {(r.det_id, r.first) for r in merge.duplicate_components(df, Config()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and firsts == {(i, w[4][0]) for w in want for i in w[4]}


@pytest.mark.parametrize("seed", range(40))
def test_parts_of_a_cost_matrix_are_solved_by_themselves(seed):
    rng = np.random.default_rng(seed)
    cost = rng.uniform(-5, 50, (int(rng.integers(1, 6)), int(rng.integers(1, 6))))
    cost[rng.random(cost.shape) < rng.choice([0.3, 0.6, 0.8])] = tracking.IMPOSSIBLE
    total = lambda pairs: (-len(pairs), sum(cost[i, j] for i, j in pairs))
    small = cost if cost.shape[0] <= cost.shape[1] else cost.T
    best = min((tuple((i, j) for i, j in enumerate(p) if small[i, j] < tracking.IMPOSSIBLE) for p in itertools.permutations(range(small.shape[1]), small.shape[0])), key=lambda q: (-len(q), sum(small[i, j] for i, j in q)))
    found = tracking.matched(cost)
    assert total(found) == pytest.approx((-len(best), sum(small[i, j] for i, j in best)))
    assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)


def test_thresholds_are_strict(spark):
    c = Config(min_area_px2=100, max_area_px2=400, max_aspect_ratio=4.0)
    df = boxes(spark, [(0, 0, 0, 10, 10, 0.5), (1, 0, 0, 20, 20, 0.5), (2, 0, 0, 40, 10, 0.5), (3, 0, 0, 9, 11, 0.5), (4, 0, 0, 41, 9.7, 0.5), (5, 10, 0, 0, 10, 0.5)])
    assert stages(rejects.geometric_reject(df, c)) == {0: None, 1: None, 2: None, 3: "size", 4: "shape", 5: "size"}


def test_non_finite_boxes_are_set_apart(spark):
    df = boxes(spark, [(0, 0, 0, math.nan, 10, 0.5), (0, 0, 0, math.inf, 10, 0.5), (0, 0, 0, 10, 10, 0.5)])
    rows = rejects.geometric_reject(df, Config(min_area_px2=1)).collect()
    assert sorted((r.source_ids, r.cand_idx, r.reject_stage) for r in rows if r.cand_idx is None) == [([0], None, "not_finite"), ([1], None, "not_finite")]
    assert [(r.source_ids, r.cand_idx, r.reject_stage) for r in rows if r.cand_idx is not None] == [([2], 0, None)]


def test_boxes_that_are_no_numbers_reach_no_track_and_no_hang(spark):
    nan = math.nan
    assert len(tracking.assign(np.array([[nan, 1.0], [nan, nan]]))) == 2
    linker = tracking.Linker(CONFIG)
    assert linker.step(0, np.array([[nan, 0, 10, 10], [0, 0, 10, 10]])) == [0, 1]
    assert linker.step(1, np.array([[0, 0, 10, 10], [nan, 0, math.inf, 10]])) == [1, 2]
    df = boxes(spark, [(f, nan if f % 3 == 0 else 5.0 * f, 0, 5.0 * f + 100, 100, 0.5) for f in range(9)])
    frames = df.select("cid", "frame").distinct()
    loose = tracking.build_loose_tracks(df, frames, CONFIG).collect()
    assert {r.frame for r in loose} == {1, 2, 4, 5, 7, 8}
    clips, vio = spark.createDataFrame([(1, 9, 1850.0, 1000.0)], "cid long, frame_count long, width double, height double"), spark.createDataFrame([(1, i, 0.0, 0.0, 0.0, 0.0) for i in range(9)], "cid long, idx long, speed double, yaw double, pitch double, roll double")
    out = correct_detections(df, frames, vio, clips, CONFIG).collect()
    assert sorted(r.source_ids[0] for r in out if r.reject_stage == "not_finite") == [0, 3, 6]
    assert sorted(i for r in out for i in r.source_ids) == list(range(9))


def test_loose_tracks_have_no_boxes_without_a_side(spark):
    df = boxes(spark, [(0, 0, 0, 100, 100, 0.5), (0, 300, 0, 300, 100, 0.5), (0, 500, 90, 600, 50, 0.5)])
    assert [r.x1 for r in tracking.build_loose_tracks(df, df.select("cid", "frame").distinct(), CONFIG).collect()] == [0.0]


def test_frames_go_on_over_batches(spark):
    """The tracker's rows come in batches that end within frames and clips."""
    rng = random.Random(4)
    rows = [(c, f, k, 300.0 * k + rng.uniform(-9, 9), 0.0, 300.0 * k + 100, 100.0, 0.5) for c in range(3) for f in range(40) for k in range(3) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "cid long, frame long, cand_idx long, x1 double, y1 double, x2 double, y2 double, confidence double")
    frames = df.select("cid", "frame").distinct()
    want = sorted(map(tuple, tracking.associate(df, frames, CONFIG).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert sorted(map(tuple, tracking.associate(df, frames, CONFIG).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


LIVE = "cid long, frame long, cand_idx long, x1 double, y1 double, x2 double, y2 double, confidence double, at timestamp"


def streamed(spark, tmp_path, rows, **how):
    """Gives rows to the stream, runs it to the end, and reads all that it has put out so far."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, LIVE).repartition(3).write.mode("append").parquet(source)
    live = spark.readStream.schema(LIVE).parquet(source)
    if "time" in how:
        live = live.withWatermark("at", "0 seconds")
    associate_stream(live, CONFIG, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.cid, r.frame, r.cand_idx, r.track_id, r.late) for r in spark.read.parquet(out).collect())


def seen(cid, frame, x, at):
    return (cid, frame, 0, x, 0.0, x + 100, 100.0, 0.5, dt.datetime.fromtimestamp(at))


def test_numbers_outlive_an_idle_clip(spark, tmp_path):
    """A timer ends clip 1; what it sends afterwards is a new track under a new number, and isn't late."""
    idle = {"time": "at", "idle": 60.0}
    assert streamed(spark, tmp_path, [seen(1, 10, 0.0, 1000), seen(1, 11, 5.0, 1001)], **idle) == [(1, 10, 0, 0, False), (1, 11, 0, 0, False)]
    streamed(spark, tmp_path, [seen(2, 0, 0.0, 9000)], **idle)
    streamed(spark, tmp_path, [seen(2, 1, 0.0, 9001)], **idle)
    rows = streamed(spark, tmp_path, [seen(1, 3, 0.0, 9002), seen(1, 4, 900.0, 9002)], **idle)
    assert [r for r in rows if r[0] == 1] == [(1, 3, 0, 1, False), (1, 4, 0, 2, False), (1, 10, 0, 0, False), (1, 11, 0, 0, False)]


def test_a_live_clip_goes_on_over_micro_batches(spark, tmp_path):
    """Its tracks, and the last frame, are remembered; frames before that are late."""
    idle = {"time": "at", "idle": 60.0}
    streamed(spark, tmp_path, [seen(1, 10, 0.0, 1000)], **idle)
    streamed(spark, tmp_path, [seen(1, 12, 5.0, 1030)], **idle)
    rows = streamed(spark, tmp_path, [seen(1, 11, 5.0, 1031), seen(1, 13, 8.0, 1050)], **idle)
    assert rows == [(1, 10, 0, 0, False), (1, 11, 0, None, True), (1, 12, 0, 0, False), (1, 13, 0, 0, False)]


@pytest.mark.parametrize("held", [100_000, 7])
def test_rows_in_any_order_are_stepped_frame_by_frame(spark, tmp_path, held):
    """In memory, or through the map in the state store: the numbers are those of the batch operator."""
    rng = random.Random(8)
    rows = [(c, f, k, 300.0 * k + rng.uniform(-40, 40), 0.0, 300.0 * k + 100, 100.0, 0.5, dt.datetime.fromtimestamp(f)) for c in range(2) for f in range(60) for k in range(3) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, LIVE)
    want = sorted((r.cid, r.frame, r.cand_idx, r.track_id, False) for r in tracking.associate(df, df.select("cid", "frame").distinct(), CONFIG).collect())
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        assert streamed(spark, tmp_path, rows, held=held) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_long_track_is_folded_in_one_pass(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("cid"), F.col("id").alias("frame"), F.lit(0).cast("long").alias("track_id"), F.when(F.col("id") % 10 == 5, 5000.0).otherwise(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.when(F.col("id") % 10 == 5, 5100.0).otherwise(100.0).alias("x2"), F.lit(100.0).alias("y2"))
    assert temporal.reject_displacement(rows, CONFIG).where("reject_stage = 'displacement'").count() == n // 10


def test_calibration_on_some_clips(spark):
    from trackmend.plans.calibrate import report

    fx = Fixture(spark, SF)
    reports, config = report(fx.detections, fx.frames, fx.vio, fx.disparity, CONFIG, dev_clips=fx.clips.limit(0), loose=registry.LOOSE)
    assert set(reports) == {"sizes", "gaps", "pool", "camera", "static", "disparity", "derived"} and all(r.count() == 1 for r in reports.values())
    assert reports["disparity"].first().reason == "insufficient samples" and config.reach_disparity_threshold_px is None


def test_displacement_compares_with_the_last_box_that_stayed(spark):
    df = track(spark, [(0, 100), (1, 400), (2, 405), (3, 102)])
    assert stages(temporal.reject_displacement(df, Config(max_speed_px_per_frame=100))) == {0: None, 1: "displacement", 2: "displacement", 3: None}


def test_what_is_left_of_a_track_may_be_too_short(spark):
    df = track(spark, [(0, 100), (1, 500), (2, 102)])
    rows = temporal.reject_unsupported(temporal.reject_displacement(df, Config(max_speed_px_per_frame=100)), Config())
    assert stages(rows) == {0: "unsupported", 1: "displacement", 2: "unsupported"}


def test_angles_wrap_and_late_frames_take_the_last_pose(spark):
    vio = spark.createDataFrame([(1, 0, 0.0, 179.0, 0.0, 0.0), (1, 1, 0.5, -179.0, 0.0, 0.0)], "cid long, idx long, speed double, yaw double, pitch double, roll double")
    assert [r.ang_rate for r in camera.vio_angular_rate(vio).orderBy("idx").collect()] == [0.0, 2.0]
    at = camera.vio_at_frame(spark.createDataFrame([(1, 7), (2, 0)], "cid long, frame long"), vio, Config()).orderBy("cid").collect()
    assert [(r.speed, r.camera_moving) for r in at] == [(0.5, True), (None, False)]


def test_gaps_are_filled_up_to_the_limit(spark):
    clips = spark.createDataFrame([(1, 1920.0, 1200.0)], "cid long, width double, height double")
    c = Config(max_dropout_frames=2)
    df = track(spark, [(0, 900), (1, 910), (4, 940), (8, 980)])  # gaps of 2 and 3
    out = gaps.interpolate_tracks(df, clips, c).orderBy("frame").collect()
    assert [(r.frame, r.status, r.track_id) for r in out] == [(0, "reported", 0), (1, "reported", 0), (2, "interpolated", 0), (3, "interpolated", 0), (4, "reported", 0), (8, "reported", 1)]
    assert out[2].x1 == 870.0 and out[2].confidence is None and out[2].source_ids == []


def test_a_first_box_at_the_border_is_not_leaving(spark):
    clips = spark.createDataFrame([(1, 1920.0, 1200.0)], "cid long, width double, height double")
    first = gaps.classify_gaps(track(spark, [(0, 60), (2, 62)]), clips, Config()).orderBy("frame").first()
    assert first.leaving is False and first.can_fill is True
    moving = gaps.classify_gaps(track(spark, [(0, 90), (1, 70), (3, 60)]), clips, Config()).orderBy("frame").collect()[1]
    assert moving.leaving is True and moving.can_fill is False


@pytest.mark.parametrize("seed", range(30))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    cost = rng.uniform(-50, 100, (n, m))
    cost[rng.random((n, m)) < 0.3] = tracking.IMPOSSIBLE
    small, wide = (cost, False) if n <= m else (cost.T, True)
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    pairs = tracking.assign(cost)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)
    assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_islands_change_nothing(spark):
    fx = Fixture(spark, SF)
    candidates = merge.merge_duplicates(fx.detections.where("frame % 40 < 12"), CONFIG).persist()
    split, whole = (sorted(map(tuple, tracking.associate(candidates, fx.frames, CONFIG, s).select("cid", "frame", "cand_idx", "track_id", "track_ord").collect())) for s in (True, False))
    assert split == whole and len(split) > 100


def linked_by_hand(rows, c):
    """Track numbers of (frame, cand_idx, box) rows of a clip, by trying every set of pairs of tracks and boxes."""
    tracks, numbers = [], {}  # a track: its (frame, box) so far
    middle = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    size = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    for frame, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        seen = [(idx, box) for _, idx, box in group]
        sets = {frozenset(): (0, 0.0, {})}  # boxes taken: pairs (negative), cost, track of each box
        for k, t in enumerate(tracks):
            (last, box), elapsed = t[-1], frame - t[-1][0]
            if elapsed > c.give_up_frames:
                continue
            x, y = middle(box)
            if len(t) > 1:
                (before, (bx, by)) = t[-2][0], middle(t[-2][1])
                x, y = x + (x - bx) / (last - before) * elapsed, y + (y - by) / (last - before) * elapsed
            gate, grown = c.resume_gate_px + c.max_speed_px_per_frame * elapsed, dict(sets)
            for j, (_, b) in enumerate(seen):
                away = math.dist(middle(b), (x, y))
                if away > gate:
                    continue
                common = max(0.0, min(b[2], box[2]) - max(b[0], box[0])) * max(0.0, min(b[3], box[3]) - max(b[1], box[1]))
                cost = away - (c.association_iou_weight * common / (size(b) + size(box) - common) * gate if elapsed <= 2 and common else 0.0)
                for taken, (n, total, of) in sets.items():
                    if j not in taken and (n - 1, total + cost) < grown.get(taken | {j}, (1,))[:2]:
                        grown[taken | {j}] = (n - 1, total + cost, of | {j: k})
            sets = grown
        of = min(sets.values(), key=lambda v: v[:2])[2]
        for j, (idx, b) in enumerate(seen):
            if j not in of:
                of[j] = len(tracks)
                tracks.append([])
            tracks[of[j]].append((frame, b))
            numbers[frame, idx] = of[j]
    return numbers


@pytest.mark.parametrize("speed", [0.0, 100.0])
def test_tracks_of_all_kinds_against_every_pairing(spark, monkeypatch, speed):
    fx = Fixture(spark, SF)
    config = LANES.but(max_speed_px_per_frame=speed)
    monkeypatch.setattr(registry, "LANES", config)
    detections = fx.detections.where("cid = 1").persist()
    assert {r.kind for r in detections.where("kind < 3").select("kind").distinct().collect()} == {0, 1, 2}
    candidates = merge.merge_duplicates(detections, config).persist()
    want = linked_by_hand([(r.frame, r.cand_idx, (r.x1, r.y1, r.x2, r.y2)) for r in candidates.collect()], config)
    batch = {(r.frame, r.cand_idx): r.track_id for r in tracking.associate(candidates, fx.frames, config).collect()}
    stream = {(r.frame, r.cand_idx): r.track_id for r in registry._streamed(fx, candidates, config).collect()}
    assert batch == want and stream == want


@pytest.fixture(scope="module")
def by_hand(spark):
    """The loose tracks of all clips under the open gates of production, linked by hand: (cid, track) -> its candidates."""
    fx, config = Fixture(spark, SF), CONFIG.loose()
    candidates = merge.merge_duplicates(fx.detections, config).collect()
    tracks = {}
    for cid in {r.cid for r in candidates}:
        rows = {(r.frame, r.cand_idx): r for r in candidates if r.cid == cid}
        numbers = linked_by_hand([(f, i, (r.x1, r.y1, r.x2, r.y2)) for (f, i), r in rows.items()], config)
        for place, number in numbers.items():
            tracks.setdefault((cid, number), []).append(rows[place])
    return {k: sorted(t, key=lambda r: r.frame) for k, t in tracks.items()}


def test_loose_tracks_under_open_gates(spark, by_hand):
    fx = Fixture(spark, SF)
    got = {(r.cid, r.frame, r.cand_idx): r.track_id for r in tracking.build_loose_tracks(fx.detections, fx.frames, CONFIG).collect()}
    assert got == {(cid, r.frame, r.cand_idx): n for (cid, n), t in by_hand.items() for r in t} and len(got) > 4000


def test_calibration_under_open_gates(spark, by_hand):
    """Sizes, shapes, speeds and gaps that are mined, by numpy over tracks linked by hand."""
    from trackmend.plans.calibrate import report

    fx = Fixture(spark, SF)
    found, _ = report(fx.detections, fx.frames, fx.vio, fx.disparity, CONFIG)
    stable = [t for t in by_hand.values() if len(t) >= 30]
    area, aspect, speed, gaps_ = [], [], [], []
    for t in stable:
        for r in t:
            w, h = max(r.x2 - r.x1, 1e-6), max(r.y2 - r.y1, 1e-6)
            area.append((r.x2 - r.x1) * (r.y2 - r.y1))
            aspect.append(max(w, h) / min(w, h))
        for a, b in itertools.pairwise(t):
            moved = math.dist(((a.x1 + a.x2) / 2, (a.y1 + a.y2) / 2), ((b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2))
            if b.frame == a.frame + 1:
                speed.append(moved)
            gaps_.append(b.frame - a.frame - 1)
    sizes = found["sizes"].first()
    assert sizes.n_boxes == len(area)
    for name, values, at in (("area", area, calibration.AREA), ("aspect", aspect, calibration.ASPECT), ("speed", speed, calibration.SPEED)):
        assert [sizes[f"{name}_p{p}".replace(".", "_")] for p in at] == pytest.approx(np.percentile(values, at).tolist())
    assert 0 < found["gaps"].first().n_gaps <= sum(n > 0 for n in gaps_)


def test_validation_under_open_gates(spark, by_hand):
    """The proxies of each stage, counted from tracks linked by hand and the rows that a correction keeps."""
    from trackmend.plans.correct import stage_survivor_ids, staged
    from trackmend.plans.validate import validate_corpus

    fx = Fixture(spark, SF)
    real = {(cid, d) for (cid, _), t in by_hand.items() if len(t) >= 30 for r in t for d in r.source_ids}
    rows = {(r.cid, r.det_id): r for r in stage_survivor_ids(staged(fx.detections, fx.frames, fx.vio, CONFIG)).collect()}
    clips = {cid for cid, _ in rows}
    for r in validate_corpus(fx.detections, fx.frames, fx.vio, fx.clips, CONFIG)["stage_summary"].collect():
        precision, recall = [], []
        for cid in clips:
            alive = {k for k, x in rows.items() if k[0] == cid and (r.stage == "raw" or x[r.stage])}
            true = {k for k in real if k[0] == cid}
            precision.append(len(alive & true) / len(alive))
            recall.append(len(alive & true) / len(true))
        assert (r.mean_precision_proxy, r.mean_recall_proxy) == pytest.approx((np.mean(precision), np.mean(recall)))


def test_all_candidates_get_a_track(spark):
    fx = Fixture(spark, SF)
    rows = registry.QUERIES["associate_all_candidates"](spark, SF).collect()
    assert len(rows) == merge.merge_duplicates(fx.detections, LANES).count() > merge.merge_duplicates(fx.detections.where("kind > 2"), LANES).count()
    assert all(r.same and r.late is False for r in rows)


def test_correction_keeps_its_promises(spark):
    fx = Fixture(spark, SF)
    out = correct_detections(fx.detections, fx.frames, fx.vio, fx.clips, CONFIG).persist()
    assert all(r.ok for r in audit.completeness_summary(audit.completeness_check(fx.detections, out)).collect())
    rejected = F.col("status") == "rejected"
    assert out.where(rejected & (F.col("reject_stage").isNull() | F.col("track_id").isNotNull())).isEmpty()
    assert out.where(~rejected & (F.col("reject_stage").isNotNull() | F.col("track_id").isNull())).isEmpty()
    assert out.where("status = 'interpolated' and (confidence is not null or size(source_ids) > 0)").isEmpty()
    seen = out.where(~rejected).groupBy("cid", "track_id", "frame").count().where("count > 1")
    assert seen.isEmpty()  # no filled row on an observed frame of its track


def test_empty_tables(spark):
    fx = Fixture(spark, SF)
    none = fx.detections.limit(0)
    assert correct_detections(none, fx.frames, fx.vio, fx.clips, CONFIG).count() == 0
    assert calibration.size_shape_speed_stats(fx.tracked.limit(0)).first().area_p1 is None
    assert calibration.pick_disparity_threshold(fx.disparity.limit(0).withColumn("is_wearer", F.lit(True))).first().trusted is False


def test_disparity_of_a_known_shift():
    rng = np.random.default_rng(0)
    left = rng.integers(0, 255, (60, 200)).astype(np.uint8)
    right = np.roll(left, -17, axis=1)
    disp, conf = stereo.Pair(left, right).disparity((60, 15, 120, 50))
    assert disp == 17.0 and conf > 0.999
    assert stereo.Pair(left, right).disparity((60, 15, 66, 50)) == (None, 0.0)
    assert stereo.Pair(np.full_like(left, 9), right).disparity((60, 15, 120, 50)) == (None, 0.0)


@pytest.mark.parametrize("seed", range(6))
def test_correlation_is_that_of_every_window(seed):
    rng = np.random.default_rng(seed)
    image = rng.integers(0, 256, (int(rng.integers(12, 40)), int(rng.integers(12, 70)))).astype(np.uint8)
    image[3:9, 2:11] = 7  # flat windows
    patch = image[2:9, 1:12] if seed % 2 else rng.integers(0, 256, (6, 5)).astype(np.uint8)
    want = np.zeros((image.shape[0] - patch.shape[0] + 1, image.shape[1] - patch.shape[1] + 1))
    p = patch - patch.mean()
    for i, j in np.ndindex(want.shape):
        w = image[i : i + patch.shape[0], j : j + patch.shape[1]].astype(float)
        w = w - w.mean()
        spread = np.sqrt((w * w).sum() * (p * p).sum())
        want[i, j] = (w * p).sum() / spread if spread > 1e-9 else 0.0
    assert np.abs(stereo.correlate(image, patch) - want).max() < 1e-9


def test_a_large_box_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    left = rng.integers(0, 256, (1200, 1920)).astype(np.uint8)
    pair = stereo.Pair(left, np.roll(left, -37, axis=1))
    tracemalloc.start()
    try:
        assert pair.disparity((700, 200, 1400, 900)) == (37.0, 1.0)
        assert tracemalloc.get_traced_memory()[1] < 150 << 20
    finally:
        tracemalloc.stop()


def test_equal_places_count_from_the_left():
    left = np.tile(np.random.default_rng(1).integers(0, 256, (40, 10)).astype(np.uint8), (1, 20))
    assert stereo.Pair(left, left).disparity((100, 5, 140, 35)) == (100.0, 1.0)


@pytest.mark.parametrize("name", ["box_disparity"])
def test_whole_pages_are_compared(spark, monkeypatch, name):
    sizes = {}
    monkeypatch.setattr(registry.stereo, "box_disparity", lambda boxes, pixels: sizes.update({r.cid: (r.h, len(r.left), len(r.right), r.y2) for r in pixels.join(boxes, "cid").collect()}) or boxes.withColumn("disp", F.lit(0.0)).withColumn("match_conf", F.lit(0.0)))
    registry.QUERIES[name](spark, SF)
    lengths = {r.page_id: r.n for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.octet_length("html").alias("n")).collect()}
    assert max(lengths.values()) >= 49 * 80
    assert sizes == {p: (n // 80, n // 80 * 80, n // 80 * 80, n // 80 - n // 80 // 6) for p, n in lengths.items()}


def test_only_the_named_clips_are_opened(spark, tmp_path):
    for name in ("a", "b*", "c"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "hand_boxes.json").write_text(json.dumps({"video_frame_count": 1, "frames": [{"frame": 0, "detections": [{"xyxy": [1, 2, 3, 4], "class": 0, "confidence": 0.9}]}]}))
        (tmp_path / name / "meta.json").write_text(json.dumps({"width": 640}))
        (tmp_path / name / "vio_pose.json").write_text(json.dumps({"t": [0.0], "speed": [1.0], "yaw": [0.0], "pitch": [0.0], "roll": [0.0]}))
        (tmp_path / name / "frame_ts.json").write_text(json.dumps({"frame_ts": {"0": 5}}))
    (tmp_path / "c" / "hand_boxes.json").write_text("not read")
    root = str(tmp_path)
    for read in (bundles.read_detections, bundles.read_frames, bundles.read_vio, bundles.read_frame_ts, bundles.read_clips):
        assert sorted(r.cid for r in read(spark, root, clips=["a", "b*", "a"]).collect()) == ["a", "b*"]
        assert read(spark, root, clips=[]).count() == 0
        assert [f for f in read(spark, root, clips=["a"]).inputFiles() if "/a/" not in f] == []


def test_one_clip_is_corrected_again(spark, tmp_path):
    """Its folder and its row of the summary are replaced; the files and rows of all others stay."""
    schema = "cid string, frame long, x1 double, y1 double, x2 double, y2 double, status string, confidence double, track_id long, reject_stage string, source_ids array<bigint>"
    detections = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("c", 0, 0)], "cid string, frame long, det_id long")
    first = spark.createDataFrame([(c, f, 0.0, 0.0, 1.0, 1.0, "reported", 0.5, 0, None, [i]) for c, f, i in (("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("c", 0, 0))], schema)
    rows, summary = str(tmp_path / "rows"), str(tmp_path / "summary")
    sinks.write_corrected(first, rows, "json")
    sinks.write_run_summary(detections, first, summary)
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "rows").glob("cid=[bc]/*.json")}
    before = {r.cid: r for r in spark.read.json(summary).collect()}
    again = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0, "reported", 0.5, 7, None, [0]), ("a", 1, 0.0, 0.0, 1.0, 1.0, "rejected", 0.5, None, "size", [1])], schema)
    sinks.replace_corrected(again, rows)
    sinks.replace_run_summary(detections.where("cid = 'a'"), again, summary, str(tmp_path / "staging"))
    assert kept and {p: p.stat().st_mtime_ns for p in (tmp_path / "rows").glob("cid=[bc]/*.json")} == kept
    found = spark.read.schema(schema).json(rows)
    assert sorted((r.cid, r.frame, r.status, r.track_id) for r in found.collect()) == [("a", 0, "reported", 7), ("a", 1, "rejected", None), ("b", 0, "reported", 0), ("c", 0, "reported", 0)]
    after = {r.cid: r for r in spark.read.json(summary).collect()}
    assert {c: after[c] for c in "bc"} == {c: before[c] for c in "bc"} and (after["a"].reported, after["a"].rejected) == (1, 1) and (before["a"].reported, before["a"].rejected) == (2, 0)


def test_corrected_rows_are_written_in_order(spark, tmp_path):
    """Each file has whole clips, one after another, each in the order of its frames; in both forms."""
    import pyarrow.json
    import pyarrow.parquet

    fx = Fixture(spark, SF)
    out = correct_detections(fx.detections, fx.frames, fx.vio, fx.clips, CONFIG).persist()
    for form, suffix in (("parquet", "parquet"), ("json", "json")):
        sinks.write_corrected(out.repartition(5, "frame"), str(tmp_path / form), form)
        places = []
        for f in sorted((tmp_path / form).rglob(f"*.{suffix}")):
            rows = pyarrow.parquet.read_table(f) if form == "parquet" else pyarrow.json.read_json(f)
            clips = rows.column("cid").to_pylist() if form == "parquet" else [int(f.parent.name.removeprefix("cid="))] * rows.num_rows
            one = list(zip(clips, rows.column("frame").to_pylist(), strict=True))
            assert one == sorted(one)
            places.append(set(clips))
        assert sum(map(len, places)) == len(set().union(*places)) == 3  # no clip is in two files
    out.unpersist()


@pytest.mark.parametrize("values", [[0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, -5e-324], [7.0] * 50, [1.0], [float(i // 3) - 20 for i in range(200)]], ids=["odd", "ties", "one", "many"])
def test_radix_selection(spark, values):
    df = spark.createDataFrame([(v, None if i % 2 else v) for i, v in enumerate(values)], "v double, w double").repartition(3)
    at = (1, 25, 50, 90, 99.5)
    row = calibration.percentiles_of(df, [(F.col("v"), "v", at), (F.col("w"), "w", at), (F.col("v") / F.lit(None), "n", (50,))]).first()
    want = [*np.percentile(values, at), *np.percentile(values[::2], at)]
    assert list(row)[:-1] == pytest.approx([float(x) for x in want], rel=1e-12) and row[-1] is None


def test_bundle_files(spark, tmp_path):
    d = tmp_path / "a_t1"
    d.mkdir()
    (d / "hand_boxes.json").write_text(json.dumps({"video_frame_count": 3, "frames": [{"frame": 0, "detections": [{"xyxy": [1, 2, 3, 4], "class": 0, "confidence": 0.9}, {"xyxy": [5, 6, 7, 8], "class": 0, "handedness": "left", "confidence": 0.5}]}, {"frame": 1, "detections": []}, {"frame": 2, "detections": [{"xyxy": [1, 1, 2, 2], "class": 0, "confidence": 0.8}]}]}))
    (d / "meta.json").write_text(json.dumps({"width": 640}))
    rows = bundles.read_detections(spark, str(tmp_path)).orderBy("det_id").collect()
    assert [(r.cid, r.frame, r.det_id, r.x1, r.handedness) for r in rows] == [("a_t1", 0, 0, 1.0, ""), ("a_t1", 0, 1, 5.0, "left"), ("a_t1", 2, 2, 1.0, "")]
    assert bundles.read_frames(spark, str(tmp_path)).count() == 3
    assert tuple(bundles.read_clips(spark, str(tmp_path)).first()) == ("a_t1", 3, 640.0, 1200.0)


def test_config_round_trip(spark, tmp_path):
    save_config(spark, hands().but(max_dropout_frames=22), str(tmp_path / "c"))
    assert load_config(spark, str(tmp_path / "c")) == hands().but(max_dropout_frames=22)
    assert load_config(spark, str(tmp_path / "missing")) == hands()


def test_geometry_against_plain_arithmetic(spark):
    rng = random.Random(1)
    rows = [tuple(float(rng.randint(-20, 40)) for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{p}_{c} double" for p in "ab" for c in ("x1", "y1", "x2", "y2")))
    a, b = g.box("a_"), g.box("b_")
    for r, got in zip(rows, df.select(g.iou(a, b), g.overlap_ratio(a, b), g.box_area(a)).collect(), strict=True):
        area = lambda q: max(0, q[2] - q[0]) * max(0, q[3] - q[1])
        p, q = r[:4], r[4:]
        common = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
        union, least = area(p) + area(q) - common, min(area(p), area(q))
        want = (common / union if common > 0 and union > 0 else 0, common / least if common > 0 and least > 0 else 0, area(p))
        assert tuple(got) == pytest.approx(want)


@pytest.mark.parametrize("seed", range(12))
def test_percentiles_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 3, 7, 50, 100, 101, 999, 5000, 20_000, 50_000, 70_000][seed]
    values = rng.normal(0, 100, n) if seed % 2 else rng.integers(0, max(2, n // 10), n).astype(float)
    at = (0, 1, 5, 40, 50, 90, 99, 99.5, 99.9, 100)
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    assert list(calibration.percentiles(df, F.col("x"), "x", at).first()) == pytest.approx(np.percentile(values, at).tolist(), abs=1e-9)
