"""Jobs over boxes read and link them once, and blocks and batches of any size give the same results."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmend.config import Config
from trackmend.operators import tracking
from trackmend.plans import correct
from trackmend.plans.fixtures import CHAIN, CONFIG, STEADY, Fixture

SF = "/root/testdata/sf0.001"
BOX = "x1 double, y1 double, x2 double, y2 double"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_box_is_linked_once(spark):
    fx = Fixture(spark, SF)
    plan = executed(correct.stage_survivor_ids(correct.staged(fx.detections, fx.frames, fx.vio, CHAIN)))
    # merging, linking and the fold over tracks
    assert plan.count("MapInArrow") == 3
    assert "InPandas" not in plan and "InMemoryTableScan" not in plan


@pytest.mark.parametrize("config", [CHAIN, CONFIG, CONFIG.loose().but(max_dropout_frames=4)])
def test_blocks_change_nothing(spark, config):
    rng = random.Random(5)
    rows = [(c, f, k, 90.0 * k + rng.uniform(-60, 60), 0.0, 90.0 * k + 100, 100.0, None if rng.random() < 0.9 else "size") for c in range(4) for f in range(60) if f % 30 < 14 + c for k in range(3) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, f"cid long, frame long, cand_idx long, {BOX}, reject_stage string")
    frames = spark.createDataFrame([(c, f) for c in range(5) for f in range(0, 70, 3)], "cid long, frame long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = [sorted(map(str, tracking.associate(df, frames, config, block=b).collect())) for b in (5, 37, 10_000)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    # by the one-frame-at-a-time linker, clip by clip
    numbers, lasts = {}, {}
    for c in range(4):
        linker = tracking.Linker(config)
        for f in range(60):
            some = sorted(r for r in rows if r[0] == c and r[1] == f and r[7] is None)
            if some:
                for r, n in zip(some, linker.step(f, np.array([r[3:7] for r in some])), strict=True):
                    numbers[r[:3]] = n
                    lasts[c, n] = f
    stop = {t: min((f for f in range(0, 70, 3) if f > last + config.give_up_frames), default=999) for t, last in lasts.items()}
    place = {t: i - min(j for j, u in enumerate(order) if u[0] == t[0]) for order in [sorted(stop, key=lambda t: (t[0], stop[t], t[1]))] for i, t in enumerate(order)}
    for r in tracking.associate(df, frames, config, block=11).collect():
        number = numbers.get((r.cid, r.frame, r.cand_idx))
        assert (r.track_id, r.track_ord) == ((None, None) if r.reject_stage else (number, place[r.cid, number]))


@pytest.mark.parametrize("seed", range(30))
def test_sequences_side_by_side_choose_as_one_by_one(seed):
    """Crowded frames with ties, which neither side's cheapest choices settle."""
    rng = np.random.default_rng(seed)
    config = Config(max_speed_px_per_frame=5.0, resume_gate_px=40.0, max_dropout_frames=1)
    sequence, frame, boxes, want = [], [], [], []
    for s in range(6):
        linker, at = tracking.Linker(config), {}
        for f in range(12):
            n = int(rng.integers(0, 5))
            if not n:
                continue
            xy = rng.integers(0, 8, (n, 2)) * 10.0
            some = np.c_[xy, xy + 20]
            for k, number in enumerate(linker.step(f, some)):
                want.append(at.setdefault(number, len(sequence) + k))
            sequence += [s] * n
            frame += [f] * n
            boxes.append(some)
    track, _ = tracking.Lockstep(config).link(np.array(sequence), np.array(frame), np.concatenate(boxes), np.zeros((0, tracking.Linker.WIDTH)))
    assert track.tolist() == want


def test_the_fold_goes_on_over_batches(spark):
    from trackmend.operators import temporal

    rng = random.Random(6)
    places = {t: [rng.choice([0.0, 5.0, 300.0, 305.0, 2.0]) for _ in range(40)] for t in range(5)}
    rows = [(1, f, t, x, 0.0, x + 10, 10.0) for t, xs in places.items() for f, x in enumerate(xs)]
    want = set()
    for t, xs in places.items():
        held = None
        for f, x in enumerate(xs):
            if held is not None and abs(x - held[1]) / max(1, f - held[0]) > 100:
                want.add((t, f))
            else:
                held = f, x
    df = spark.createDataFrame(rows, f"cid long, frame long, track_id long, {BOX}")
    for n in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got = {(r.track_id, r.frame) for r in temporal.reject_displacement(df, Config(max_speed_px_per_frame=100)).where("reject_stage = 'displacement'").collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want and want


@pytest.fixture(scope="module")
def lined(spark, tmp_path_factory):
    """Pages with repeated lines, in which a patch is found at several places, a flat one, and a low one."""
    folder = str(tmp_path_factory.mktemp("pages"))
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefghij <>é") for _ in range(n))
    line = noise(20)
    pages = [(1, (line * 8)[:160] * 60), (2, "x" * 9000), (3, noise(9000)), (4, "low" * 20), (5, None), (17, (noise(13) * 1000)[:9000]), (8, (noise(80) * 120)[:9000]), (6, noise(400) + "a" * 7000)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["box_disparity", "box_disparity_all_pages"])
def test_disparities_of_pages_with_repeated_lines(spark, lined, name):
    import duckdb

    from trackmend.plans import registry

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{lined}/pages.parquet/*.parquet'")
    found = con.sql(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    got = registry.QUERIES[name](spark, lined).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))
    by = {(r.cid, r.asDict().get("x1")): r.disp for r in got}
    assert any(d is not None and d != c % 9 for (c, _), d in by.items()) and any(d is None for d in by.values())


@pytest.mark.parametrize("kind", ["boxes", "vio", "ts"])
def test_a_query_writes_only_the_bundles_it_reads(spark, kind):
    import os

    from trackmend.plans import registry

    assert os.listdir(registry._bundles(Fixture(spark, SF), kind)) == [kind]


def test_toxicity_is_learned_from_every_labelled_row(spark, monkeypatch):
    from trackmend.llm import _labelled, toxicity

    keys = spark.range(15000).select(F.col("id").alias("doc_id"))
    learned = keys.where(~_labelled.held_out(F.col("doc_id")) & (_labelled.dealt(F.col("doc_id")) < 0.67) & (F.col("doc_id") % 40 > 0))
    # a sample in the order of this hash would end before these rows
    late = [r.doc_id for r in learned.orderBy(F.xxhash64(F.lit(17), F.col("doc_id")).desc()).limit(12).collect()]
    docs = keys.withColumn("text", F.when(F.col("doc_id").isin(late), "zorgle plain words").otherwise("plain words")).persist()
    labels = keys.withColumn("toxic", (F.col("doc_id") % 40 > 0).cast("int"))
    model = toxicity.fit_toxicity(docs, labels)
    # words of 12 of about 6530 toxic rows and of none of about 170 clean ones aren't told apart; all rows' trigrams are counted
    rows = learned.count() + keys.where(~_labelled.held_out(F.col("doc_id")) & (_labelled.dealt(F.col("doc_id")) < 0.67) & (F.col("doc_id") % 40 == 0)).count()
    assert model.trigrams["^^p"] == rows and model.trigrams["^^z"] == 12
    monkeypatch.setattr(toxicity, "COUNTED", 10)
    again = toxicity.fit_toxicity(docs, labels)
    assert (again.lexicon, again.trigrams) == (model.lexicon, model.trigrams)


def test_rows_that_stand_for_many_count_as_many():
    from trackmend.llm import _labelled

    x, y, n = np.array([[0.0], [1.0], [2.0], [1.5]]), np.array([0, 0, 1, 0]), np.array([5, 2, 4, 1])
    one = _labelled.fit(x, y, {0: 80, 1: 20}, times=n)
    many = _labelled.fit(np.repeat(x, n, 0), np.repeat(y, n), {0: 80, 1: 20})
    assert np.allclose(one(x), many(x), atol=1e-12)


def test_trials_of_all_lengths_are_drawn_in_one_pass(spark):
    from trackmend.operators import validation

    fx = Fixture(spark, SF)
    trials = validation.dropout_trials(fx.tracked, [1, 2, 3], 15)
    plan = executed(trials)
    assert plan.count("Scan parquet") == 1 and "WindowGroupLimit" in plan and "TakeOrdered" not in plan
    rows = trials.collect()
    for k in (1, 2, 3):
        assert sorted(r.trial for r in rows if r.k == k) == list(range(1, 1 + sum(r.k == k for r in rows))) and sum(r.k == k for r in rows) <= 15


def test_reports_of_a_validation_share_the_output_rows(spark):
    from trackmend.plans.validate import validate_corpus

    fx = Fixture(spark, SF)
    reports = validate_corpus(fx.detections, fx.frames, fx.vio, fx.clips, CHAIN)
    for name in ("status_counts", "frame_coverage_recall", "multibox_resolution", "interpolation_rate"):
        held = re.findall(r"InMemoryRelation \[(.*?)\]", reports[name]._jdf.queryExecution().withCachedData().toString())
        assert any("status#" in columns for columns in held), name
    spark.catalog.clearCache()


def test_a_correction_is_one_pass_that_keeps_nothing(spark):
    from trackmend.sources import sinks

    spark.catalog.clearCache()
    fx = Fixture(spark, SF)
    out = correct.correct_detections(fx.detections, fx.frames, fx.vio, fx.clips, CHAIN)
    # the summary reads the output once: merging, linking and the fold over tracks
    plan = executed(sinks.run_summary(fx.detections, out))
    assert "InMemoryTableScan" not in plan and plan.count("MapInArrow") == 3


def test_a_report_by_itself_keeps_nothing(spark):
    from trackmend.plans import registry

    spark.catalog.clearCache()
    for name in ("frame_coverage_recall", "validate_coverage_report", "validate_multibox_report", "validate_interpolation_report", "validate_corpus_of_lanes"):
        assert "InMemoryTableScan" not in executed(registry.QUERIES[name](spark, SF)), name
    # the rates of clips are dealt once for both of their readers
    assert executed(registry.QUERIES["validate_interpolation_report"](spark, SF)).count("REPARTITION_BY_COL") >= 2


def test_output_rows_of_one_pass_are_those_of_two(spark):
    from trackmend.operators import gaps

    rows = [(c, f, t, 10 * t + c, 40.0 * f, 300.0 * t, 40.0 * f + 90, 300.0 * t + 90, 0.5, [100 * f + t], f % 7 == 0, "static" if (f + t) % 11 == 0 else None) for c in (1, 2) for t in (0, 1, 2) for f in range(40) if f % (5 + t) > 1]
    rows += [(1, f, None, None, 0.0, 0.0, 9.0, 9.0, 0.1, [7000 + f], False, "size") for f in range(9)]
    df = spark.createDataFrame(rows, f"cid long, frame long, track_id long, track_ord long, {BOX}, confidence double, source_ids array<bigint>, was_merged boolean, reject_stage string")
    clips = spark.createDataFrame([(1, 1850.0, 1000.0)], "cid long, width double, height double")
    got = gaps.output_rows(df, clips, CONFIG)
    rejected = df.where("reject_stage is not null").select("cid", "frame", "x1", "y1", "x2", "y2", F.lit("rejected").alias("status"), "confidence", F.lit(None).cast("long").alias("track_id"), "reject_stage", "source_ids")
    want = rejected.unionByName(gaps.interpolate_tracks(df.where("reject_stage is null"), clips, CONFIG))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {"interpolated", "rejected", "merged", "reported"} == {r.status for r in got.collect()}


def test_a_summary_tells_missing_boxes_and_those_put_out_twice(spark):
    from trackmend.sources import sinks

    boxes = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "cid long, det_id long")
    out = spark.createDataFrame([(1, [0, 1], "merged"), (1, [1], "rejected"), (1, [], "interpolated"), (1, [9], "reported"), (2, [0], "reported")], "cid long, source_ids array<bigint>, status string")
    got = {r.cid: r.asDict() for r in sinks.run_summary(boxes, out).collect()}
    assert got[1] == {"cid": 1, "total_raw": 3, "accounted": 3, "missing": 0, "n_duplicated": 1, "ok": False, "reported": 1, "merged": 1, "rejected": 1, "interpolated": 1}
    assert got[2] == {"cid": 2, "total_raw": 1, "accounted": 1, "missing": 0, "n_duplicated": 0, "ok": True, "reported": 1, "merged": 0, "rejected": 0, "interpolated": 0}


@pytest.mark.parametrize("name", ["derive_config", "calibrate"])
def test_statistics_of_a_calibration_share_their_passes(spark, monkeypatch, name):
    from trackmend.operators import calibration
    from trackmend.plans import registry

    spark.catalog.clearCache()
    passes, histograms = [], calibration._histograms

    def counted(values, prefixes, shift):
        passes.append(len(prefixes))
        return histograms(values, prefixes, shift)

    monkeypatch.setattr(calibration, "_histograms", counted)
    plan = executed(registry.QUERIES[name](spark, SF))
    # tracks, camera, ranks and disparities, four passes each; the row that follows reads no table again
    assert len(passes) == 16
    assert "Scan parquet" not in plan and "InMemoryTableScan" not in plan


def shuffled(spark):
    import glob

    return set(glob.glob(f"{spark.conf.get('spark.local.dir')}/blockmgr-*/*/shuffle_*.data"))


def test_written_reports_leave_nothing_on_the_disk(spark):
    import time

    from trackmend.plans import registry

    spark.catalog.clearCache()
    folder, before = spark.conf.get("spark.checkpoint.dir"), shuffled(spark)
    registry.QUERIES["write_reports"](spark, SF).count()
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.5)
    assert len(shuffled(spark) - before) <= 8  # of the count itself, a file for each task at most
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert not [f for f in os.listdir(folder) if f.startswith("validation-")]


def test_reports_of_written_steps_are_those_of_kept_ones(spark, tmp_path):
    from trackmend.plans import registry
    from trackmend.plans.validate import validate_corpus

    fx = Fixture(spark, SF)
    of = fx.steady, fx.frames, fx.vio, fx.clips, STEADY
    plain = lambda rows: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows.collect())
    # boxes that aren't finite, and loose tracks that merge by another threshold
    cases = [(of, None), ((fx.detections.withColumn("x1", F.expr(registry._SPOILT)), fx.frames, fx.vio, fx.clips, CHAIN), registry.LOOSE.but(duplicate_overlap_threshold=0.9))]
    for i, (given, loose) in enumerate(cases):
        kept = {k: plain(r) for k, r in validate_corpus(*given, loose=loose).items()}
        spark.catalog.clearCache()
        assert {k: plain(r) for k, r in validate_corpus(*given, loose=loose, scratch=f"{tmp_path}/{i}").items()} == kept
        assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
        assert i or len(kept["synthetic_dropout"]) > 2


@pytest.mark.parametrize("of_lanes", [False, True])
def test_all_frames_say_what_the_stereo_signal_is_worth(spark, of_lanes):
    from trackmend.operators import calibration
    from trackmend.plans import registry
    from trackmend.plans.calibrate import report

    fx = Fixture(spark, SF)
    found = report(fx.detections, fx.frames, fx.vio, fx.disparity, CONFIG, loose=registry.LOOSE if of_lanes else None)[0]["disparity"].first()
    frames = calibration.multibox_frames(fx.detections)
    assert frames.groupBy("cid").count().where("count > 150").count()  # more than a stride would take
    assert found.n_wearer + found.n_bystander == fx.disparity.where("disp is not null and match_conf >= 0.4").join(frames, ["cid", "frame"], "left_semi").count()
    assert ("range(150)" in registry.ORACLES["derive_config"]) and "range(150)" not in registry.ORACLES["calibrate_of_lanes"]


def test_a_validation_has_every_report(spark):
    from trackmend.operators import validation
    from trackmend.plans import registry

    fx = Fixture(spark, SF)
    got = {(r.report, r.cid, r["item"], r.measure): r.value for r in registry.QUERIES["validate_corpus"](spark, SF).collect()}
    named = {"status_counts", "proxy_precision_recall", "stage_summary", "frame_coverage_recall", "multibox_resolution", "interpolation_rate"}
    assert {k[0] for k in got} - {"synthetic_dropout"} == named  # no run is long enough here to hide frames in
    # against what the whole correction puts out, gaps filled
    out = correct.correct_detections(fx.detections, fx.frames, fx.vio, fx.clips, CONFIG).persist()
    counts = {("status_counts", r.cid, r.status, "n"): r["count"] for r in out.groupBy("cid", "status").count().collect()}
    assert {k: n for k, n in got.items() if k[0] == "status_counts"} == counts and any(k[2] == "interpolated" for k in counts)
    stable = tracking.stable_tracks(tracking.build_loose_tracks(fx.detections, fx.frames, CONFIG))
    cover = validation.frame_coverage_recall(validation.frame_coverage(stable, out))
    assert {(r.cid, m): pytest.approx(r[m], abs=1e-6) for r in cover.collect() for m in cover.columns[1:]} == {(k[1], k[3]): n for k, n in got.items() if k[0] == "frame_coverage_recall"}
    rates = validation.flag_interpolation_outliers(validation.interpolation_rate(out, fx.clips))
    assert {(r.cid, m): pytest.approx(float(r[m]), abs=1e-6) for r in rates.collect() for m in rates.columns[1:]} == {(k[1], k[3]): n for k, n in got.items() if k[0] == "interpolation_rate"}
    out.unpersist()
