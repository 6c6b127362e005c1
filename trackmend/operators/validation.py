"""Quality without labels: stable loose tracks stand for the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmend.config import Config
from trackmend.functions.geometry import box, box_diag, centroid_distance, iou
from trackmend.operators.calibration import multibox_frames
from trackmend.operators.gaps import classify_gaps, contiguous_runs, interpolate_gaps, split_track_ids

_BOX = ["x1", "y1", "x2", "y2"]


def real_ids(stable: DataFrame) -> DataFrame:
    """(cid, det_id) of the boxes behind stable tracks."""
    return stable.select("cid", F.explode("source_ids").alias("det_id")).distinct()


def real_id_membership(survivors: DataFrame, real: DataFrame) -> DataFrame:
    """Survivor rows with ``is_real``."""
    return survivors.join(real.withColumn("is_real", F.lit(True)), ["cid", "det_id"], "left").withColumn("is_real", F.coalesce("is_real", F.lit(False)))


def proxy_precision_recall(detections: DataFrame, survivors: DataFrame, real: DataFrame) -> DataFrame:
    """(cid, stage, n_survivors, precision_proxy, recall_proxy): all stages from one row for each box."""
    rows = real_id_membership(detections.select("cid", "det_id").join(survivors, ["cid", "det_id"], "left"), real)
    stages = {"raw": F.lit(True), **{s: F.coalesce(s, F.lit(False)) for s in ("geometric", "temporal", "cap")}}
    sums = [F.count_if("is_real").alias("n_real")]
    for s, alive in stages.items():
        sums += [F.count_if(alive).alias(f"n_{s}"), F.count_if(alive & F.col("is_real")).alias(f"t_{s}")]
    each = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"n_{s}").alias("n"), F.col(f"t_{s}").alias("t")) for s in stages])
    wide = rows.groupBy("cid").agg(*sums).select("cid", "n_real", F.explode(each).alias("s"))
    return wide.select("cid", "s.stage", F.col("s.n").alias("n_survivors"), F.try_divide("s.t", "s.n").alias("precision_proxy"), F.try_divide("s.t", "n_real").alias("recall_proxy"))


def stage_summary(proxies: DataFrame) -> DataFrame:
    """(stage, mean_precision_proxy, mean_recall_proxy): means over clips that have a value."""
    return proxies.groupBy("stage").agg(F.avg("precision_proxy").alias("mean_precision_proxy"), F.avg("recall_proxy").alias("mean_recall_proxy"))


def frame_coverage(stable: DataFrame, finalized: DataFrame) -> DataFrame:
    """(cid, frame, track_id, covered, covered_without): whether an output box of the frame is near each stable box,
    among all of them, and among those that aren't interpolated."""
    out = finalized.where("status <> 'rejected'").select("cid", "frame", *[F.col(c).alias(f"o_{c}") for c in _BOX], (F.col("status") == "interpolated").alias("filled"))
    near = centroid_distance(box(), box("o_")) <= F.greatest(box_diag(box()), F.lit(1.0))
    rows = stable.select("cid", "frame", "track_id", *_BOX).join(out, ["cid", "frame"], "left")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy("cid", "frame", "track_id").agg(any_(near).alias("covered"), any_(near & ~F.col("filled")).alias("covered_without"))


def frame_coverage_recall(coverage: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return coverage.groupBy("cid").agg(F.count(F.lit(1)).alias("n_stable_track_frames"), share("covered_without").alias("recall_without"), share("covered").alias("recall_with"), (share("covered") - share("covered_without")).alias("recall_gain"))


def multibox_resolution(detections: DataFrame, finalized: DataFrame, clips: DataFrame, class_max: int = 2) -> DataFrame:
    """(cid, n_multibox, frac_resolved): frames of many boxes whose output has ``class_max`` boxes or fewer."""
    n = finalized.where("status <> 'rejected'").groupBy("cid", "frame").agg(F.count(F.lit(1)).alias("out"))
    per = multibox_frames(detections).join(n, ["cid", "frame"], "left").groupBy("cid").agg(F.count(F.lit(1)).alias("n_multibox"), F.avg((F.coalesce("out", F.lit(0)) <= class_max).cast("double")).alias("frac_resolved"))
    return clips.select("cid").join(per, "cid", "left").fillna(0, ["n_multibox"])


def interpolation_rate(finalized: DataFrame, clips: DataFrame) -> DataFrame:
    """(cid, interpolation_rate): share of all output rows; 0 for clips without any."""
    per = finalized.groupBy("cid").agg(F.avg((F.col("status") == "interpolated").cast("double")).alias("interpolation_rate"))
    return clips.select("cid").join(per, "cid", "left").fillna(0.0, ["interpolation_rate"])


def flag_interpolation_outliers(rates: DataFrame, most: float = 0.20) -> DataFrame:
    """Rates with the corpus mean, population deviation, and ``flagged``."""
    rates = rates.repartition("cid")  # a row for each clip: both readers share what is dealt, not all that the rates come from
    corpus = rates.agg(F.avg("interpolation_rate").alias("mean_rate"), F.stddev_pop("interpolation_rate").alias("std_rate"))
    flagged = (F.col("interpolation_rate") > F.col("mean_rate") + 3 * F.col("std_rate")) | (F.col("interpolation_rate") > most)
    return rates.crossJoin(F.broadcast(corpus)).withColumn("flagged", flagged)  # one row


def devset_ranking(detections: DataFrame, clips: DataFrame) -> DataFrame:
    """(cid, n_frames, n_multibox, frac): clips by their share of frames of many boxes."""
    n = multibox_frames(detections).groupBy("cid").agg(F.count(F.lit(1)).alias("n_multibox"))
    rows = clips.select("cid", F.col("frame_count").alias("n_frames")).join(n, "cid", "left").fillna(0, ["n_multibox"])
    return rows.withColumn("frac", F.when(F.col("n_frames") > 0, F.col("n_multibox") / F.col("n_frames")).otherwise(0.0)).orderBy(F.desc("frac"), "cid")


def draw(seed: int, *columns: str) -> Column:
    """A number from 0 to 2 ** 32 - 1 from a digest of the columns, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]).cast("binary")), 1, 8), 16, 10).cast("long")


def dropout_trials(tracked: DataFrame, lengths: list[int], per_length: int, least: int = 20) -> DataFrame:
    """(k, trial, cid, track_id, gap_start): runs of tracks of ``least`` frames in which k frames will be hidden.

    Every run of k + 10 frames or more is a candidate with one start in it, drawn by a hash; of each k the first
    ``per_length`` in the order of another hash are taken.
    """
    long = tracked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cid", "track_id"))).where(F.col("_n") >= least)
    runs = contiguous_runs(long).withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in sorted(set(lengths))]))).where(F.col("length") >= F.col("k") + 10)
    room = F.col("length") - F.col("k") - 9  # starts 5 .. length - k - 5
    at = F.col("start") + 5 + F.pmod(draw(11, "cid", "track_id", "run", "k"), room)
    order = draw(7, "cid", "track_id", "run", "k")
    drawn = runs.select("k", "cid", "track_id", at.alias("gap_start"), order.alias("order"))
    # the first of each length in one pass over all: tasks keep no more than these of their own
    number = F.row_number().over(Window.partitionBy("k").orderBy("order", "cid", "track_id", "gap_start"))
    some = drawn.withColumn("_trial", number).where(F.col("_trial") <= per_length)
    return F.broadcast(some.select("k", "cid", "track_id", "gap_start", F.col("_trial").cast("long").alias("trial")))  # per_length rows of each length


def synthetic_dropout_eval(tracked: DataFrame, clips: DataFrame, config: Config, trials: DataFrame) -> DataFrame:
    """(k, trial, cid, track_id, n_recovered, mean_iou, mean_center_dist_px) of each trial: frames are hidden, the gap
    is filled as usual, and what is filled is compared with what was hidden."""
    rows = tracked.join(trials, ["cid", "track_id"]).withColumn("hidden", (F.col("frame") >= F.col("gap_start")) & (F.col("frame") < F.col("gap_start") + F.col("k")))
    scope = ("cid", "k", "trial", "track_id")
    seen = rows.where("not hidden")
    split = split_track_ids(classify_gaps(seen, clips, config, scope), ("cid", "k", "trial"))
    filled = interpolate_gaps(split, ("cid", "k", "trial")).select("cid", "k", "trial", "frame", *[F.col(c).alias(f"f_{c}") for c in _BOX])
    hidden = rows.where("hidden").select(*scope, "frame", *_BOX)
    both = hidden.join(filled, ["cid", "k", "trial", "frame"], "left")
    found = F.col("f_x1").isNotNull()
    return both.groupBy(*scope).agg(F.count_if(found).alias("n_recovered"), F.avg(F.when(found, iou(box(), box("f_")))).alias("mean_iou"), F.avg(F.when(found, centroid_distance(box(), box("f_")))).alias("mean_center_dist_px")).select("k", "trial", "cid", "track_id", "n_recovered", "mean_iou", "mean_center_dist_px")


def synthetic_dropout_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("k").agg(F.count(F.lit(1)).alias("n_trials"), (F.sum("n_recovered") / (F.first("k") * F.count(F.lit(1)))).alias("recovery_rate"), F.avg("mean_iou").alias("mean_iou"), F.avg("mean_center_dist_px").alias("mean_center_dist_px"))
