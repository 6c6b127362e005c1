"""Thresholds mined from a corpus of tracks: exact percentiles with linear interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmend.config import Config, hands
from trackmend.functions.geometry import aspect_ratio, box, box_area, box_diag
from trackmend.operators.camera import camera_moving, vio_angular_rate
from trackmend.operators.selection import top_tracks_per_frame
from trackmend.operators.temporal import track_motion

_BOX = ["x1", "y1", "x2", "y2"]
AREA, ASPECT, SPEED = (1, 5, 50, 95, 99, 99.5), (50, 90, 95, 99, 99.5), (50, 90, 95, 99, 99.5, 99.9)
GAP, MOTION, STATIC = (50, 75, 90, 95, 99), (10, 25, 40, 50, 75, 90), (1, 5, 10, 25, 50)


#: Bits of a double that one pass decides.
DIGIT = 16


def ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned integers that sort as the doubles do; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits | np.int64(-(1 << 63))).view(np.uint64)


def _double(key: int) -> float:
    """What ``ordered`` gives the number ``key``."""
    bits = key & ~(1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _histograms(values: DataFrame, prefixes: list[list[int]], shift: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each measure and each prefix (the bits above ``shift`` + ``DIGIT``) the digits that occur, and how often.

    Tasks count into arrays of fixed size; what reaches the driver is at most 2 ** ``DIGIT`` rows for each prefix,
    however many values there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for m, wanted in enumerate(prefixes):
                keys = ordered(batch.column(m).drop_null().to_numpy().astype(np.float64))
                for prefix in wanted:
                    some = keys if shift + DIGIT == 64 else keys[keys >> np.uint64(shift + DIGIT) == np.uint64(prefix)]
                    digits = (some >> np.uint64(shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                    sums[m, prefix] = sums.get((m, prefix), 0) + np.bincount(digits, minlength=1 << DIGIT)
        for (m, prefix), n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), m, np.int32)), pa.array(np.full(len(used), prefix, np.int64)), pa.array(used.astype(np.int32)), pa.array(n[used])], ["m", "prefix", "digit", "n"])

    found = values.mapInArrow(count, "m int, prefix long, digit int, n long").groupBy("m", "prefix", "digit").agg(F.sum("n").alias("n")).toArrow()
    m, prefix, digit, n = (found.column(c).to_numpy() for c in ("m", "prefix", "digit", "n"))
    out = {}
    for i, wanted in enumerate(prefixes):
        for p in wanted:
            rows = np.flatnonzero((m == i) & (prefix == p))
            rows = rows[np.argsort(digit[rows])]
            out[i, p] = digit[rows], np.cumsum(n[rows])
    return out


def percentiles(rows: DataFrame, value: Column, name: str, at: tuple[float, ...]) -> DataFrame:
    """One row with ``<name>_p<percent>`` columns, exact and linearly interpolated; null over no rows."""
    return percentiles_of(rows, [(value, name, at)])


def percentiles_of(rows: DataFrame, measures: list[tuple[Column, str, tuple[float, ...]]]) -> DataFrame:
    """The percentiles of several values of the same rows, in one row; nulls of a value don't count.  The result is there
    when the call returns."""
    _, found = selected(rows, [(value, at) for value, _, at in measures])
    return _row(rows.sparkSession, [c for (_, name, at), values in zip(measures, found, strict=True) for c in _named(name, at, values)])


def _named(name: str, at: tuple[float, ...], values: list[float | None]) -> list[Column]:
    return [F.lit(v).cast("double").alias(f"{name}_p{p}".replace(".", "_")) for p, v in zip(at, values, strict=True)]


def _number(n: float | None, name: str) -> Column:
    return F.lit(None if n is None else int(n)).cast("long").alias(name)


def _row(spark: SparkSession, columns: list[Column]) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(*columns)


def selected(rows: DataFrame, measures: list[tuple[Column, tuple[float, ...]]]) -> tuple[list[int], list[list[float | None]]]:
    """(how many values each measure has, what is at its percents; none over no values).

    Radix selection: a pass counts, for the bits that are known of each wanted value, how the next ``DIGIT`` bits are
    spread; four passes know all 64.  No task, and no driver, holds more than these counts.  The values are kept for the
    passes and let go.
    """
    values = rows.select(*[value.cast("double").alias(f"v{m}") for m, (value, _) in enumerate(measures)]).persist()
    try:
        wanted: dict[tuple[int, int], tuple[int, int]] = {}  # (measure, rank) -> (bits known, rank among those that share them)
        prefixes = [[0] for _ in measures]
        total = [0] * len(measures)
        for shift in range(64 - DIGIT, -1, -DIGIT):
            found = _histograms(values, prefixes, shift)
            if shift == 64 - DIGIT:
                total = [int(found[m, 0][1][-1]) if len(found[m, 0][1]) else 0 for m in range(len(measures))]
                for m, (_, at) in enumerate(measures):
                    ranks = [p / 100 * (total[m] - 1) for p in at] if total[m] else []
                    wanted |= {(m, r): (0, r) for x in ranks for r in (math.floor(x), math.ceil(x))}
            for of, (prefix, rank) in wanted.items():
                digits, reached = found[of[0], prefix]
                i = int(np.searchsorted(reached, rank, side="right"))
                wanted[of] = (prefix << DIGIT) | int(digits[i]), rank - (int(reached[i - 1]) if i else 0)
            prefixes = [sorted({prefix for (of, _), (prefix, _) in wanted.items() if of == m}) for m in range(len(measures))]
    finally:
        values.unpersist()
    out: list[list[float | None]] = []
    for m, (_, at) in enumerate(measures):
        out.append([])
        for p in at:
            rank = p / 100 * (total[m] - 1)
            value = None
            if total[m]:
                low, high = (_double(wanted[m, r][0]) for r in (math.floor(rank), math.ceil(rank)))
                value = low if low == high else low + (high - low) * (rank - math.floor(rank))
            out[m].append(value)
    return total, out


def _size_measures() -> list[tuple[Column, tuple[float, ...]]]:
    speed = F.when(F.col("elapsed") == 1, F.col("displacement"))
    return [(F.lit(1.0), ()), (box_area(box()), AREA), (aspect_ratio(box()), ASPECT), (speed, SPEED)]


def _sizes(spark: SparkSession, n: list[int], found: list[list[float | None]]) -> DataFrame:
    return _row(spark, [_number(n[0], "n_boxes"), *_named("area", AREA, found[1]), *_named("aspect", ASPECT, found[2]), *_named("speed", SPEED, found[3])])


def _gap_measures() -> list[tuple[Column, tuple[float, ...]]]:
    """Over rows with ``_before``, the diagonal of the box before."""
    scale = F.greatest(box_diag(box()), F.col("_before"))
    near = (F.col("elapsed") > 1) & (scale > 0) & (F.col("displacement") <= 1.5 * scale)
    return [(F.when(near, (F.col("elapsed") - 1).cast("double")), (*GAP, 100))]


def _with_before(motion: DataFrame) -> DataFrame:
    return motion.withColumn("_before", F.lag(box_diag(box())).over(Window.partitionBy("cid", "track_id").orderBy("frame")))


def _gaps(spark: SparkSession, n: list[int], found: list[list[float | None]]) -> DataFrame:
    return _row(spark, [_number(n[0], "n_gaps"), _number(found[0][-1], "max_gap"), *_named("gap", GAP, found[0][:-1])])


def _static_measures() -> list[tuple[Column, tuple[float, ...]]]:
    """Over rows with ``_moving``."""
    steady = (F.col("elapsed") == 1) & F.col("_moving")
    return [(F.when(steady, F.lit(1.0)), ()), (F.when(steady, F.col("displacement")), STATIC)]


def _with_moving(motion: DataFrame, vio: DataFrame, config: Config) -> DataFrame:
    """Rows with ``_moving``: whether the camera does at their frames, as ``vio_at_frame`` has it."""
    moving = vio_angular_rate(vio).where(camera_moving(config)).select("cid", "idx").distinct().withColumn("_moving", F.lit(True))
    last = vio.groupBy("cid").agg(F.max("idx").alias("_last"))
    at = motion.join(last, "cid", "left").withColumn("idx", F.greatest(F.lit(0).cast("long"), F.least("frame", "_last")))
    return at.join(moving, ["cid", "idx"], "left").drop("idx", "_last").withColumn("_moving", F.coalesce("_moving", F.lit(False)))


def _static(spark: SparkSession, n: list[int], found: list[list[float | None]]) -> DataFrame:
    return _row(spark, [_number(n[0], "n_static"), *_named("static", STATIC, found[1])])


def size_shape_speed_stats(stable: DataFrame) -> DataFrame:
    """One row: number of boxes, percentiles of area, aspect, and speed between consecutive frames."""
    return _sizes(stable.sparkSession, *selected(track_motion(stable), _size_measures()))


def dropout_stats(stable: DataFrame) -> DataFrame:
    """One row: gaps that resume near where they began: number, percentiles of length, longest."""
    return _gaps(stable.sparkSession, *selected(_with_before(track_motion(stable)), _gap_measures()))


def track_stats(stable: DataFrame, vio: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``size_shape_speed_stats``, ``dropout_stats`` and ``static_motion_stats``, from the same passes over the tracks."""
    of = _size_measures(), _gap_measures(), _static_measures()
    n, found = selected(_with_moving(_with_before(track_motion(stable)), vio, config), [m for measures in of for m in measures])
    cuts = [0, len(of[0]), len(of[0]) + len(of[1]), len(n)]
    sizes, gaps, static = ((n[a:b], found[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    spark = stable.sparkSession
    return _sizes(spark, *sizes), _gaps(spark, *gaps), _static(spark, *static)


def raw_confidence_rank(detections: DataFrame) -> DataFrame:
    order = Window.partitionBy("cid", "frame").orderBy(F.desc("confidence"), "det_id")
    return detections.withColumn("confidence_rank", F.row_number().over(order).cast("long"))


def multibox_frames(detections: DataFrame, least: int = 3) -> DataFrame:
    """(cid, frame, n): frames with ``least`` boxes or more."""
    return detections.groupBy("cid", "frame").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def true_box_rank_match(detections: DataFrame, tracked: DataFrame) -> DataFrame:
    """(cid, frame, track_id, confidence_rank): in frames of many boxes, the rank of the first raw box that is just the
    box of one of the two strongest tracks."""
    top = top_tracks_per_frame(tracked).select("cid", "frame", "track_id", *_BOX)
    many = multibox_frames(detections).select("cid", "frame")
    ranked = raw_confidence_rank(detections).join(many, ["cid", "frame"], "left_semi").select("cid", "frame", *_BOX, "confidence_rank")
    return top.join(ranked, ["cid", "frame", *_BOX]).groupBy("cid", "frame", "track_id").agg(F.min("confidence_rank").alias("confidence_rank"))


def pool_width_stats(detections: DataFrame, tracked: DataFrame) -> DataFrame:
    """One row: number of ranks, their 95th percentile, and the width of the pool that follows."""
    ranks = true_box_rank_match(detections, tracked)
    n, found = selected(ranks, [(F.col("confidence_rank"), (95,))])
    return _row(detections.sparkSession, [_number(n[0], "n_ranks"), *_named("rank", (95,), found[0])]).select("n_ranks", "rank_p95", F.floor(F.greatest(F.lit(2.0), F.coalesce("rank_p95", F.lit(1.0)))).alias("pool_width"))


def camera_motion_stats(vio: DataFrame) -> DataFrame:
    rates = vio_angular_rate(vio)
    return percentiles_of(rates, [(F.col("speed"), "speed", MOTION), (F.col("ang_rate"), "ang_rate", MOTION)])


def static_motion_stats(stable: DataFrame, vio: DataFrame, config: Config) -> DataFrame:
    """One row: speeds between consecutive frames on stable tracks while the camera moves."""
    return _static(stable.sparkSession, *selected(_with_moving(track_motion(stable), vio, config), _static_measures()))


def stride_sample(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Of each clip's rows at most ``n``, evenly spaced in their order; rows of clips with ``n`` or fewer all stay."""
    placed = Window.partitionBy("cid").orderBy(*order)
    numbered = rows.withColumn("_i", F.row_number().over(placed) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cid")))
    # row i is one of floor(j * size / n), j = 0 .. n - 1
    j = F.ceil(F.col("_i") * n / F.col("_n"))
    hit = (F.floor(j * F.col("_n") / n) == F.col("_i")) & (j < n)
    return numbered.where((F.col("_n") <= n) | hit).drop("_i", "_n")


def label_disparity(disparity: DataFrame, tracked: DataFrame, detections: DataFrame, least_conf: float = 0.4, max_frames: int | None = 150) -> DataFrame:
    """Reliable disparities in frames of many boxes with ``is_wearer``: whether a box is one of the two strongest tracks'.
    Of a clip's frames ``max_frames`` count at most, all if it is None."""
    many = multibox_frames(detections)
    frames = (many if max_frames is None else stride_sample(many, max_frames, ["frame"])).select("cid", "frame")
    top = top_tracks_per_frame(tracked).select("cid", "frame", *_BOX).distinct().withColumn("is_wearer", F.lit(True))
    good = disparity.where(F.col("disp").isNotNull() & (F.col("match_conf") >= least_conf)).join(frames, ["cid", "frame"], "left_semi")
    return good.join(top, ["cid", "frame", *_BOX], "left").withColumn("is_wearer", F.coalesce("is_wearer", F.lit(False)))


def pick_disparity_threshold(labelled: DataFrame, least_accuracy: float = 0.68, steps: int = 200) -> DataFrame:
    """One row: the first of ``steps`` even thresholds that splits wearers (at or above it) from others best, its
    accuracy, both medians, and whether to trust it."""
    spark = labelled.sparkSession
    values = labelled.select("disp", "is_wearer").persist()
    wearer, one = F.col("is_wearer"), F.lit(1.0)
    n, found = selected(values, [(F.when(wearer, one), ()), (F.when(~wearer, one), ()), (F.when(wearer, F.col("disp")), (50,)), (F.when(~wearer, F.col("disp")), (50,)), (F.col("disp"), (0, 100))])
    numbers = [_number(n[0], "n_wearer"), _number(n[1], "n_bystander")]
    doubles = zip(("wearer_median", "bystander_median", "lo", "hi"), (found[2][0], found[3][0], *found[4]), strict=True)
    sides = _row(spark, [*numbers, *[F.lit(v).cast("double").alias(c) for c, v in doubles]])
    # each value counts in the first step at or below which thresholds leave it above
    at = values.crossJoin(F.broadcast(sides.select("lo", "hi")))
    width = (F.col("hi") - F.col("lo")) / (steps - 1)
    guess = F.when(width > 0, F.floor((F.col("disp") - F.col("lo")) / width)).otherwise(F.lit(steps - 1))

    def threshold(i: Column) -> Column:
        return F.when(i == steps - 1, F.col("hi")).otherwise(F.col("lo") + i * width)

    # the largest step whose threshold isn't above the value, rounding included
    step = F.array_max(F.filter(F.array(guess - 1, guess, guess + 1), lambda i: (i >= 0) & (i <= steps - 1) & (threshold(i) <= F.col("disp"))))
    counts = at.select(step.alias("step"), "is_wearer").groupBy("step").agg(F.count_if("is_wearer").alias("w"), F.count_if(~F.col("is_wearer")).alias("b"))
    counts = spark.createDataFrame(counts.collect(), counts.schema).coalesce(1)  # a row for each step
    values.unpersist()
    every = spark.range(0, steps, 1, 1).select(F.col("id").alias("step")).join(counts, "step", "left").fillna(0, ["w", "b"])
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # over 200 rows
    sums = every.select("step", F.coalesce(F.sum("w").over(below), F.lit(0)).alias("w_below"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("b_below")).crossJoin(F.broadcast(sides))
    right = F.col("n_wearer") - F.col("w_below") + F.col("b_below")
    best = sums.withColumn("accuracy", right / F.nullif(F.col("n_wearer") + F.col("n_bystander"), F.lit(0))).withColumn("threshold", F.when(F.col("step") == steps - 1, F.col("hi")).otherwise(F.col("lo") + F.col("step") * (F.col("hi") - F.col("lo")) / (steps - 1)))
    top = best.groupBy("n_wearer", "n_bystander", "wearer_median", "bystander_median").agg(F.max_by(F.struct("threshold", "accuracy"), F.struct("accuracy", -F.col("step"))).alias("t"))
    enough = (F.col("n_wearer") > 0) & (F.col("n_bystander") > 0)
    larger = F.col("wearer_median") > F.col("bystander_median")
    trusted = enough & larger & (F.col("t.accuracy") >= least_accuracy)
    reason = F.when(~enough, "insufficient samples").when(~larger, "wearers have no larger median disparity").when(F.col("t.accuracy") < least_accuracy, "accuracy too low")
    return top.select("n_wearer", "n_bystander", "wearer_median", "bystander_median", F.when(enough, F.col("t.threshold")).alias("threshold"), F.when(enough, F.col("t.accuracy")).alias("accuracy"), F.coalesce(trusted, F.lit(False)).alias("trusted"), reason.alias("reason"))


def derived(sizes: DataFrame, gaps: DataFrame, pool: DataFrame, camera: DataFrame, static: DataFrame, disparity: DataFrame) -> DataFrame:
    """One row with the thresholds that the statistics (one row each) lead to; null where there are none."""
    one = sizes.crossJoin(gaps).crossJoin(pool).crossJoin(camera.select(F.col("speed_p40").alias("cam_speed"), F.col("ang_rate_p40").alias("cam_ang"))).crossJoin(static).crossJoin(disparity.select("threshold", "trusted"))
    return one.select(
        (F.col("area_p1") * 0.5).alias("min_area_px2"),
        (F.col("area_p99_5") * 1.5).alias("max_area_px2"),
        F.when(F.col("aspect_p99").isNotNull(), F.greatest(F.lit(1.5), F.col("aspect_p99") * 1.1)).alias("max_aspect_ratio"),
        (F.col("speed_p99_5") * 1.2).alias("max_speed_px_per_frame"),
        F.when(F.col("n_gaps") > 0, F.greatest(F.lit(2).cast("long"), F.ceil("gap_p90"))).alias("max_dropout_frames"),
        F.col("pool_width").alias("candidate_pool_width"),
        F.col("cam_speed").alias("camera_speed_moving_thresh"),
        F.col("cam_ang").alias("camera_ang_moving_thresh_deg"),
        F.when(F.col("n_static") > 0, F.greatest(F.lit(1.0), F.col("static_p10"))).alias("static_motion_px_threshold"),
        F.col("trusted").alias("stereo_enabled"),
        F.when(F.col("trusted"), F.col("threshold")).alias("reach_disparity_threshold_px"),
    )


def config_from(row, base: Config | None = None) -> Config:
    """A configuration from a row of ``derived``: nulls keep what the base has, but for the reach threshold."""
    base = base or hands()
    found = {k: v for k, v in row.asDict().items() if v is not None}
    return base.but(**found, **({} if "reach_disparity_threshold_px" in found else {"reach_disparity_threshold_px": None}))


def no_disparity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "cid long, frame long, x1 double, y1 double, x2 double, y2 double, disp double, match_conf double")
