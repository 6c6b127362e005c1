"""Validating a corrected corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmend.config import Config
from trackmend.operators import validation as v
from trackmend.operators.audit import status_counts
from trackmend.operators.merge import merge_duplicates
from trackmend.operators.tracking import build_loose_tracks, link_loose, stable_tracks
from trackmend.plans.correct import finish, finish_accepted, stage_survivor_ids, staged, staged_candidates
from trackmend.sources.staging import drop, stored

_BOX = ["x1", "y1", "x2", "y2"]


def validate_corpus(
    detections: DataFrame, frames: DataFrame, vio: DataFrame, clips: DataFrame, config: Config, stable_frames: int = 30, loose: Config | None = None, hidden: tuple[int, ...] | None = None, per_length: int = 15, only: str | None = None, scratch: str | None = None
) -> dict[str, DataFrame]:
    """The reports by name, or ``only`` one.  ``hidden`` are the numbers of frames that the synthetic dropouts hide, by
    default from two up to beyond what is filled; ``loose`` has other gates for the tracks that stand for the truth.

    What several reports read is kept with ``persist()``.  With ``scratch``, a new folder that driver and executors share,
    it is written there instead, step by step, and what was shuffled for a step goes with it: the disk holds one step's
    shuffles and the few columns that reports read.  The reports read the folder; ``drop`` it after them.  A report by
    itself keeps nothing: it reads its steps once.
    """
    kept = (lambda rows: rows) if only else (lambda rows: rows.persist())
    if scratch and not only:
        rows, stable = _written(detections, frames, vio, clips, config, loose or config.loose(), stable_frames, scratch)
        finalized, candidates = rows.select("cid", "frame", *_BOX, "status"), rows.where("status <> 'interpolated'")
    else:
        rows = candidates = kept(staged(detections, frames, vio, config))
        # without the columns that no report asks for
        finalized = kept(finish(rows, clips, config).select("cid", "frame", *_BOX, "status"))
        stable = stable_tracks(kept(build_loose_tracks(detections, frames, config, loose)), stable_frames)
    most = int(config.max_dropout_frames)
    lengths = list(hidden or sorted({2, 5, 10, most, most + 10, 2 * most}))

    def proxies() -> DataFrame:
        return v.proxy_precision_recall(detections, stage_survivor_ids(candidates), v.real_ids(stable))

    def dropouts() -> DataFrame:
        # dropouts are hidden in what the correction selects; the draw and the trials both read it
        selected = (rows.persist() if only else candidates).where("reject_stage is null")
        if scratch and not only:
            selected = selected.withColumn("track_id", F.col("candidate_track")).drop("candidate_track")
        return v.synthetic_dropout_summary(v.synthetic_dropout_eval(selected, clips, config, v.dropout_trials(selected, lengths, per_length)))

    shared = None if only else stored(proxies(), f"{scratch}/proxies") if scratch else proxies().persist()
    reports = {
        "status_counts": lambda: status_counts(finalized),
        "proxy_precision_recall": lambda: proxies() if only else shared,
        "stage_summary": lambda: v.stage_summary(proxies() if only else shared),
        "frame_coverage_recall": lambda: v.frame_coverage_recall(v.frame_coverage(stable, finish_accepted(rows, clips, config) if only else finalized)),
        "multibox_resolution": lambda: v.multibox_resolution(detections, finish_accepted(rows, clips, config) if only else finalized, clips),
        "synthetic_dropout": dropouts,
        "interpolation_rate": lambda: v.flag_interpolation_outliers(v.interpolation_rate(finalized, clips)),
    }
    return {name: report() for name, report in reports.items() if only in (None, name)}


def in_one_table(reports: dict[str, DataFrame]) -> DataFrame:
    """(report, cid, item, measure, value): a row for each number of each report.  ``item`` is the status, the stage or the
    length that it is of; ``cid`` is null where it is of all clips."""
    parts = []
    for name, rows in reports.items():
        keys = [c for c in ("status", "stage", "k") if c in rows.columns]
        cid, item = (F.col(c) if c in rows.columns else F.lit(None) for c in ("cid", *(keys or [""])))
        each = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in rows.columns if c not in ("cid", *keys)]
        parts.append(rows.select(F.lit(name).alias("report"), cid.alias("cid"), item.cast("string").alias("item"), F.explode(F.array(*each)).alias("m")).select("report", "cid", "item", "m.measure", "m.value"))
    return reduce(DataFrame.unionByName, parts)


def _written(detections: DataFrame, frames: DataFrame, vio: DataFrame, clips: DataFrame, config: Config, loose: Config, stable_frames: int, scratch: str) -> tuple[DataFrame, DataFrame]:
    """(the output rows with the tracks that candidates had before gaps split them, stable loose tracks), as tables."""
    merged = stored(merge_duplicates(detections, config), f"{scratch}/merged")
    rows = staged_candidates(merged, frames, vio, config).withColumn("candidate_track", F.col("track_id"))
    output = finish(rows, clips, config, ("candidate_track", "track_ord")).select("cid", "frame", *_BOX, "status", "reject_stage", "source_ids", "candidate_track", "track_ord")
    output = stored(output, f"{scratch}/output")
    same = loose.duplicate_overlap_threshold == config.duplicate_overlap_threshold
    tracks = link_loose(merged if same else merge_duplicates(detections, loose), frames, loose)
    stable = stored(stable_tracks(tracks, stable_frames).select("cid", "frame", "track_id", *_BOX, "source_ids"), f"{scratch}/stable")
    drop(detections.sparkSession, f"{scratch}/merged")
    return output, stable
