"""Counts over the output, and the proof that every input box is accounted for once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(finalized: DataFrame) -> DataFrame:
    return finalized.groupBy("cid", "status").agg(F.count(F.lit(1)).alias("n"))


def reject_stage_counts(finalized: DataFrame) -> DataFrame:
    """Counts by clip and stage, with the sums over stages, clips and both (null)."""
    return finalized.where("reject_stage is not null").rollup("cid", "reject_stage").agg(F.count(F.lit(1)).alias("n"))


def completeness_check(detections: DataFrame, finalized: DataFrame) -> DataFrame:
    """(cid, det_id, in_input, n_output) of every box of the input or output."""
    seen = finalized.select("cid", F.explode("source_ids").alias("det_id")).groupBy("cid", "det_id").agg(F.count(F.lit(1)).alias("n"))
    both = detections.select("cid", "det_id", F.lit(True).alias("raw")).join(seen, ["cid", "det_id"], "full")
    return both.select("cid", "det_id", F.coalesce("raw", F.lit(False)).alias("in_input"), F.coalesce("n", F.lit(0)).alias("n_output"))


def completeness_summary(checked: DataFrame) -> DataFrame:
    """(cid, total_raw, accounted, missing, n_duplicated, ok)."""
    sums = checked.groupBy("cid").agg(F.count_if("in_input").alias("total_raw"), F.count_if(F.col("n_output") > 0).alias("accounted"), F.count_if(F.col("n_output") > 1).alias("n_duplicated"))
    missing = F.col("total_raw") - F.col("accounted")
    return sums.select("cid", "total_raw", "accounted", missing.alias("missing"), "n_duplicated", ((missing == 0) & (F.col("n_duplicated") == 0)).alias("ok"))


def account(detections: DataFrame, finalized: DataFrame, statuses: list[str]) -> DataFrame:
    """``completeness_summary`` with the counts of the output rows by status, from one pass over the output."""
    raw = detections.select("cid", "det_id", F.lit(None).cast("string").alias("status"), F.lit(True).alias("raw"))
    # an output row without boxes behind it is a row all the same, its place null
    behind = finalized.select("cid", "status", F.posexplode_outer("source_ids").alias("place", "det_id"))
    rows = raw.withColumn("place", F.lit(None).cast("int")).unionByName(behind.withColumn("raw", F.lit(False)))
    first = ~F.col("raw") & (F.coalesce("place", F.lit(0)) == 0)
    found = [F.count_if(first & (F.col("status") == s)).alias(s) for s in statuses]
    # boxes apart from rows without any
    each = rows.groupBy("cid", "det_id", (F.col("raw") | F.col("place").isNotNull()).alias("boxed")).agg(F.count_if("raw").alias("r"), F.count("place").alias("n"), *found)
    times = F.when(F.col("boxed"), F.greatest("r", F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))
    sums = each.groupBy("cid").agg(
        F.sum("r").alias("total_raw"), F.coalesce(F.sum(F.when(F.col("n") > 0, times)), F.lit(0).cast("long")).alias("accounted"), F.coalesce(F.sum(F.when(F.col("n") > 1, times)), F.lit(0).cast("long")).alias("n_duplicated"), *[F.sum(s).alias(s) for s in statuses]
    )
    missing = F.col("total_raw") - F.col("accounted")
    return sums.select("cid", "total_raw", "accounted", missing.alias("missing"), "n_duplicated", ((missing == 0) & (F.col("n_duplicated") == 0)).alias("ok"), *statuses)


def sort_finalized(finalized: DataFrame) -> DataFrame:
    """By clip and frame within partitions of whole clips."""
    return finalized.repartition("cid").sortWithinPartitions("cid", "frame", "status", "track_id", "x1")
