"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmend.operators.audit import account, sort_finalized


def write_corrected(finalized: DataFrame, path: str, form: str = "parquet") -> None:
    """Rows by clip and frame.  Parquet files hold many clips each; JSON has a folder for each clip."""
    rows = sort_finalized(finalized)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("cid").json(path) if form == "json" else writer.parquet(path))


def replace_corrected(finalized: DataFrame, path: str) -> None:
    """The JSON form again for the clips of ``finalized``: their folders are replaced as the write commits, those of all
    other clips stay as they are."""
    sort_finalized(finalized).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cid").json(path)


def corrected_documents(finalized: DataFrame) -> DataFrame:
    """(cid, detections): one document for each clip, ordered by frame."""
    row = F.struct("frame", "x1", "y1", "x2", "y2", "status", "confidence", "track_id", "reject_stage", "source_ids")
    return finalized.groupBy("cid").agg(F.sort_array(F.collect_list(row)).alias("detections"))


def run_summary(detections: DataFrame, finalized: DataFrame) -> DataFrame:
    """Per clip: counts by status, and the account of its boxes."""
    return account(detections, finalized, ["reported", "merged", "rejected", "interpolated"])


def write_run_summary(detections: DataFrame, finalized: DataFrame, path: str) -> None:
    run_summary(detections, finalized).write.mode("overwrite").json(path)


def replace_run_summary(detections: DataFrame, finalized: DataFrame, path: str, staging: str) -> None:
    """The summary again for the clips of ``detections``; the rows of all other clips stay as they are.

    The merged rows are written to ``staging``, a folder that all executors share, before they take the place of the old
    ones: a job that fails on the way has lost nothing.
    """
    new = run_summary(detections, finalized)
    spark = detections.sparkSession
    old = spark.read.schema(new.schema).json(path)
    old.join(new.select("cid"), "cid", "left_anti").unionByName(new).write.mode("overwrite").json(staging)
    spark.read.schema(new.schema).json(staging).write.mode("overwrite").json(path)


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each report."""
    for name, rows in reports.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
