"""Steps of a job that are written to a folder which driver and executors share, and read again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table is deleted as soon as it is written.  Spark would else keep it until the driver's
    memory runs short.  Nothing that is kept with ``persist()`` may be read inside."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, True)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def stored(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written to ``path`` and read again: what they were made from isn't held any more."""
    spark = rows.sparkSession
    with tidied(spark):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
