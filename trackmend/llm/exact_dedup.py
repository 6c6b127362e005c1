"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical without the characters space, tab, line feed, vertical tab, form feed and
carriage return.  Three aggregations find the row that stays, each with the whole normalised text among its keys, so a
digest alone never decides: Spark's partial aggregation combines the copies that a task holds, the first shuffle merges
groups of (digest, salt, text), the second merges the winners of the salts.  A group that holds a third of all rows
thus reaches any one task as a row for each task, or each salt, that saw it.

Only (key, digest) go on to learn their group; AQE splits that join where a digest is hot, as neither side has an
exchange of its own.  Should two texts ever share a SHA-256 digest, their rows are told apart by their texts.

Null texts count as empty, so all of them and all blank texts are one group.  Rows that are repeated under one key are
one row each in the result, of which one at most is kept.  Null keys rank behind all others.  An empty table gives an
empty result; columns besides key and text are ignored, whatever they are called.  Keys are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmend.llm._shared import fresh, stored

WHITE = " \t\n\x0b\x0c\r"
_SPAN = "18446744073709551616"  # 2**64: room for a key below the length
_LAST = "9223372036854775807"


def _rank(length: Column, key: Column) -> Column:
    """A number that is larger for a longer text, then for a smaller key: unlike a struct it fits an aggregation buffer
    that is updated in place, so no text has to be sorted."""
    key = F.coalesce(key.cast("long"), F.lit(_LAST).cast("long"))
    return (length.cast("decimal(10,0)") * F.lit(_SPAN).cast("decimal(20,0)") + (F.lit(_LAST).cast("decimal(20,0)") - key.cast("decimal(20,0)"))).cast("decimal(38,0)")


def exact_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """(digest, text, best, group_size): one row for each distinct normalised text."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(key).cast("long").alias("key"), F.length(raw).alias("length"), F.translate(raw, WHITE, "").alias("text"))
    rows = rows.select("text", F.unhex(F.sha2("text", 256)).alias("digest"), _rank(F.col("length"), F.col("key")).alias("best"), F.pmod(F.xxhash64("key", "length"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))


def exact_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row for each row of ``documents``.

    ``keep_id`` is the key of the row that stays of its group: most code points in the original text, then smallest key.
    """
    groups = exact_groups(documents, key, text, salts)
    # a text is needed below only where its digest has another one too
    spread = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("best").alias("best"), F.max("group_size").alias("group_size"))
    spread = stored(spread, "exact-groups")

    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = documents.select(F.col(key).cast("long").alias("key"), F.length(raw).alias("length"), F.translate(raw, WHITE, "").alias("norm"))
    source = source.select("key", "length", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"))

    def members(rows: DataFrame, *more: str) -> DataFrame:
        """Rows repeated under one key are counted first; the count is dealt out again at the end."""
        return rows.groupBy("key", "length", "digest", *more).agg(F.count(F.lit(1)).alias("copies"))

    alone = members(source).join(spread.where("texts = 1").select("digest", "best", "group_size"), "digest")
    if not spread.where("texts > 1").isEmpty():
        shared = spread.where("texts > 1").select("digest")
        apart = groups.join(shared, "digest", "left_semi")
        both = members(source.join(shared, "digest", "left_semi"), "norm").join(apart.withColumnRenamed("text", "norm"), ["digest", "norm"])
        alone = alone.unionByName(both.select(alone.columns))
    keep = F.lit(_LAST).cast("decimal(20,0)") - (F.col("best") % F.lit(_SPAN).cast("decimal(20,0)"))
    out = alone.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        F.col("key").alias(key),
        F.when(keep < F.lit(_LAST).cast("decimal(20,0)"), keep.cast("long")).alias("keep_id"),
        "group_size",
        ((F.col("best") == _rank(F.col("length"), F.col("key"))) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows repeated under one key, one."""
    found = exact_duplicates(documents, key, text)
    mark, of, kept, n, row = (fresh(documents, c) for c in ("_key", "_digest", "_kept", "_n", "_row"))
    marks = found.groupBy(F.col(key).alias(mark), F.col("text_sha256").alias(of)).agg(F.max("kept").alias(kept), F.count(F.lit(1)).alias(n))
    marks = stored(marks.where(~F.col(kept) | (F.col(n) > 1)), "exact-marks")
    digest = F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE, ""), 256)
    marked = documents.join(marks, F.col(key).eqNullSafe(F.col(mark)) & (digest == F.col(of)), "left").where(F.col(kept).isNull() | F.col(kept))
    order = [F.desc(F.length(text)), *[F.col(c).cast("string") for c in documents.columns]]
    one = marked.where(F.col(n) > 1).withColumn(row, F.row_number().over(Window.partitionBy(mark, of).orderBy(*order))).where(F.col(row) == 1)
    return marked.where(F.col(n).isNull()).select(documents.columns).unionByName(one.select(documents.columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
