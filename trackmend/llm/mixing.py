"""Mixing sources to target weights by systematic sampling.

The words of all documents are shared out among the sources by weight.  A source whose share passes ``MOST`` times its
own words is held there, and what it leaves is shared among the others, until none is above.  A document's expected
copies are its source's target by its source's words.  They are summed up within the source, from the shortest document
to the longest; one random offset for each source is added; and a document is emitted once for each integer that the
sum crosses on it.  As sizes only grow along the way, a source's taken words differ from its target by less than the
words of its longest document, whatever the offset.

All numbers are exact integers and fractions, so that reruns agree and no document is emitted more than ``MOST`` times.
The sum runs in two levels (``scan``), so that a source with a third of all rows is in no one task.  The water level of
the shares takes a few aggregates over one row for each source.

Null texts and texts without words have size 0 and are taken with 0 words; where no text has words, all targets are 0.
A null source is a source of its own, the last one.  Null and repeated keys are rows of their own.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmend.llm._shared import Scratch, fresh, stored
from trackmend.llm.scan import running

WEIGHTS, MOST = (5, 2, 1), 3
#: Offsets are multiples of one in so many.
GRAIN = 1 << 16
_WHOLE = "decimal(38,0)"
_LAST = "t"


def word_count(text: Column) -> Column:
    """Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _group(source: str) -> Column:
    """Text that sorts as the sources do byte by byte, null last."""
    return F.when(F.col(source).isNull(), F.lit(_LAST)).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def offset(group: Column, seed: int) -> Column:
    """A number from 0 to GRAIN - 1 for each source, drawn by a hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), group).cast("binary"), 256), 1, 4), 16, 10).cast(_WHOLE)


def source_targets(rows: DataFrame, weights: tuple[int, ...], most: int, scratch: Scratch) -> DataFrame:
    """(g, source_size, target, p, q): the target of each source, and p / q copies expected of each of its documents."""
    sources = rows.groupBy("g").agg(F.sum("size").cast(_WHOLE).alias("source_size"))
    sources = scratch.stored(sources.withColumn("all", F.lit(0)), "sources")
    ranked = running(sources, "all", ["g"], None, scratch)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("before", F.lit(len(weights))) + 1).cast("int"))
    ranked = scratch.stored(ranked.select("g", "source_size", weight.cast(_WHOLE).alias("w")), "weights")
    top = F.lit(most) * F.col("source_size")
    left, weighs, held = None, 1, None
    while True:
        # a share of one weight is left / weighs; it only grows from round to round
        above = F.lit(False) if left is None else top * F.lit(weighs).cast(_WHOLE) < F.col("w") * F.lit(left).cast(_WHOLE)
        sums = ranked.agg(F.sum("source_size").alias("total"), F.sum(F.when(above, top)).alias("capped"), F.sum(F.when(~above, F.col("w"))).alias("weighs"), F.count(F.when(above, 1)).alias("held")).first()
        if sums.total is None or sums.held == held or not sums.weighs:
            break
        held, left, weighs = sums.held, int(sums.total) - int(sums.capped or 0), int(sums.weighs)
    left, weighs = F.lit(left or 0).cast(_WHOLE), F.lit(weighs).cast(_WHOLE)
    above = top * weighs < F.col("w") * left
    share = (F.col("w") * left).cast("double") / weighs.cast("double")
    empty = F.col("source_size") == 0
    return ranked.select(
        "g",
        "source_size",
        F.when(above, top.cast("double")).otherwise(share).alias("target"),
        F.when(empty, 0).when(above, most).otherwise(F.col("w") * left).cast(_WHOLE).alias("p"),
        F.when(empty | above, 1).otherwise(weighs * F.col("source_size")).cast(_WHOLE).alias("q"),
    )


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken, copies) for each row: words of the text, of its source, those wanted of
    its source, those that the mix takes of it, and how often it is emitted."""
    scratch = Scratch(documents.sparkSession)
    rows = scratch.stored(documents.select(F.col(key).alias("key"), _group(source).alias("g"), word_count(F.col(text)).alias("size")), "sizes")
    targets = scratch.stored(source_targets(rows, weights, most, scratch), "targets")
    # one row for each source; Spark broadcasts it where it is small and splits a hot source where it isn't
    expected = scratch.stored(rows.join(targets, "g"), "expected")
    placed = running(expected, "g", ["size", "key"], "p", scratch)

    def crossed(reached: Column) -> Column:
        """Integers passed when the sum of expected copies, in units of 1 / q, has come this far."""
        return F.call_function("div", F.lit(GRAIN).cast(_WHOLE) * reached + offset(F.col("g"), seed) * F.col("q"), F.lit(GRAIN).cast(_WHOLE) * F.col("q"))

    before = F.col("before").cast(_WHOLE)
    copies = crossed((before + F.col("p")).cast(_WHOLE)) - crossed(before)
    found = placed.select(F.col("key").alias(key), "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), F.col("g"))
    return found.select(key, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixture(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``documents`` with all their columns, each as often as it is emitted.

    Rows of one key and size are given the copies of that key and size in the order of their texts."""
    words, place, times, of, size, spot, n = (fresh(documents, c) for c in ("_size", "_place", "_copies", "_key", "_of_size", "_spot", "_n"))
    plan = mix(documents, weights, most, seed, key, text, source)
    plan = stored(plan.select(F.col(key).alias(of), F.col("size").alias(size), "target", F.col("copies").alias(times)), "mix")
    plan = plan.withColumn(spot, F.row_number().over(Window.partitionBy(of, size).orderBy("target", times))).where(F.col(times) > 0).drop("target")
    rows = documents.withColumn(words, word_count(F.col(text)))
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(key, words).orderBy(source, text)))
    met = rows.join(plan, F.col(key).eqNullSafe(F.col(of)) & (F.col(words) == F.col(size)) & (F.col(place) == F.col(spot)))
    return met.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(documents.columns)


def _oracle(seed: int = 0, rounds: int = 12) -> str:
    """SQL with the rounds of the water level one after another; each changes nothing once none is above."""
    levels = "l0 AS (SELECT CAST(-1 AS HUGEINT) AS r, CAST(1 AS HUGEINT) AS ws)"
    for k in range(rounds):
        levels += f""",
l{k + 1} AS (SELECT CAST(sum(source_size) - coalesce(sum(CASE WHEN {MOST} * source_size * ws < w * r THEN {MOST} * source_size END), 0) AS HUGEINT) AS r,
  CAST(coalesce(sum(CASE WHEN {MOST} * source_size * ws < w * r THEN 0 ELSE w END), 1) AS HUGEINT) AS ws FROM s, l{k})"""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    digits = f"sha256('{seed}:' || g)"
    number = " + ".join(f"(strpos('0123456789abcdef', {digits}[{i + 1}]) - 1) * {16 ** (3 - i)}" for i in range(4))
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '{_LAST}' ELSE 's' || source END AS g, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT g, CAST(sum(size) AS HUGEINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY g) - 1) % {len(WEIGHTS)} {weight} END AS HUGEINT) AS w FROM d GROUP BY g
), {levels},
t AS (
  SELECT g, source_size, {MOST} * source_size * ws < w * r AS above, source_size = 0 AS no_words,
    CASE WHEN above THEN CAST({MOST} * source_size AS DOUBLE) ELSE CAST(w * r AS DOUBLE) / CAST(ws AS DOUBLE) END AS target,
    CAST(CASE WHEN no_words THEN 0 WHEN above THEN {MOST} ELSE w * r END AS HUGEINT) AS p,
    CAST(CASE WHEN no_words OR above THEN 1 ELSE ws * source_size END AS HUGEINT) AS q,
    CAST({number} AS HUGEINT) AS u FROM s, l{rounds}
), c AS (
  SELECT doc_id, size, source_size, target, p, q, u, CAST(row_number() OVER (PARTITION BY g ORDER BY size, doc_id NULLS FIRST) AS HUGEINT) AS k FROM d JOIN t USING (g)
), e AS (
  SELECT *, CAST(({GRAIN} * k * p + u * q) // ({GRAIN} * q) - ({GRAIN} * (k - 1) * p + u * q) // ({GRAIN} * q) AS BIGINT) AS copies FROM c
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, size * copies AS taken, copies FROM e
"""


ORACLE_SQL = _oracle()
