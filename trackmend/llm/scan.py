"""Running sums within groups of any size, in two levels.

Rows are dealt out by ranges of (group, order), so a group that holds a third of all rows lies in a third of the tasks.
Each range sums its own rows; the sums of the ranges, one row for each range of a group, are summed up in turn and
handed back.  No task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmend.llm._shared import Scratch

_PART = 33  # bits of monotonically_increasing_id below the number of the range


def running(rows: DataFrame, group: str, order: list[str | Column], value: str | None, scratch: Scratch) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` over the rows of the group that stand before, and ``total``, that
    over the whole group.  Without a value rows are counted.

    ``group`` has no nulls; nulls in ``order`` stand first.  Rows that tie in ``order`` stand in any order, the same
    one for all who read the result.  ``rows`` are read twice (to choose the ranges, then to deal them out), so they
    should be a stored table.  The columns ``at``, ``part``, ``before`` and ``total`` are taken.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    # ranges are chosen anew by each run of a plan: they are written down once
    dealt = scratch.stored(dealt.withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("at", _PART))
    sums = dealt.groupBy(group, "part").agg((F.sum(value) if value else F.count(F.lit(1))).alias("s"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    earlier = F.sum("s").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(group, "part", "first", F.coalesce(earlier, F.lit(0)).alias("earlier"), F.sum("s").over(whole).alias("total"))
    if value:
        inside = Window.partitionBy(group, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        place = F.col("inside")
    else:
        place = F.col("at") - F.col("first")  # rows of a group stand together in their range
    found = dealt.join(sums, [group, "part"]).withColumn("before", F.col("earlier") + place)
    return found.select(*rows.columns, "before", "total")
