"""Token counts by a two-tier look-up on the map side.

Tier one is a compact broadcast table, segment to number of tokens, of the segments that are most frequent in the
whole input.  It has a fixed number of entries: every task counts all its segments and passes on a summary of bounded
size.  Tier two is a cache in each worker, filled by the tokenizer with what the table lacks.  Texts are counted where
they are read; neither they nor their segments are shuffled.

Null texts count as empty (0 tokens); rows with a null key, repeated rows and an empty table give as many rows as they
have.  Columns other than the key and the text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmend.llm._shared import slices, text_column
from trackmend.llm.segments import LONGEST_KEY, Cut, encoder

#: Distinct segments that a task counts before it drops those seen once, and segments that it passes on.
COUNTED, SUMMARY = 500_000, 2048


def frequent_segments(documents: DataFrame, text: str = "text", entries: int = 65_536) -> DataFrame:
    """(segment, n): the most frequent segments of the whole input by merged task summaries, ``entries`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                cut = Cut(text_column(part, "text"))
                seen.update(dict(zip(cut.distinct, np.bincount(cut.index, minlength=len(cut.distinct)).tolist(), strict=True)))
                if len(seen) > COUNTED:
                    seen = Counter({k: n for k, n in seen.items() if n > 1})
                    if len(seen) > COUNTED:
                        seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = [(k, n) for k, n in seen.most_common(SUMMARY) if 0 < len(k) <= LONGEST_KEY]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["segment", "n"])

    found = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "segment string, n long")
    return found.groupBy("segment").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "segment").limit(entries)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512, entries: int = 65_536) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row: UTF-8 bytes, tokens of the whole text without added special
    tokens, and whether there are more than ``limit``."""
    spark = documents.sparkSession
    frequent = [r.segment for r in frequent_segments(documents, text, entries).collect()]  # a fixed number of rows
    lengths = {part: len(ids) // 4 for part, ids in zip(frequent, encoder(vocabulary).encode(frequent), strict=True)}
    tier_one = spark.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, coder = tier_one.value, encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = text_column(part, "text")
                n = pa.array(coder.counts(texts, first), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n, pc.greater(n, limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    source = documents.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
