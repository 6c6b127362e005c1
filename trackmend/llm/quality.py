"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks, and each block is compressed with either dictionary.  The difference of the sizes, divided
by the bytes of the text, says which kind of text it continues better; the smaller size itself, divided by those bytes,
tells text that repeats itself.  A logistic model turns the two into a probability.

The fit reads ``per_class`` labelled keys of each class at most.  The blocks of one half train the dictionaries, of
``DICTIONARY`` bytes at most; only ``train_bytes`` of them, picked over all blocks by a hash, go to the driver for each
class.  The other half calibrates, each key by the mean of its rows.  Scoring reads whole texts, where they lie, without
a shuffle.

Empty and null texts get the score of the features (0, 0).  Without labelled rows of one class the score is the share
of the other.  Null keys aren't held out.  Other columns, ``lang`` and ``source`` among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmend.llm._labelled import Logistic, fit, held_out, training_sample
from trackmend.llm._shared import drop_caches, slices, text_column

BLOCK, LEVEL, DICTIONARY = 1024, 3, 256 << 10


def _blocks(data: bytes) -> list[bytes]:
    return [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for text like the blocks ``samples``; of blocks too few to train one, themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text, which then is below DICTIONARY as well
        return b"".join(samples)[-DICTIONARY:]


class Compressors:
    """A compressor for each dictionary."""

    def __init__(self, bad: bytes, good: bytes):
        import zstandard

        self.each = []
        for data in (bad, good):
            known = None
            if len(data) >= 8:
                known = zstandard.ZstdCompressionDict(data)
                known.precompute_compress(LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def features(self, text: str) -> tuple[float, float]:
        data = text.encode()
        if not data:
            return 0.0, 0.0
        blocks = _blocks(data)
        bad, good = (sum(len(f(b)) for b in blocks) for f in self.each)
        return (bad - good) / len(data), min(bad, good) / len(data)


@dataclass(frozen=True)
class QualityModel:
    bad: bytes
    good: bytes
    calibration: Logistic


def fit_quality(documents: DataFrame, labels: DataFrame, per_class: int = 1600, train_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Learns from ``per_class`` labelled keys of each class at most, and dictionaries from about ``train_bytes`` of each."""
    spark = documents.sparkSession
    sample, sizes = training_sample(labels, label, per_class, key)
    source = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = source.join(F.broadcast(sample), "key")  # 2 * per_class rows
    train = rows.where("part < 0.5")
    held = {r.y: r.bytes for r in train.groupBy("y").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}  # two rows
    shares = {y: min(1.0, train_bytes / max(1, n)) for y, n in held.items()}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), text_column(batch, "text").to_pylist(), strict=True):
                some = [b for b in _blocks(t.encode()) if xxhash.xxh3_64_intdigest(b) < shares[y] * 2.0**64]
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(some), pa.int32()), pa.array(some, pa.binary())], ["y", "block"])

    # blocks that are alike count once, so copies don't fill the share
    found = sorted((r.y, bytes(r.block)) for r in train.select("y", "text").mapInArrow(blocks, "y int, block binary").distinct().collect())
    bad, good = (dictionary([b for y, b in found if y == of]) for of in (0, 1))
    known = spark.sparkContext.broadcast((bad, good))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        compress = Compressors(*known.value)
        for batch in batches:
            f = [compress.features(t) for t in text_column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in f], pa.float64()), pa.array([x for _, x in f], pa.float64())], ["y", "k", "a", "b"])

    source = rows.where("part >= 0.5").select("y", F.xxhash64("key").alias("k"), "text")
    measured = source.mapInArrow(features, "y int, k long, a double, b double").groupBy("y", "k").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    found = sorted((r.y, r.a, r.b) for r in measured.collect())  # 2 * per_class rows
    return QualityModel(bad, good, fit(np.array([[a, b] for _, a, b in found]).reshape(-1, 2), np.array([y for y, _, _ in found]), sizes))


def score_quality(documents: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row: score is the probability that the label is 1."""
    known = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        compress = Compressors(known.value.bad, known.value.good)
        for batch in batches:
            for part in slices(batch, "text"):
                p = known.value.calibration(np.array([compress.features(t) for t in text_column(part, "text").to_pylist()]).reshape(-1, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [key, "held_out", "score", "predicted"])

    source = documents.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(score, f"`{key}` {source.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows whose score is 0.5 or more, with all their columns, in one pass over them."""
    known = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        compress = Compressors(known.value.bad, known.value.good)
        for batch in batches:
            for part in slices(batch, text):
                p = known.value.calibration(np.array([compress.features(t) for t in text_column(part, text).to_pylist()]).reshape(-1, 2))
                yield part.filter(pa.array(p >= 0.5))

    return documents.mapInArrow(keep, documents.schema)
