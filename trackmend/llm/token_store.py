"""Token ids in grammar-compressed shards (Re-Pair), stored as Parquet rows and read back exactly.

Documents are dealt into ranges of ascending key.  Each task encodes its texts, appends an end id to each and closes a
shard whenever it holds ``shard_tokens`` ids.  In a shard, frequent pairs of neighbouring symbols are replaced by new
symbols again and again; a round replaces all pairs whose count is near the highest one, so a few sorts of the shard
suffice.  A shard is one row of the file:

    part, seq            place in the key order: range, then number within it
    part_start           ids of the same range before this shard
    n_tokens             ids in the shard, n_base: ids of the vocabulary (symbols from there on are rules)
    keys, lengths        key and number of ids of each document
    left, right          the two symbols of each rule, unsigned 16-bit little-endian
    expansion            ids that each rule stands for, unsigned 32-bit little-endian
    body                 the remaining symbols, unsigned 16-bit little-endian

The expansion lengths make random access possible: their running sum over the body finds the symbols of any document
without decoding the rest (``decode_document``).

Null texts are encoded as empty: the end id alone.  Rows with a null key come first, repeated keys stand side by side
in the order of their texts.  An empty table gives no shards and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmend.llm._shared import slices, text_column
from trackmend.llm.segments import encoder

SYMBOLS = 1 << 16  # what an unsigned 16-bit symbol can name
SHARD_SCHEMA = "part int, seq int, part_start long, n_tokens long, n_base int, keys array<{key}>, lengths array<int>, left binary, right binary, expansion binary, body binary"


def compress(ids: np.ndarray, n_base: int, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(body, left, right, expansion lengths) of ids below ``n_base``, which leaves room for rules below 2**16."""
    seq = ids.astype(np.uint16)
    left, right, expansion = np.zeros(0, np.uint16), np.zeros(0, np.uint16), np.zeros(0, np.uint32)
    while True:  # each round shortens the sequence
        room = SYMBOLS - n_base - len(left)
        if room <= 0 or len(seq) < 2 * least:
            break
        bits = int(len(seq)).bit_length()
        pairs = ((seq[:-1].astype(np.uint64) << np.uint64(16)) | seq[1:]) << np.uint64(bits)
        placed = np.sort(pairs | np.arange(len(pairs), dtype=np.uint64))  # pair and place in one number
        ordered = placed >> np.uint64(bits)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(starts, len(ordered)))
        if counts.max() < least:
            break
        often = np.flatnonzero(counts >= max(least, counts.max() // 16))
        best = np.sort(often[np.argsort(-counts[often], kind="stable")][:room])
        rule = np.full(len(counts), -1, np.int32)
        rule[best] = np.arange(len(best))
        rule = np.repeat(rule, counts)
        chosen = np.flatnonzero(rule >= 0)
        at = np.sort((placed[chosen] & np.uint64((1 << bits) - 1)) << np.uint64(16) | rule[chosen].astype(np.uint64))
        at, rule = (at >> np.uint64(16)).astype(np.int64), (at & np.uint64(0xFFFF)).astype(np.int64)
        # of overlapping places in a row, every other one from the left
        first = np.concatenate(([True], at[1:] != at[:-1] + 1))
        begun = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - begun) % 2 == 0
        at, rule = at[keep], rule[keep]
        used = np.bincount(rule, minlength=len(best)) > 0
        number = np.cumsum(used) - 1
        pair = ordered[starts[best[used]]]
        a, b = (pair >> np.uint64(16)).astype(np.uint16), (pair & np.uint64(0xFFFF)).astype(np.uint16)
        long = np.concatenate((np.ones(n_base, np.uint32), expansion))
        seq[at] = (n_base + len(left) + number[rule]).astype(np.uint16)
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        left, right, expansion = np.append(left, a), np.append(right, b), np.append(expansion, long[a] + long[b])
    return seq, left, right, expansion


def _unfold(seq: np.ndarray, left: np.ndarray, right: np.ndarray, n_base: int) -> np.ndarray:
    """Replaces rules by their two symbols until none is left."""
    seq = seq.astype(np.int64)
    while (rule := seq >= n_base).any():
        at = np.repeat(np.arange(len(seq)), rule + 1)
        second = np.concatenate(([False], at[1:] == at[:-1]))
        of, split = seq[at], rule[at]
        which = np.where(split, of - n_base, 0)
        seq = np.where(split, np.where(second, right[which], left[which]), of)
    return seq


def expand(body: np.ndarray, left: np.ndarray, right: np.ndarray, expansion: np.ndarray, n_base: int) -> np.ndarray:
    """The ids that ``body`` stands for: all rules are written out once, then looked up."""
    flat = np.concatenate((np.arange(n_base), _unfold(np.arange(n_base, n_base + len(left)), left, right, n_base))).astype(np.uint32)
    n = np.concatenate((np.ones(n_base, np.int64), expansion.astype(np.int64)))
    start = np.cumsum(n) - n
    each = n[body]
    reached = np.cumsum(each)
    return flat[np.repeat(start[body] - (reached - each), each) + np.arange(each.sum())]


def decode_document(shard: dict, i: int) -> np.ndarray:
    """The ids of document ``i`` of a shard row, from the symbols that cover it only."""
    left, right, body = (np.frombuffer(shard[c], "<u2") for c in ("left", "right", "body"))
    n_base = shard["n_base"]
    expansion = np.frombuffer(shard["expansion"], "<u4")
    long = np.concatenate((np.ones(n_base, np.int64), expansion.astype(np.int64)))
    reached = np.cumsum(long[body])
    start = int(np.sum(shard["lengths"][:i]))
    end = start + shard["lengths"][i]
    a, b = np.searchsorted(reached, start, side="right"), np.searchsorted(reached, end, side="left") + 1
    before = int(reached[a - 1]) if a else 0
    return expand(body[a:b], left, right, expansion, n_base)[start - before : end - before]


def write_token_store(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, shard_tokens: int = 1 << 20) -> None:
    """Encodes every text and writes the shards to ``path`` in ascending key order."""
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        n_base = coder.size
        assert n_base < SYMBOLS, "symbols have 16 bits"
        keys: list = []
        held: list[bytes] = []
        seq = before = n = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            body, left, right, expansion = compress(ids, n_base)
            row = {"part": part, "seq": seq, "part_start": before, "n_tokens": n, "n_base": n_base, "keys": list(keys), "lengths": [len(x) // 4 for x in held]}
            row |= {"left": left.astype("<u2").tobytes(), "right": right.astype("<u2").tobytes(), "expansion": expansion.astype("<u4").tobytes(), "body": body.astype("<u2").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = None
        for batch in batches:
            if schema is None:
                key_type = batch.schema.field("key").type
                binary = [pa.field(c, pa.binary()) for c in ("left", "right", "expansion", "body")]
                schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("n_base", pa.int32()), ("keys", pa.list_(key_type)), ("lengths", pa.list_(pa.int32())), *binary])
            for piece in slices(batch, "text"):
                found = coder.ids(text_column(piece, "text"))
                for k, ids in zip(piece.column(0).to_pylist(), found, strict=True):
                    keys.append(k)
                    held.append(ids + end)
                    n += len(ids) // 4 + 1
                    if n >= shard_tokens:
                        yield close()
                        seq, before, n = seq + 1, before + n, 0
                        keys.clear()
                        held.clear()
        if held:
            yield close()

    dealt = source.repartitionByRange("key").sortWithinPartitions("key", "text")
    dealt.mapInArrow(shards, SHARD_SCHEMA.format(key=kind.simpleString())).write.parquet(path)


def read_token_store(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each stored document: ids of all documents before it, its own ids, and their CRC-32."""
    shards = spark.read.parquet(path)
    kind = shards.schema["keys"].dataType.elementType
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # a row for each key range of the writer, not for each shard or document
    starts = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before")).fillna(0, ["before"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                body, left, right = (np.frombuffer(row[c].as_py(), "<u2") for c in ("body", "left", "right"))
                expansion = np.frombuffer(row["expansion"].as_py(), "<u4")
                flat = expand(body, left, right, expansion, row["n_base"].as_py()).astype("<u4").tobytes()
                lengths = np.asarray(row["lengths"].values, dtype=np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                part = np.full(len(lengths), row["part"].as_py(), np.int32)
                local = row["part_start"].as_py() + ends - lengths
                yield pa.RecordBatch.from_arrays([row["keys"].values, pa.array(part), pa.array(local), pa.array(lengths), pa.array(crc, pa.int64())], ["key", "part", "local", "n_tokens", "ids_crc32"])

    found = shards.mapInArrow(decode, f"key {kind.simpleString()}, part int, local long, n_tokens long, ids_crc32 long")
    return found.join(starts, "part").select(F.col("key").alias(key), (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
