"""Benchmark passages in documents, by spaced seeds.

Words are lower-cased and stripped of all but letters and digits.  A window of ``WINDOW`` words that differs from a
benchmark window in two places at most leaves two of four interleaved blocks of its places untouched, so one of the six
masks that look at two blocks each hashes both windows alike: the seeds lose nothing.  Items of fewer words than that are
one window of their own length: from ``SHORT`` words on they may differ in one place, which one of two interleaved
blocks never sees; from ``QUOTED`` words on they may stand anywhere, word by word; those of four words and fewer must be the
whole document, as so few stand anywhere.

Hashes of the documents go through a bitmap before they are shuffled; what passes is joined with the benchmark's hashes
and verified word by word.  The bitmap is the only thing that is broadcast.  It has about ``BITS_EACH`` bits for each
hash of the benchmark, up to 2 ** ``MOST_BITS`` (16 MB); beyond that it passes more, and loses nothing.

Null, empty and wordless items are no items; an item with a null id gets a hash of its text as one.  Repeated rows of a
document count once; rows with a null key aren't reported, and ``drop_contaminated`` keeps them.  Keys are integers.
Empty tables give an empty result.  Other columns are ignored.  A very long text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmend.llm._shared import fresh, slices, strings, text_column, worker_cache

WINDOW, SUBSTITUTIONS, BLOCKS, SHORT, QUOTED = 13, 2, 4, 8, 5
#: Pairs of blocks that a mask looks at; the places of the others are ignored.
MASKS = [(a, b) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)]
#: Bits of the bitmap for each hash, logarithms of its least and greatest size and of a page of it, and probes.
BITS_EACH, LEAST_BITS, MOST_BITS, PAGE = 64, 20, 27, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = (np.arange(1, WINDOW + 1, dtype=np.uint64) * _ODD) | np.uint64(1)

class Words:
    """The hashes of words, remembered in a worker up to ``ENTRIES`` of them."""

    ENTRIES, LONGEST_KEY = 150_000, 64

    def __init__(self):
        self.known: dict[str, int] = {}

    def _hash(self, token: str) -> int:
        """Of the token's letters and digits; 0 for none."""
        if (h := self.known.get(token)) is None:
            import xxhash

            word = token if token.isalnum() else "".join(c for c in token if c.isalnum())
            h = (xxhash.xxh64_intdigest(word) or 1) if word else 0
            if len(self.known) > self.ENTRIES:
                self.known.clear()
            if len(token) <= self.LONGEST_KEY:
                self.known[token] = h
        return h

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, bounds of the texts)."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
        coded = lists.values.dictionary_encode()
        each = np.fromiter(map(self._hash, strings(coded.dictionary)), np.uint64, len(coded.dictionary))
        flat = each[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
        kept = np.concatenate(([0], np.cumsum(flat != 0)))
        return flat[flat != 0], kept[lists.offsets.to_numpy()]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return worker_cache("words", Words).hashes(texts)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _constant(mask: int) -> np.uint64:
    return np.uint64(mask * int(_ODD) & 0xFFFFFFFFFFFFFFFF)


def seeds(flat: np.ndarray, bounds: np.ndarray, short: list[int], whole_only: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(mask, length, places, hashes) of the windows that lie within a text.

    ``whole_only``: of short lengths, only texts of just that length (the benchmark's side).
    """
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(len(flat))  # words to the end of the text

    def block(at: np.ndarray, places: range) -> np.ndarray:
        return sum((flat[at + o] * _PLACE[o] for o in places), np.zeros(len(at), np.uint64))

    at = np.flatnonzero(left >= WINDOW)
    if len(at):
        sums = [block(at, range(b, WINDOW, BLOCKS)) for b in range(BLOCKS)]
        for mask, (a, b) in enumerate(MASKS):
            yield mask, WINDOW, at, _mix(sums[a] + sums[b] + _constant(mask + 1))
    for n in short:
        at = bounds[:-1][sizes == n] if whole_only or n < QUOTED else np.flatnonzero(left >= n)
        if len(at):
            for half in (0, 1) if n >= SHORT else (0,):
                mask = 100 + 2 * n + half
                yield mask, n, at, _mix(block(at, range(half, n, 2) if n >= SHORT else range(n)) + _constant(mask))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(word_hashes(text_column(part, "text"))[1]).astype(np.int64))], ["n"])


SEED_SCHEMA = "key long, place long, mask int, hash long, window array<long>, size long"


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _seed_rows(source: DataFrame, short: list[int], bitmap=None) -> DataFrame:
    """The seeds of (key, text); with a bitmap, those that pass it."""
    whole_only = bitmap is None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if whole_only else np.frombuffer(bitmap.value, np.uint8)
        size = 0 if whole_only else (8 * len(bits)).bit_length() - 1
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                keys = part.column(0).to_numpy(zero_copy_only=False)
                flat, bounds = word_hashes(text_column(part, "text"))
                for mask, n, at, h in seeds(flat, bounds, short, whole_only):
                    if bits is not None:
                        a, b = _probes(h, size)
                        ok = np.flatnonzero((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1)
                        at, h = at[ok], h[ok]
                    if not len(at):
                        continue
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    windows = flat[at[:, None] + np.arange(n)].view(np.int64).ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(windows) + 1, n, dtype=np.int32)), pa.array(windows))
                    columns = [pa.array(keys[doc].astype(np.int64)), pa.array(at - bounds[doc]), pa.array(np.full(len(at), mask, np.int32)), pa.array(h.view(np.int64)), lists, pa.array(np.diff(bounds)[doc])]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "place", "mask", "hash", "window", "size"])

    return source.mapInArrow(rows, SEED_SCHEMA)


def benchmark_bitmap(seed_rows: DataFrame) -> bytes:
    """A bit for each of two probes of each hash; pages of 2 ** ``PAGE`` bits are filled in the tasks."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS_EACH * seed_rows.count()).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(0).to_numpy()
            for page in np.unique(bit >> PAGE).tolist():
                held = np.zeros(1 << PAGE, bool)
                held[bit[bit >> PAGE == page] & ((1 << PAGE) - 1)] = True
                pages[page] = pages.get(page, np.uint8(0)) | np.packbits(held, bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([x.tobytes() for x in pages.values()], pa.binary())], ["page", "bits"])

    probes = F.array(F.shiftrightunsigned("hash", 64 - bits), F.shiftrightunsigned("hash", 8).bitwiseAND(F.lit((1 << bits) - 1)))
    dealt = seed_rows.select(F.explode(probes).alias("bit")).repartition(F.shiftright("bit", PAGE))
    out = np.zeros((1 << (bits - PAGE), 1 << (PAGE - 3)), np.uint8)
    for r in dealt.mapInArrow(fill, "page int, bits binary").collect():  # a row for each page: 2 ** (MOST_BITS - PAGE) at most
        out[r.page] |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, contaminated, windows, doc_start, doc_end, item_words, covered): one row for each document and
    benchmark item that share a verified window; ``covered`` is the share of the item's words that such windows hold,
    places are numbers of words."""
    spark = documents.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("long"), F.xxhash64(F.col(item_text).cast("string"))).alias("key"), F.col(item_text).cast("string").alias("text"))
    lengths = items.select("text").mapInArrow(_lengths, "n long").where(f"n between 1 and {WINDOW - 1}")
    short = sorted(r.n for r in lengths.distinct().collect())  # few lengths
    known = _seed_rows(items, short)
    bitmap = spark.sparkContext.broadcast(benchmark_bitmap(known))
    source = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null")
    hits = _seed_rows(source, short, bitmap).select(F.col("key").alias("doc"), "mask", "hash", F.col("window").alias("found"), F.col("place").alias("doc_place"))
    known = known.select(F.col("key").alias("item"), "mask", "hash", "window", F.col("place").alias("item_place"), F.col("size").alias("item_words"))
    differ = F.aggregate(F.zip_with("found", "window", lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda a, b: a + b)
    allowed = F.when(F.col("mask") < 100, SUBSTITUTIONS).when(F.size("window") >= SHORT, 1).otherwise(0)
    pairs = hits.join(known, ["mask", "hash"]).where(differ <= allowed)
    # what a document and an item share is bounded by the item's windows, so the set of places is small
    spans = pairs.groupBy("doc", "item", "item_words").agg(
        F.collect_set(F.struct("item_place", F.size("window").alias("n"))).alias("spans"), F.min("doc_place").alias("doc_start"), F.max(F.col("doc_place") + F.size("window")).alias("doc_end")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["item_place"], s["item_place"] + s["n"] - 1)))))
    return spans.select(
        F.col("doc").alias(key), F.col("item").alias(item), F.lit(True).alias("contaminated"), F.size("spans").cast("long").alias("windows"), "doc_start", "doc_end", "item_words", F.round(covered / F.col("item_words"), 6).alias("covered")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without a verified window, with all their columns; rows with a null key stay."""
    mark = fresh(documents, "_key")
    found = contaminated(documents, benchmark, key, text).select(F.col(key).alias(mark)).distinct()
    return documents.join(found, F.col(key).cast("long") == F.col(mark), "left_anti")
