"""Duplicate boxes of a frame: pairs, transitive groups, and the candidate that stands for each group.

Frames are dealt out once, and their boxes swept from left to right: sorted by their left edges, a box is compared only
with those that begin before it ends.  All frames of a batch are swept at once, whether they are narrow or wide, and
groups are closed by passing on the smallest member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmend.config import Config
from trackmend.functions.geometry import box, overlap_ratio

_BOX = ("x1", "y1", "x2", "y2")


def duplicate_pairs(detections: DataFrame, config: Config) -> DataFrame:
    """(cid, frame, det_a, det_b): pairs of a frame's boxes, det_a < det_b, that overlap by the threshold or more."""
    a = detections.select("cid", "frame", F.col("det_id").alias("det_a"), *[F.col(c).alias(f"a_{c}") for c in _BOX])
    b = detections.select("cid", "frame", F.col("det_id").alias("det_b"), *[F.col(c).alias(f"b_{c}") for c in _BOX])
    near = overlap_ratio(box("a_"), box("b_")) >= config.duplicate_overlap_threshold
    return a.join(b, ["cid", "frame"]).where((F.col("det_a") < F.col("det_b")) & near).select("cid", "frame", "det_a", "det_b")


def overlapping(frame: np.ndarray, corners: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of boxes of one frame that overlap by ``threshold`` or more, by a sweep over all frames."""
    order = np.lexsort((corners[:, 0], frame))
    f, (x1, y1, x2, y2) = frame[order], corners[order].T
    area = np.clip(x2 - x1, 0, None) * np.clip(y2 - y1, 0, None)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, step = np.arange(len(f)), 1
    while len(at):
        at = at[at + step < len(f)]
        other = at + step
        # a box that begins where this one has ended ends its sweep
        going = (f[other] == f[at]) & ((x1[other] < x2[at]) | (threshold <= 0))
        at, other = at[going], other[going]
        common = np.clip(np.minimum(x2[at], x2[other]) - x1[other], 0, None) * np.clip(np.minimum(y2[at], y2[other]) - np.maximum(y1[at], y1[other]), 0, None)
        smaller = np.minimum(area[at], area[other])
        ratio = np.divide(common, smaller, out=np.zeros(len(at)), where=(common > 0) & (smaller > 0))
        near = ratio >= threshold
        left.append(order[at[near]])
        right.append(order[other[near]])
        step += 1
    return np.concatenate(left), np.concatenate(right)


def first_members(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of the group of each of ``n`` items that pairs connect."""
    first = np.arange(n)
    while True:
        least = np.minimum(first[left], first[right])
        if np.array_equal(least, first[left]) and np.array_equal(least, first[right]):
            return first
        np.minimum.at(first, left, least)
        np.minimum.at(first, right, least)
        while not np.array_equal(first, first[first]):
            first = first[first]


def _by_frame(work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on batches that end between frames, with the number of each row's frame in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            if rows.num_rows:
                number = _numbers(rows)
                last = int(np.searchsorted(number, number[-1]))  # that frame may go on
                if last:
                    yield work(rows.slice(0, last), number[:last])
                held = rows.slice(last)
        if held is not None and held.num_rows:
            yield work(held, _numbers(held))

    return run


def _numbers(rows: pa.Table) -> np.ndarray:
    clip = rows.column("cid").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    frame = rows.column("frame").to_numpy()
    return np.concatenate(([0], np.cumsum((clip[1:] != clip[:-1]) | (frame[1:] != frame[:-1]))))


def _groups(rows: pa.Table, number: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of the group's first box, whether the box is one of finite numbers); others are groups of their own."""
    values = np.stack([rows.column(c).to_numpy().astype(float) for c in (*_BOX, "confidence")], 1)
    sound = np.isfinite(values).all(1)
    at = np.flatnonzero(sound)
    left, right = overlapping(number[at], values[at, :4], threshold)
    return first_members(len(number), at[left], at[right]), sound


def _dealt(detections: DataFrame) -> DataFrame:
    return detections.select("cid", "frame", "det_id", *_BOX, "confidence").repartition("cid", "frame").sortWithinPartitions("cid", "frame", "det_id")


def duplicate_components(detections: DataFrame, config: Config) -> DataFrame:
    """(cid, frame, det_id, first): the lowest id of the group of each box."""
    threshold = config.duplicate_overlap_threshold

    def work(rows: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        first, _ = _groups(rows, number, threshold)
        ids = rows.column("det_id").combine_chunks()
        return pa.RecordBatch.from_arrays([rows.column("cid").combine_chunks(), rows.column("frame").combine_chunks(), ids, ids.take(pa.array(first))], ["cid", "frame", "det_id", "first"])

    kind = detections.schema["cid"].dataType.simpleString()
    return _dealt(detections).mapInArrow(_by_frame(work), f"cid {kind}, frame long, det_id long, first long")


def merge_duplicates(detections: DataFrame, config: Config) -> DataFrame:
    """Candidates (cid, frame, cand_idx, x1, y1, x2, y2, confidence, source_ids, was_merged).

    A group is represented by its most confident box, of equals the one with the lowest id; candidates of a frame are
    numbered in the order of their groups' lowest ids.  A box with a coordinate or confidence that isn't finite is a
    candidate of its own without a number.
    """
    threshold = config.duplicate_overlap_threshold

    def work(rows: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        first, sound = _groups(rows, number, threshold)
        confidence = np.nan_to_num(rows.column("confidence").to_numpy().astype(float), nan=0.0)
        # rows stand by id: a stable sort leaves the lowest one first among equals, and members in order
        best_order, members = np.lexsort((-confidence, first)), np.argsort(first, kind="stable")
        leads = np.flatnonzero(first == np.arange(len(first)))
        size = np.bincount(first, minlength=len(first))[leads]
        starts = np.cumsum(size) - size
        best = pa.array(best_order[starts])
        counted = np.cumsum(sound[leads])
        of = number[leads]
        begin = np.searchsorted(of, of)  # the frame's first candidate
        index = counted - 1 - np.where(begin > 0, counted[begin - 1], 0)
        ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(first)), pa.int32()), rows.column("det_id").combine_chunks().take(pa.array(members)))
        columns = [rows.column(c).combine_chunks().take(best) for c in ("cid", "frame")]
        columns += [pa.array(index, pa.int64(), mask=~sound[leads]), *[rows.column(c).combine_chunks().take(best) for c in (*_BOX, "confidence")], ids, pa.array(size > 1)]
        return pa.RecordBatch.from_arrays(columns, ["cid", "frame", "cand_idx", *_BOX, "confidence", "source_ids", "was_merged"])

    kind = detections.schema["cid"].dataType.simpleString()
    corners = ", ".join(f"{c} double" for c in _BOX)
    return _dealt(detections).mapInArrow(_by_frame(work), f"cid {kind}, frame long, cand_idx long, {corners}, confidence double, source_ids array<bigint>, was_merged boolean")
