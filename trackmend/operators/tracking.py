"""Linking candidates to tracks, clip by clip and frame by frame.

The work of a clip is split where no candidate shows for longer than a track may be silent: every track has ended there,
so what follows is independent.  A task links the frames of all these sequences side by side: the first of each, then the
second of each, and so on, so that what a frame costs is shared by hundreds of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trackmend.config import Config

IMPOSSIBLE = 1e6
_BOX = ["x1", "y1", "x2", "y2"]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The (row, column) pairs of least total cost, by shortest augmenting paths.

    In plain lists: matrices are parts of one frame's, mostly of a few rows, where arrays take longer to make than to use."""
    if not cost.size:
        return []
    flipped = cost.shape[0] > cost.shape[1]
    cost = np.where(np.isfinite(cost), cost, IMPOSSIBLE)
    c = (cost.T if flipped else cost).tolist()
    n, m = len(c), len(c[0])
    row_price, col_price, owner = [0.0] * n, [0.0] * m, [-1] * m
    for start in range(n):
        reach, via, open_ = [math.inf] * m, [-1] * m, list(range(m))
        row, col, base = start, -1, 0.0
        done = []
        while True:
            costs, price = c[row], base - row_price[row]
            nearest, least = -1, math.inf
            for j in open_:
                slack = price + costs[j] - col_price[j]
                if slack < reach[j]:
                    reach[j], via[j] = slack, col
                if reach[j] < least:
                    nearest, least = j, reach[j]
            col, base = nearest, least
            open_.remove(col)
            if owner[col] < 0:
                break
            done.append(col)
            row = owner[col]
        row_price[start] += base
        for j in done:
            row_price[owner[j]] += base - reach[j]
            col_price[j] -= base - reach[j]
        while col >= 0:
            before = via[col]
            owner[col] = owner[before] if before >= 0 else start
            col = before
    pairs = [(i, j) for j, i in enumerate(owner) if i >= 0]
    return [(j, i) for i, j in pairs] if flipped else pairs


def matched(cost: np.ndarray) -> list[tuple[int, int]]:
    """The possible pairs of the assignment of least cost.  Rows and columns that no possible pair connects don't bear
    on each other, so each part of the matrix is solved by itself; most are single pairs."""
    edges = list(zip(*(x.tolist() for x in np.nonzero(cost < IMPOSSIBLE)), strict=True))
    parts: list[tuple[set[int], set[int]]] = []
    for i, j in edges:
        met = [p for p in parts if i in p[0] or j in p[1]]
        if len(met) == 1:
            rows, columns = met[0]
            rows.add(i)
            columns.add(j)
            continue
        parts = [p for p in parts if p not in met]
        parts.append(({i}.union(*(p[0] for p in met)), {j}.union(*(p[1] for p in met))))
    out = []
    for rows, columns in parts:
        r, c = sorted(rows), sorted(columns)
        if len(r) == len(c) == 1:
            out.append((r[0], c[0]))
        elif len(parts) == 1 and len(r) == cost.shape[0] and len(c) == cost.shape[1]:
            out += [(i, j) for i, j in assign(cost) if cost[i, j] < IMPOSSIBLE]
        else:
            some = cost[r][:, c]
            out += [(r[i], c[j]) for i, j in assign(some) if some[i, j] < IMPOSSIBLE]
    return out


class Linker:
    """The live tracks of one clip, a row of ``live`` for each: number, last frame, x, y, last box, frame before, its x, y;
    the last three are NaN for a track of one box."""

    WIDTH = 11

    def __init__(self, config: Config, live: np.ndarray | None = None, made: int = 0):
        self.config, self.made = config, made
        self.live = np.zeros((0, self.WIDTH)) if live is None else live

    def step(self, frame: int, boxes: np.ndarray) -> list[int]:
        """The track number of each candidate of a frame, in their order."""
        live = self.live
        live = live[frame - live[:, 1] <= self.config.give_up_frames]
        # what each candidate would make its track's row
        rows = np.full((len(boxes), self.WIDTH), np.nan)
        rows[:, 1], rows[:, 2:4], rows[:, 4:8] = frame, (boxes[:, :2] + boxes[:, 2:]) / 2, boxes
        found = [-1] * len(boxes)
        if len(live) and len(boxes):
            pairs = matched(self._cost(frame, live, boxes, rows[:, 2:4]))
            if pairs:
                i, j = (list(x) for x in zip(*pairs, strict=True))
                rows[j, 0], rows[j, 8:11] = live[i, 0], live[i, 1:4]
                live[i] = rows[j]
                for a, b in pairs:
                    found[b] = int(live[a, 0])
        new = [j for j, number in enumerate(found) if number < 0]
        for j in new:
            found[j] = self.made
            self.made += 1
        if new:
            rows[new, 0] = [found[j] for j in new]
            live = np.concatenate([live, rows[new]])
        self.live = live
        return found

    def _cost(self, frame: int, live: np.ndarray, boxes: np.ndarray, xy: np.ndarray) -> np.ndarray:
        """Of each track and candidate, in one matrix."""
        c = self.config
        last, before = live[:, 1], live[:, 8]
        elapsed = frame - last
        # tracks of one box have no speed: their frame before, and where they were, are NaN
        moved = (live[:, 2:4] - live[:, 9:11]) / (last - before)[:, None] * elapsed[:, None]
        ex, ey = (live[:, 2:4] + np.where(np.isnan(moved), 0.0, moved)).T
        gate = c.resume_gate_px + c.max_speed_px_per_frame * elapsed
        dx, dy = xy[:, 0] - ex[:, None], xy[:, 1] - ey[:, None]
        away = np.sqrt(dx * dx + dy * dy)
        possible = (away <= gate[:, None]) & (elapsed > 0)[:, None]
        # overlaps count for two frames
        i, j = np.nonzero(possible & (elapsed <= 2)[:, None])
        if len(i):
            a, b = live[i, 4:8], boxes[j]
            w, h = np.minimum(a[:, 2:], b[:, 2:]).T - np.maximum(a[:, :2], b[:, :2]).T
            common = np.maximum(w, 0.0) * np.maximum(h, 0.0)
            union = _size(a) + _size(b) - common
            iou = np.divide(common, union, out=np.zeros(len(i)), where=(common > 0) & (union > 0))
            away[i, j] -= c.association_iou_weight * iou * gate[i]
        return np.where(possible, away, IMPOSSIBLE)


def _size(boxes: np.ndarray) -> np.ndarray:
    return np.maximum(boxes[:, 2] - boxes[:, 0], 0.0) * np.maximum(boxes[:, 3] - boxes[:, 1], 0.0)


class Lockstep:
    """Links the frames of many sequences at once: the first of each, then the second of each, and so on, with the costs
    and choices of ``Linker``.  A sequence is a run of a clip's frames without a silence that ends all tracks.

    A track goes by the place of its first box, or below zero if it was live before.
    """

    def __init__(self, config: Config):
        self.config = config

    def link(self, sequence: np.ndarray, frame: np.ndarray, boxes: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(track of each box, live tracks of the last sequence) of boxes sorted by sequence and frame; ``live`` are those
        of the first one."""
        track, last = np.zeros(len(frame), np.int64), sequence[-1]
        begins = np.diff(sequence, prepend=-1) != 0
        count = np.cumsum(begins | (np.diff(frame, prepend=frame[0]) != 0))
        step = count - count[begins][sequence]
        order = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[order], np.arange(step.max() + 2))
        of, left = np.zeros(len(live), np.int64), live
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = order[a:b]
            live, of = self._step(live, of, sequence[at], frame[at], boxes[at], at, track)
            if at[-1] == len(frame) - 1 or sequence[at[-1]] == last:
                left = live[of == last]
        return track, left

    def _step(self, live: np.ndarray, of: np.ndarray, sequence: np.ndarray, frame: np.ndarray, boxes: np.ndarray, at: np.ndarray, track: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The live tracks, and the sequences they are of, after one frame of each sequence."""
        first = np.searchsorted(sequence, of)
        n = np.searchsorted(sequence, of, side="right") - first
        now = frame[np.minimum(first, len(frame) - 1)]
        # sequences without a box here have ended
        keep = (n > 0) & (now - live[:, 1] <= self.config.give_up_frames)
        if not keep.all():
            live, of, first, n, now = live[keep], of[keep], first[keep], n[keep], now[keep]
        rows = np.full((len(boxes), Linker.WIDTH), np.nan)
        rows[:, 1], rows[:, 2:4], rows[:, 4:8] = frame, (boxes[:, :2] + boxes[:, 2:]) / 2, boxes
        rows[:, 0] = at
        new = np.ones(len(boxes), bool)
        if len(live):
            i, j = self._matched(*self._pairs(live, now, first, n, boxes, rows[:, 2:4]), of)
            rows[j, 0], rows[j, 8:11] = live[i, 0], live[i, 1:4]
            live[i] = rows[j]
            new[j] = False
        track[at] = rows[:, 0]
        if new.any():
            live, of = np.concatenate([live, rows[new]]), np.concatenate([of, sequence[new]])
            order = np.argsort(of, kind="stable")
            live, of = live[order], of[order]
        return live, of

    def _pairs(self, live: np.ndarray, now: np.ndarray, first: np.ndarray, n: np.ndarray, boxes: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(track, box, cost) of the possible pairs, by track."""
        c = self.config
        last, before = live[:, 1], live[:, 8]
        elapsed = now - last
        moved = (live[:, 2:4] - live[:, 9:11]) / (last - before)[:, None] * elapsed[:, None]
        expected = live[:, 2:4] + np.where(np.isnan(moved), 0.0, moved)
        gate = c.resume_gate_px + c.max_speed_px_per_frame * elapsed
        i = np.repeat(np.arange(len(live)), n)
        j = np.arange(len(i)) + np.repeat(first - np.cumsum(n) + n, n)
        d = xy[j] - expected[i]
        away = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])
        some = np.flatnonzero((away <= gate[i]) & (elapsed > 0)[i])
        i, j, away = i[some], j[some], away[some]
        near = np.flatnonzero((elapsed <= 2)[i])
        if len(near):
            a, b = live[i[near], 4:8], boxes[j[near]]
            w, h = np.minimum(a[:, 2:], b[:, 2:]).T - np.maximum(a[:, :2], b[:, :2]).T
            common = np.maximum(w, 0.0) * np.maximum(h, 0.0)
            union = _size(a) + _size(b) - common
            iou = np.divide(common, union, out=np.zeros(len(near)), where=(common > 0) & (union > 0))
            away[near] -= c.association_iou_weight * iou * gate[i[near]]
        some = np.flatnonzero(away < IMPOSSIBLE)
        return i[some], j[some], away[some]

    @staticmethod
    def _matched(i: np.ndarray, j: np.ndarray, cost: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of the assignments of least cost.

        Where every box of a connected part has one cheapest track, and no two the same, no other assignment is as
        cheap; likewise with tracks and boxes exchanged.  Parts that neither settles are solved one by one.
        """
        out_i, out_j = [], []
        for by_box in (True, False):
            if not len(i):
                break
            near, far = (j, i) if by_box else (i, j)
            order = np.argsort(near, kind="stable")
            starts = np.flatnonzero(np.diff(near[order], prepend=-1))
            least = np.zeros(near.max() + 1)
            least[near[order][starts]] = np.minimum.reduceat(cost[order], starts)
            best = cost == least[near]
            # a tie, or a choice that another has made too
            twice = best & ((np.bincount(near[best], minlength=near.max() + 1)[near] > 1) | (np.bincount(far[best], minlength=far.max() + 1)[far] > 1))
            open_ = np.zeros(len(near), bool)
            if twice.any():
                # it bears on all that possible pairs connect with it
                marked_i, marked_j, size = np.zeros(i.max() + 1, bool), np.zeros(j.max() + 1, bool), -1
                marked_i[i[twice]] = True
                while (found := np.count_nonzero(open_ := marked_i[i] | marked_j[j])) != size:
                    size = found
                    marked_i[i[open_]] = marked_j[j[open_]] = True
            settled = best & ~open_
            out_i.append(i[settled])
            out_j.append(j[settled])
            i, j, cost = i[open_], j[open_], cost[open_]
        if len(i):
            cuts = [0, *(np.flatnonzero(np.diff(of[i])) + 1).tolist(), len(i)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                r, ri = np.unique(i[a:b], return_inverse=True)
                c, cj = np.unique(j[a:b], return_inverse=True)
                some = np.full((len(r), len(c)), IMPOSSIBLE)
                some[ri, cj] = cost[a:b]
                pairs = matched(some)
                out_i.append(r[[x for x, _ in pairs]])
                out_j.append(c[[y for _, y in pairs]])
        return np.concatenate([np.zeros(0, np.int64), *out_i]), np.concatenate([np.zeros(0, np.int64), *out_j])


class Dealer:
    """Numbers the tracks of clips whose rows come by clip and frame, a block of rows at a time.  Rows with ``_stop`` say
    which frames there are.  Between blocks it keeps the last clip's live tracks, and those whose end isn't known yet."""

    def __init__(self, config: Config, split: bool = True):
        self.config, self.split, self.lockstep = config, split, Lockstep(config)
        self.clip: pa.Array | None = None
        self._begin()

    def _begin(self) -> None:
        self.live, self.made, self.placed = np.zeros((0, Linker.WIDTH)), 0, 0
        self.waiting, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64)  # tracks and their last frames

    def block(self, rows: pa.Table) -> Iterator[tuple[pa.Table | None, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
        """(linkable or rejected rows, their tracks; clips, tracks and places in the clips' lists of tracks that ended)."""
        cid = rows.column("cid").combine_chunks()
        if self.clip is not None and self.clip[0] != cid[0]:
            yield self.flush()
        clip = cid.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        clip = np.cumsum(np.diff(clip, prepend=clip[0]) != 0)
        frame = rows.column("frame").to_numpy()
        stop = rows.column("_stop").to_numpy()
        linked = ~stop
        if "reject_stage" in rows.column_names:
            linked &= rows.column("reject_stage").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(linked)
        c, f = clip[at], frame[at]
        clips = int(clip[-1]) + 1
        made = np.zeros(clips, np.int64)
        made[0] = self.made
        number, live = np.zeros(0, np.int64), self.live
        if len(at):
            cut = np.diff(c, prepend=-1) != 0
            if self.split:
                cut |= np.diff(f, prepend=f[0]) > self.config.give_up_frames
            sequence = np.cumsum(cut) - 1
            boxes = np.stack([rows.column(x).to_numpy()[at].astype(float) for x in _BOX], 1)
            before = live if c[0] == 0 else live[:0]
            track, left = self.lockstep.link(sequence, f, boxes, before)
            # new tracks are numbered in a clip by their first boxes
            new = np.flatnonzero(track == np.arange(len(track)))
            begin = np.searchsorted(c[new], np.arange(clips))
            names = np.zeros(len(track), np.int64)
            names[new] = np.arange(len(new)) - begin[c[new]] + made[c[new]]
            number = np.where(track >= 0, names[np.maximum(track, 0)], -track - 1)
            made += np.bincount(c[new], minlength=clips)
            live = left.copy()
            live[:, 0] = np.where(left[:, 0] >= 0, -names[np.maximum(left[:, 0], 0).astype(np.int64)] - 1, left[:, 0])
            live = live if c[-1] == clips - 1 else live[:0]
        elif clips > 1:
            live = live[:0]
        # every track with its last frame; of a pair the later row counts
        of = np.concatenate([np.zeros(len(self.waiting), np.int64), c])
        tracks, seen = np.concatenate([self.waiting, number]), np.concatenate([self.seen, f])
        order = np.lexsort((seen, tracks, of))
        final = np.ones(len(order), bool)
        final[:-1] = (np.diff(of[order]) != 0) | (np.diff(tracks[order]) != 0)
        of, tracks, seen = (x[order][final] for x in (of, tracks, seen))
        # the frame that ends a track is the first one beyond its silence
        low = min(int(frame.min()), int(seen.min()) if len(seen) else 0)
        wide = max(int(frame.max()), int(seen.max()) if len(seen) else 0) + self.config.give_up_frames - low + 2
        stops = np.flatnonzero(stop)
        key = clip[stops] * wide + frame[stops] - low
        i = np.searchsorted(key, of * wide + seen + self.config.give_up_frames - low, side="right")
        end = np.append(key, clips * wide)[i]
        ended = end < (of + 1) * wide
        order = np.lexsort((tracks, np.where(ended, end, clips * wide), of))
        out = order[(ended | (of < clips - 1))[order]]
        place = np.arange(len(out)) - np.searchsorted(of[out], of[out]) + np.where(of[out] == 0, self.placed, 0)
        heads = np.flatnonzero(np.diff(clip, prepend=-1))
        whole = np.full(rows.num_rows, -1, np.int64)
        whole[at] = number
        boxed = np.flatnonzero(~stop)
        yield rows.take(pa.array(boxed)), pa.array(whole[boxed], pa.int64(), mask=whole[boxed] < 0), cid.take(pa.array(heads[of[out]])), tracks[out], place
        last = int(np.count_nonzero(of[out] == clips - 1))
        stay = (of == clips - 1) & ~ended
        self.placed = last + (self.placed if clips == 1 else 0)
        self.waiting, self.seen, self.live, self.made = tracks[stay], seen[stay], live, int(made[-1])
        self.clip = cid.slice(len(cid) - 1, 1)

    def flush(self) -> tuple[pa.Table | None, pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """What is left of the last clip: tracks that no frame ended."""
        tracks = np.sort(self.waiting)
        out = None, pa.array([], pa.int64()), self.clip.take(pa.array(np.zeros(len(tracks), np.int64))), tracks, self.placed + np.arange(len(tracks))
        self._begin()
        return out


#: Rows that are linked together.
BLOCK = 250_000


def associate(candidates: DataFrame, frames: DataFrame, config: Config, split: bool = True, block: int = BLOCK) -> DataFrame:
    """Candidates with ``track_id``, numbered in a clip by first frame and then candidate, and ``track_ord``, the place
    of the track in the clip's list: ended tracks by the frame that ended them, then those still alive.  Candidates with a
    ``reject_stage`` stay as they are, without a track.

    ``frames`` (cid, frame) has all frames, as tracks end on frames without candidates too.  They are dealt by clip with
    the candidates, and again by clip once linked, so that each row gets its track's place.
    """
    schema = StructType([StructField(f.name, f.dataType) for f in candidates.schema]).add("track_id", "long").add("track_ord", "long")
    stops = frames.select("cid", "frame", F.lit(True).alias("_stop"))
    rows = candidates.withColumn("_stop", F.lit(False)).unionByName(stops, allowMissingColumns=True)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by clip and frame; only a block, and what is open of its last clip, is in memory."""
        dealer, held, n = Dealer(config, split), [], 0

        def given(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for boxes, number, clip, tracks, place in parts:
                if boxes is not None and boxes.num_rows:
                    columns = [boxes.column(c) for c in schema.names[:-2]]
                    yield from pa.Table.from_arrays([*columns, number, pa.nulls(boxes.num_rows, pa.int64())], schema.names).to_batches(max_chunksize=20_000)
                if len(tracks):
                    columns = [clip if c == "cid" else pa.nulls(len(tracks), kinds[c]) for c in schema.names[:-2]]
                    yield from pa.Table.from_arrays([*columns, pa.array(tracks), pa.array(place)], schema.names).to_batches(max_chunksize=20_000)

        kinds: dict[str, pa.DataType] = {}

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            kinds.update({f.name: f.type for f in table.schema})
            cut = table.num_rows
            if not last:  # the last frame may go on
                frame = table.column("frame").to_numpy()
                clip = table.column("cid").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                cut = len(frame) - int(np.argmax(((frame != frame[-1]) | (clip != clip[-1]))[::-1])) if (frame[0], clip[0]) != (frame[-1], clip[-1]) else 0
            held, n = (table.slice(cut).to_batches(), table.num_rows - cut)
            if cut:
                yield from given(dealer.block(table.slice(0, cut)))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= block:
                    yield from whole(False)
        if n:
            yield from whole(True)
        if dealer.clip is not None:
            yield from given(iter([dealer.flush()]))

    linked = rows.repartition("cid").sortWithinPartitions("cid", "frame", "cand_idx").mapInArrow(link, schema)
    linked = linked.repartition("cid").sortWithinPartitions("cid", "track_id", "frame")
    return linked.withColumn("track_ord", F.max("track_ord").over(Window.partitionBy("cid", "track_id"))).where("frame is not null")


def build_loose_tracks(detections: DataFrame, frames: DataFrame, config: Config, loose: Config | None = None) -> DataFrame:
    """Merged candidates linked with every gate open that can be: boxes without a width or height, or with a coordinate
    that isn't finite, are no candidates even so.  ``loose`` has other gates than the open ones of ``config.loose()``."""
    from trackmend.operators.merge import merge_duplicates

    loose = loose or config.loose()
    return link_loose(merge_duplicates(detections, loose), frames, loose)


def link_loose(merged: DataFrame, frames: DataFrame, loose: Config) -> DataFrame:
    """``build_loose_tracks`` of boxes that are merged already."""
    from trackmend.operators.rejects import judged

    return associate(judged(merged, loose).where("reject_stage is null").drop("reject_stage"), frames, loose)


def stable_tracks(tracked: DataFrame, least: int = 30) -> DataFrame:
    """The rows of tracks with ``least`` frames or more."""
    n = F.count(F.lit(1)).over(Window.partitionBy("cid", "track_id"))
    return tracked.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")
