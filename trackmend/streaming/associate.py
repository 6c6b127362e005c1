"""Linking candidates of live clips: the batch operator's steps over a stream.

State of a clip, kept by the state store:

* ``live``, a list of its live tracks;
* ``clock``, the next number and the last frame that was stepped;
* ``waiting``, a map from frames to boxes, used only while a micro-batch brings more rows of a clip than ``HELD``.

A micro-batch is stepped in the order of its frames.  Rows are gathered frame by frame, in memory up to ``HELD`` rows of
a clip and in the map beyond that, so memory doesn't follow the micro-batch.  Candidates of frames up to the last one
that was stepped are late; they come out with ``track_id`` null and ``late`` true.  On input in order the numbers are
those of the batch operator.

With an event time, a timer ends a clip ``idle`` after its latest row: its tracks and its last frame go, the next number
stays.  Whatever the clip sends after that starts new tracks, under numbers that were never given before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackmend.config import Config
from trackmend.operators.tracking import Linker

_BOX = ["x1", "y1", "x2", "y2"]
_ROW = ["cand_idx", *_BOX]
#: Rows of a clip that a micro-batch holds in memory at most, and rows that are given on together.
HELD, GIVEN = 100_000, 5_000
LIVE = "number double, last double, x double, y double, x1 double, y1 double, x2 double, y2 double, before double, bx double, by double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State in lists and maps, and timers, need the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class ClipLinker(StatefulProcessor):
    def __init__(self, config: Config, time: str | None, idle_ms: int, held: int = HELD):
        self.config, self.time, self.idle_ms, self.held = config, time, idle_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", LIVE)
        self.clock = handle.getValueState("clock", "made long, last long")
        self.waiting = handle.getMapState("waiting", "frame long, part long", "boxes binary")

    def _linker(self) -> tuple[Linker, int]:
        made, last = self.clock.get() if self.clock.exists() else (0, -1)
        tracks = [list(t) for t in self.live.get()] if self.live.exists() else []
        return Linker(self.config, np.array(tracks, float).reshape(-1, Linker.WIDTH), made), last

    def _keep(self, linker: Linker, last: int) -> None:
        self.clock.update((linker.made, last))
        if len(linker.live):
            self.live.put([tuple(t) for t in linker.live.tolist()])
        else:
            self.live.clear()

    def _put_down(self, held: dict[int, list[np.ndarray]], part: int) -> None:
        for frame, some in held.items():
            self.waiting.updateValue((frame, part), (np.concatenate(some).tobytes(),))
        held.clear()

    def _frames(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
        """(frame, its rows of cand_idx and box) in order; sets the timer on the way."""
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        n, parts, latest = 0, 0, None
        for batch in rows:
            if not len(batch):
                continue
            frames = batch["frame"].to_numpy()
            order = np.argsort(frames, kind="stable")
            values, frames = batch[_ROW].to_numpy(float)[order], frames[order]
            cut = np.flatnonzero(np.diff(frames, prepend=frames[0] - 1)).tolist()
            for a, b in zip(cut, [*cut[1:], len(frames)], strict=True):
                held[int(frames[a])].append(values[a:b])
            n += len(batch)
            if self.time is not None:
                newest = int(batch[self.time].max().timestamp() * 1000)
                latest = newest if latest is None else max(latest, newest)
            if n > self.held:
                self._put_down(held, parts)
                n, parts = 0, parts + 1
        if latest is not None:
            self._end_later(latest)
        if not parts:
            yield from ((f, np.concatenate(held[f])) for f in sorted(held))
            return
        self._put_down(held, parts)
        places = defaultdict(list)
        for frame, part in self.waiting.keys():
            places[int(frame)].append(int(part))
        for frame in sorted(places):
            yield frame, np.concatenate([np.frombuffer(self.waiting.getValue((frame, part))[0], float).reshape(-1, len(_ROW)) for part in sorted(places[frame])])
        self.waiting.clear()

    def _end_later(self, latest: int) -> None:
        for timer in list(self.handle.listTimers()):
            at = int(timer)
            latest = max(latest, at - self.idle_ms)
            self.handle.deleteTimer(at)
        self.handle.registerTimer(latest + self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        linker, last = self._linker()
        out, n = [], 0
        for frame, some in self._frames(rows):
            some = some[np.argsort(some[:, 0], kind="stable")]
            late = frame <= last
            # -1 stands for none
            out.append(np.c_[np.full(len(some), frame), some[:, 0], np.full(len(some), -1) if late else linker.step(frame, some[:, 1:])])
            last, n = max(last, frame), n + len(some)
            if n >= GIVEN:
                yield self._rows(key[0], out)
                out, n = [], 0
        if out:
            yield self._rows(key[0], out)
        self._keep(linker, last)

    @staticmethod
    def _rows(cid, out: list[np.ndarray]) -> pd.DataFrame:
        frame, index, number = np.concatenate(out).astype(np.int64).T
        return pd.DataFrame({"cid": cid, "frame": frame, "cand_idx": index, "track_id": pd.Series(number, dtype="Int64").mask(number < 0), "late": number < 0})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        made, _ = self.clock.get()
        self.live.clear()
        self.clock.update((made, -1))
        return iter(())

    def close(self) -> None:
        pass


def associate_stream(candidates: DataFrame, config: Config, time: str | None = None, idle: float = 3600.0, held: int = HELD) -> DataFrame:
    """(cid, frame, cand_idx, track_id, late) for each row of a stream of candidates.

    ``time`` names the column of their event time, on which the caller has set a watermark; without it no clip ever
    ends.  ``idle`` is in seconds; ``held`` rows of a clip at most wait in memory.  Sets the session's state store.
    """
    use_state_store(candidates.sparkSession)
    kind = candidates.schema["cid"].dataType.simpleString()
    return candidates.groupBy("cid").transformWithStateInPandas(
        ClipLinker(config, time, int(idle * 1000), held), f"cid {kind}, frame long, cand_idx long, track_id long, late boolean", "append", "None" if time is None else "EventTime"
    )
