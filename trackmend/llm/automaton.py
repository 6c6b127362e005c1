"""Weighted acyclic automata that map sequences of words to counts.

An automaton accepts sequences of one length.  Its arcs are labelled with words; the last arc of a path also bears the
count of the sequence.  It is built from sorted sequences, one prefix at a time: as soon as the next prefix leaves a
state, that state is looked up in the register of its depth and takes the number of an equal one, so equal endings are
stored once.  A built automaton is a few arrays in one byte string, which is what tasks exchange.

Words are bytes and sort as such; sequences sort word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _keys(grams: np.ndarray, words: int) -> list[np.ndarray]:
    """The columns packed into as few integers as possible, the most significant first."""
    bits = max(1, int(words).bit_length())
    width, each = grams.shape[1], max(1, 63 // bits)
    out = []
    for at in range(0, width, each):
        key = np.zeros(len(grams), np.int64)
        for j in range(at, min(width, at + each)):
            key = (key << bits) | grams[:, j]
        out.append(key)
    return out


def summed(grams: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``grams`` in order, and the sums of their counts; labels are below ``words``."""
    if not len(grams):
        return grams, counts
    keys = _keys(grams, words)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(grams), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return grams[order[at]], np.add.reduceat(counts[order], at)


class _Builder:
    """States by depth; a state is the bytes of its arcs, each a label and where it leads (or its count)."""

    def __init__(self, length: int):
        self.length, self.states = length, []
        self.registers: list[dict[bytes, int]] = [{} for _ in range(length)]
        self.open: list[list[int]] = [[] for _ in range(length)]

    def freeze(self, depth: int, arcs: bytes) -> int:
        register = self.registers[depth]
        number = register.get(arcs)
        if number is None:
            number = register[arcs] = len(self.states)
            self.states.append(arcs)
        return number

    def close(self, depth: int, path: Sequence[int]) -> None:
        """Freezes the open states deeper than ``depth``, those of the prefix that was added last."""
        for d in range(self.length - 2, depth, -1):
            number = self.freeze(d, np.array(self.open[d], np.int64).tobytes())
            self.open[d] = []
            self.open[d - 1] += (path[d - 1], number)


def build(words: pa.Array, grams: np.ndarray, counts: np.ndarray) -> bytes:
    """From distinct sorted sequences of indices into the sorted array ``words``."""
    n, length = grams.shape
    builder = _Builder(length)
    last = np.empty((n, 2), np.int64)
    last[:, 0], last[:, 1] = grams[:, -1], counts
    data = last.tobytes()
    if length == 1:
        builder.freeze(0, data)
    elif n:
        changes = grams[1:, :-1] != grams[:-1, :-1]
        starts = np.concatenate(([0], np.flatnonzero(changes.any(1)) + 1))
        shared = changes[starts[1:] - 1].argmax(1).tolist()  # words that a prefix has in common with the one before
        prefixes, ends = grams[starts, :-1].tolist(), [*starts[1:].tolist(), n]
        begin = 0
        for path, end, common in zip(prefixes, ends, [*shared, None], strict=True):
            builder.open[length - 2] += (path[-1], builder.freeze(length - 1, data[16 * begin : 16 * end]))
            begin = end
            builder.close(0 if common is None else common, path)
        builder.freeze(0, np.array(builder.open[0], np.int64).tobytes())
    sizes = np.array([len(s) // 16 for s in builder.states], np.int64)
    arcs = np.frombuffer(b"".join(builder.states), np.int64).reshape(-1, 2)
    spelt = words.cast(pa.large_binary()).to_pylist()
    lengths = np.array([len(w) for w in spelt], np.int64)
    head = np.array([length, len(sizes), len(arcs), len(spelt)], np.int64)
    return b"".join([head.tobytes(), sizes.astype(np.int32).tobytes(), arcs[:, 0].astype(np.int32).tobytes(), lengths.astype(np.int32).tobytes(), np.ascontiguousarray(arcs[:, 1]).tobytes(), *spelt])


class Automaton:
    def __init__(self, data: bytes):
        self.length, states, arcs, words = (int(x) for x in np.frombuffer(data, np.int64, 4))
        at = 32
        sizes = np.frombuffer(data, np.int32, states, at)
        at += 4 * states
        self.label = np.frombuffer(data, np.int32, arcs, at).astype(np.int64)
        at += 4 * arcs
        lengths = np.frombuffer(data, np.int32, words, at)
        at += 4 * words
        self.value = np.frombuffer(data, np.int64, arcs, at)
        at += 8 * arcs
        self.first = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.root = states - 1
        offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        self.words = pa.Array.from_buffers(pa.large_binary(), words, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at:])])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(sequences as indices into ``words``, counts), in order."""
        if self.root < 0:
            return np.zeros((0, self.length), np.int64), np.zeros(0, np.int64)
        columns, state = [], np.array([self.root])
        for _ in range(self.length):
            size = self.first[state + 1] - self.first[state]
            reached = np.cumsum(size)
            arc = np.repeat(self.first[state] - (reached - size), size) + np.arange(reached[-1] if len(reached) else 0)
            columns = [np.repeat(c, size) for c in columns] + [self.label[arc]]
            state = self.value[arc]
        return np.stack(columns, 1), state

    def compose(self, words: pa.Array, grams: np.ndarray) -> np.ndarray:
        """The counts of ``grams``, indices into ``words``, 0 for those that aren't accepted: both sides go from state to
        state together, for all sequences at once."""
        if self.root < 0 or not len(grams):
            return np.zeros(len(grams), np.int64)
        known = pc.fill_null(pc.index_in(words.cast(pa.large_binary()), self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        span = len(self.words) + 1
        arcs = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * span + self.label
        state, live = np.full(len(grams), self.root), np.ones(len(grams), bool)
        for j in range(self.length):
            label = known[grams[:, j]]
            wanted = state * span + label
            at = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            live &= (label >= 0) & (arcs[at] == wanted)
            state = np.where(live, self.value[at], 0)
        return np.where(live, state, 0)


class Union:
    """The union of automata of one length, with the counts of equal sequences added up."""

    def __init__(self, length: int, limit: int = 1 << 20):
        self.length, self.limit = length, limit
        self.words = pa.array([], pa.large_binary())
        self.grams, self.counts = [np.zeros((0, length), np.int64)], [np.zeros(0, np.int64)]
        self.held = self.kept = 0

    def add(self, data: bytes) -> None:
        one = Automaton(data)
        grams, counts = one.paths()
        known = pc.index_in(one.words, self.words)
        if known.null_count:
            fresh = one.words.filter(pc.is_null(known))
            self.words = pa.concat_arrays([self.words, fresh])
            known = pc.index_in(one.words, self.words)
        self.grams.append(known.to_numpy(zero_copy_only=False).astype(np.int64)[grams])
        self.counts.append(counts)
        self.held += len(counts)
        if self.held > max(self.limit, 2 * self.kept):
            self._combine()

    def _combine(self) -> None:
        grams, counts = summed(np.concatenate(self.grams), np.concatenate(self.counts), len(self.words))
        self.grams, self.counts = [grams], [counts]
        self.held = self.kept = len(counts)

    def result(self, least: int = 0) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(sorted words, sorted sequences, counts) of those that are counted ``least`` times or more."""
        self._combine()
        some = self.counts[0] >= least
        return sorted_words(self.words, self.grams[0][some], self.counts[0][some])


def sorted_words(words: pa.Array, grams: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same sequences over the sorted array of the words that they use, in order."""
    used = np.unique(grams)
    some = words.take(pa.array(used))
    order = pc.sort_indices(some).to_numpy()
    place = np.zeros(int(used[-1]) + 1 if len(used) else 0, np.int64)
    place[used[order]] = np.arange(len(order))
    grams, counts = summed(place[grams], counts, len(order))
    return some.take(pa.array(order)), grams, counts


def ranges_of(words: pa.Array, grams: np.ndarray, bounds: list[tuple[bytes, ...]]) -> np.ndarray:
    """For each range, which ``bounds`` (sorted) divide, where its sorted sequences begin; at the end, their number."""
    spelt, out, n, at = words.to_pylist(), [0], len(grams), 0
    for bound in bounds:
        low, high = at, n
        while low < high:
            mid = (low + high) // 2
            if tuple(spelt[i] for i in grams[mid]) < bound:
                low = mid + 1
            else:
                high = mid
        at = low
        out.append(at)
    return np.array([*out, n])


def automata_by_range(words: pa.Array, grams: np.ndarray, counts: np.ndarray, bounds: list[tuple[bytes, ...]]) -> Iterable[tuple[int, bytes]]:
    """(range, automaton) of sorted sequences, for the ranges that have any."""
    cut = ranges_of(words, grams, bounds).tolist()
    for number, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if a < b:
            used, local = np.unique(grams[a:b], return_inverse=True)
            yield number, build(words.take(pa.array(used)), local.reshape(b - a, -1).astype(np.int64), counts[a:b])
