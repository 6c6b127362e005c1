"""Byte-level BPE through a cache of text segments.

A byte-level pre-tokenizer always cuts before a single space (or a single line feed) that stands between two
characters that aren't white space.  Cutting there gives segments of one or a few pre-tokens whose ids don't depend
on what stands around them, so each distinct segment is encoded once in a worker.  Texts with runs of white space are
cut at the safe places only; whatever stays together is encoded together, as the library would.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trackmend.llm._shared import Recent, strings, worker_cache

#: Two white space characters in a row (of any that ``\s`` knows), or the separator.
_ODD = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|\x00"
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Longer segments are encoded each time and not remembered.
LONGEST_KEY = 64
#: Parts that a worker remembers.
CACHE_ENTRIES = 800_000


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class Cut:
    """The distinct parts of some texts, and where they stand.

    A segment is a word with what follows it; punctuation behind a letter is a pre-token of its own, so a segment has
    two parts, the second one often empty.  ``distinct[index[bounds[i]:bounds[i + 1]]]`` is text i.  Texts that hold
    the separator are left out (as empty) and stand in ``whole`` instead.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD)
        if pc.any(odd).as_py():
            rows = texts.to_pylist()
            self.whole = {i: t for i, t in enumerate(rows) if "\0" in t}
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
            texts = pc.replace_with_mask(texts, odd, pa.array(["" if i in self.whole else "\0".join(_SAFE_CUT.split(rows[i])) for i in at], pa.large_string()))
            plain = pc.if_else(odd, "", texts)
        else:
            self.whole, plain = {}, texts
        marked = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(marked if plain is texts else pc.if_else(odd, texts, marked), "\0")
        coded = lists.values.dictionary_encode()
        segments = coded.dictionary
        heads = pc.utf8_rtrim(segments, ".,;:!?")
        heads = pc.if_else(pc.utf8_is_alpha(pc.utf8_slice_codeunits(heads, -1)), heads, segments)
        tails = self._behind(segments, heads)
        parts = pa.chunked_array([heads, tails]).combine_chunks().dictionary_encode()
        self.distinct: list[str] = strings(parts.dictionary)
        pairs = parts.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T
        self.index = pairs[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        self.bounds = 2 * lists.offsets.to_numpy().astype(np.int64)

    @staticmethod
    def _behind(segments: pa.Array, heads: pa.Array) -> pa.Array:
        """What each segment holds behind its head; that is ASCII, so bytes are characters."""
        data = np.frombuffer(segments.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(segments.buffers()[1], np.int64)[1 : len(segments) + 1]
        n = pc.subtract(pc.binary_length(segments), pc.binary_length(heads)).to_numpy(zero_copy_only=False)
        reached = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        at = np.repeat(ends - reached[1:], n) + np.arange(reached[-1])
        return pa.LargeStringArray.from_buffers(len(segments), pa.py_buffer(reached.tobytes()), pa.py_buffer(data[at].tobytes()))


class SegmentEncoder:
    """Encodes parts of texts with the ``tokenizers`` library and remembers their ids as little-endian 32-bit integers."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.size = self.tokenizer.get_vocab_size()
        by_id = {i: token for token, i in self.tokenizer.get_vocab().items()}
        #: in a byte-level vocabulary each character of a token stands for one byte
        self.byte_length = np.array([len(by_id.get(i, "")) for i in range(max(by_id) + 1)], dtype=np.int64)
        self.known = Recent(CACHE_ENTRIES)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, parts: list[str]) -> list[bytes]:
        """The ids of each part.  Letters behind a space, or alone on a line, surely are a pre-token: such parts are
        encoded in runs, which is much faster than one by one."""
        found: list[bytes] = [b""] * len(parts)
        self._runs(parts, [i for i, p in enumerate(parts) if p[:1] == " " and p[1:].isalpha()], "", found)
        self._runs(parts, [i for i, p in enumerate(parts) if p.isalpha()], "\n", found)
        alone = [i for i, x in enumerate(found) if not x]
        for i, x in zip(alone, self.whole([parts[i] for i in alone]), strict=True):
            found[i] = x
        return found

    def _runs(self, parts: list[str], words: list[int], before: str, found: list[bytes]) -> None:
        skip = 4 * len(before)  # a line feed is one id
        for at in range(0, len(words), 8192):
            of = [before + parts[i] for i in words[at : at + 8192]]
            coded = self.tokenizer.encode_batch_fast(["".join(of[k : k + 32]) for k in range(0, len(of), 32)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in coded])
            reached = np.cumsum(self.byte_length[ids])
            size = pc.binary_length(pa.array(of)).to_numpy(zero_copy_only=False)
            ends = 4 * (np.searchsorted(reached, np.cumsum(size), side="left") + 1)
            start, flat = 0, ids.tobytes()
            for i, end in zip(words[at : at + 8192], ends.tolist(), strict=True):
                found[i] = flat[start + skip : end]
                start = end

    def remembered(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, from the cache where it has them."""
        got, missing = self.known.many(parts)
        if missing:
            lacking = [parts[i] for i in missing]
            found = self.encode(lacking)
            for i, v in zip(missing, found, strict=True):
                got[i] = v
            self.known.put({k: v for k, v in zip(lacking, found, strict=True) if len(k) <= LONGEST_KEY})
        self.known.turn()
        return got

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of whole texts."""
        cut = Cut(texts)
        got = self.remembered(cut.distinct)
        flat = np.frombuffer(b"".join(got), "<u4")
        n = np.fromiter(map(len, got), np.int64, len(got)) // 4
        start = np.cumsum(n) - n
        each = n[cut.index]
        reached = np.concatenate(([0], np.cumsum(each)))
        out = flat[np.repeat(start[cut.index] - reached[:-1], each) + np.arange(reached[-1])].tobytes()
        ends = (4 * reached[cut.bounds]).tolist()
        rows = [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i, t in cut.whole.items():
            rows[i] = self.whole([t])[0]
        return rows

    def counts(self, texts: pa.Array, first: dict[str, int]) -> np.ndarray:
        """The numbers of ids of whole texts; ``first`` is asked before the worker's cache."""
        cut = Cut(texts)
        got = list(map(first.get, cut.distinct))
        missing = [i for i, v in enumerate(got) if v is None]
        for i, v in zip(missing, self.remembered([cut.distinct[i] for i in missing]), strict=True):
            got[i] = len(v) // 4
        reached = np.concatenate(([0], np.cumsum(np.array(got, np.int64)[cut.index])))
        out = reached[cut.bounds[1:]] - reached[cut.bounds[:-1]]
        for i, t in cut.whole.items():
            out[i] = len(self.whole([t])[0]) // 4
        return out


def encoder(vocabulary: str) -> SegmentEncoder:
    """One per worker process, kept between tasks."""
    return worker_cache(("segments", vocabulary), lambda: SegmentEncoder(vocabulary))
