"""SentencePiece encoding and decoding through suffix-array matching.

A batch's text is cut into chunks that no piece crosses; the distinct ones that the worker doesn't know yet are put
one after the other.  The suffixes of this text are sorted, to the depth of the longest piece, and every piece of the
vocabulary finds its range of occurrences by binary search, all pieces at once.  The occurrences are the edges of a
lattice.  Sorted by where they end, they are relaxed in order: each place gets the one edge that continues the
encoding of what stands before it.

For a BPE vocabulary that edge is the one whose piece and the piece before it stay two pieces when they are encoded
alone; a sequence of pieces is the encoding of its text just when this holds for all its neighbours.  Such verdicts are
remembered in the worker.  Characters that no piece has break the text; they are encoded as bytes.

Decoding looks the bytes of each id up.  A text is read back exactly unless it holds the character that stands for a
space.  Null texts count as empty and have no ids; repeated rows and null keys are rows like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmend.llm._shared import Recent, slices, strings, text_column, worker_cache
from trackmend.llm.segments import vocabulary_path

SPACE = "▁"
_BREAK = re.compile(rf"(?<=[^{SPACE}])(?={SPACE})")
#: Characters whose suffixes are sorted at once; chunks and verdicts that a worker remembers; length up to which chunks are remembered.
BLOCK, CACHE_ENTRIES, VERDICTS, LONGEST_KEY = 1 << 18, 400_000, 400_000, 64
NONE = -1


class PieceCoder:
    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.score = {p: model.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece goes on behind a space: chunks can't be cut there")
        self.longest = max(map(len, self.id_of))
        #: a dense alphabet: 0 ends a chunk, 1 is any character that no piece has
        self.alphabet = np.array(sorted({ord(c) for p in self.id_of for c in p}), np.uint32)
        self.per_key = 63 // (len(self.alphabet) + 3).bit_length()
        self.bits = (len(self.alphabet) + 3).bit_length()
        self.keys = -(-self.longest // self.per_key)
        known = sorted(self.id_of)
        self.piece_ids = np.array([self.id_of[p] for p in known], np.int32)
        self.piece_size = np.array([len(p) for p in known], np.int32)
        codes = np.zeros((len(known), self.keys * self.per_key), np.uint64)
        for i, p in enumerate(known):
            codes[i, : len(p)] = np.searchsorted(self.alphabet, [ord(c) for c in p]) + 2
        self.low = self._pack(codes)
        codes[np.arange(codes.shape[1]) >= self.piece_size[:, None]] = (1 << self.bits) - 1
        self.high = self._pack(codes)
        self.known = Recent(CACHE_ENTRIES)
        self.stay: dict[int, bool] = {}
        # what each id stands for, in bytes
        text = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            if i != self.unknown:
                text[i] = bytes([b])
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.piece_length = np.array([len(t) for t in text], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length

    def _pack(self, codes: np.ndarray) -> list[np.ndarray]:
        """The first characters of each row as ``keys`` numbers that sort like them."""
        out = []
        for k in range(self.keys):
            key = np.zeros(len(codes), np.uint64)
            for c in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << np.uint64(self.bits)) | codes[:, c]
            out.append(key)
        return out

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(suffix array to the depth of the longest piece, keys of the suffixes in its order)."""
        n = len(codes)
        padded = np.concatenate((codes, np.zeros(self.keys * self.per_key, np.uint64)))
        first = np.zeros(n, np.uint64)
        for c in range(self.per_key):
            first = (first << np.uint64(self.bits)) | padded[c : c + n]
        keys = [np.concatenate((first, np.zeros(self.keys * self.per_key, np.uint64)))[k * self.per_key :][:n] for k in range(self.keys)]
        order = np.argsort(keys[0], kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (np.diff(keys[0][order]) != 0).astype(np.int64))))
        depth = self.per_key
        while depth < self.longest:  # ranks of pairs of ranks: twice the depth
            pair = (rank << 32) | np.concatenate((rank[depth:] + 1, np.zeros(min(depth, n), np.int64)))[:n]
            order = np.argsort(pair, kind="stable")
            rank = np.zeros(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], (np.diff(pair[order]) != 0).astype(np.int64))))
            depth *= 2
        return order, [k[order] for k in keys]

    def _search(self, keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """Where each wanted row stands among the sorted suffixes; all rows take each step together."""
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = np.zeros(len(open_), bool)
            even = np.ones(len(open_), bool)
            for k, w in zip(keys, wanted, strict=True):
                a, b = k[mid], w[open_]
                less |= even & (a < b)
                even &= a == b
            if right:
                less |= even
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, id) of every occurrence of a piece, by end, longest first."""
        order, keys = self._suffixes(codes)
        lo, hi = self._search(keys, self.low, False), self._search(keys, self.high, True)
        n = hi - lo
        start = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        size = np.repeat(self.piece_size, n)
        by_end = np.argsort(((start + size) << 8) | (255 - size), kind="stable")
        return (start + size)[by_end], start[by_end], np.repeat(self.piece_ids, n)[by_end]

    def _stays(self, before: int, piece: int) -> bool:
        """Whether the two pieces are the encoding of their text (the one piece, if none is before it)."""
        parts = list((self.pieces[before] if before >= 0 else "") + self.pieces[piece])
        score = self.score
        while len(parts) > 1:
            best, at = -1e300, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == ([self.pieces[before], self.pieces[piece]] if before >= 0 else [self.pieces[piece]])

    def _block(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, as one text with a mark behind each chunk."""
        text = np.frombuffer("".join(f"{c}\0" for c in chunks).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(c) + 1 for c in chunks])
        ends = np.cumsum(sizes)
        at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[at] == text, at + 2, 1).astype(np.uint64)
        codes[ends - 1] = 0
        end, start, piece = self.edges(codes)  # none crosses a mark
        first = np.searchsorted(end, np.arange(len(text) + 2)).tolist()
        start, piece = start.tolist(), piece.tolist()
        stay, base = self.stay, len(self.pieces) + 1
        last, back = [NONE] * (len(text) + 1), [0] * (len(text) + 1)
        out = []
        for c, (head, size) in enumerate(zip((ends - sizes).tolist(), sizes.tolist(), strict=True)):
            last[head] = NONE
            for e in range(head + 1, head + size):
                for k in range(first[e], first[e + 1]):
                    s = start[k]
                    key = (last[s] + 1) * base + piece[k]
                    ok = stay.get(key)
                    if ok is None:
                        ok = stay[key] = self._stays(last[s], piece[k])
                    if ok:
                        last[e], back[e] = piece[k], s
                        break
                else:  # no piece has this character
                    last[e], back[e] = NONE, e - 1
            ids, e = [], head + size - 1
            while e > head:
                if last[e] >= 0:
                    ids.append(last[e])
                else:
                    ids.extend(self._unknown(chunks[c][e - 1 - head]))
                e = back[e]
            out.append(np.array(ids[::-1], "<u4").tobytes())
        if len(stay) > VERDICTS:
            stay.clear()
        return out

    def _long(self, chunk: str) -> bytes:
        """The ids of a chunk that is longer than a block, block by block: a number of eight bytes for each character is
        all that is kept of the blocks before."""
        last, back = np.full(len(chunk) + 1, NONE, np.int32), np.zeros(len(chunk) + 1, np.int32)
        stay, base = self.stay, len(self.pieces) + 1
        for at in range(0, len(chunk), BLOCK):
            to, before = min(len(chunk), at + BLOCK), max(0, at - self.longest)
            text = np.frombuffer(chunk[before:to].encode("utf-32-le"), np.uint32)
            place = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
            end, start, piece = self.edges(np.where(self.alphabet[place] == text, place + 2, 1).astype(np.uint64))
            first = np.searchsorted(end, np.arange(len(text) + 2)).tolist()
            start, piece = start.tolist(), piece.tolist()
            now, whence = last[before : to + 1].tolist(), [0] * (len(text) + 1)
            for e in range(at - before + 1, len(text) + 1):
                for k in range(first[e], first[e + 1]):
                    s = start[k]
                    key = (now[s] + 1) * base + piece[k]
                    ok = stay.get(key)
                    if ok is None:
                        ok = stay[key] = self._stays(now[s], piece[k])
                    if ok:
                        now[e], whence[e] = piece[k], s
                        break
                else:  # no piece has this character
                    now[e], whence[e] = NONE, e - 1
            last[at + 1 : to + 1] = now[at - before + 1 :]
            back[at + 1 : to + 1] = np.array(whence[at - before + 1 :]) + before
            if len(stay) > VERDICTS:
                stay.clear()
        ids, e = array("I"), len(chunk)
        while e > 0:
            if last[e] >= 0:
                ids.append(int(last[e]))
            else:
                ids.extend(self._unknown(chunk[e - 1]))
            e = int(back[e])
        return np.array(ids[::-1], "<u4").tobytes()

    def _unknown(self, character: str) -> list[int]:
        """The ids of a character that no piece has, last one first."""
        return [self.byte_ids[b] for b in reversed(character.encode())] if self.byte_ids[0] != self.unknown else [self.unknown]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(chunks):
            if len(chunks[at]) > BLOCK:
                out.append(self._long(chunks[at]))
                at += 1
                continue
            size, to = 0, at
            while to < len(chunks) and (to == at or size + len(chunks[to]) < BLOCK):
                size += len(chunks[to]) + 1
                to += 1
            out += self._block(chunks[at:to])
            at = to
        return out

    def remembered(self, chunks: list[str]) -> list[bytes]:
        got, missing = self.known.many(chunks)
        lacking = [chunks[i] for i in missing]
        found = self.encode_chunks(lacking)
        for i, v in zip(missing, found, strict=True):
            got[i] = v
        self.known.put({k: v for k, v in zip(lacking, found, strict=True) if len(k) <= LONGEST_KEY})
        self.known.turn()
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each)."""
        whole, marked = {}, []
        for i, t in enumerate(texts):
            if not t:
                marked.append("")
            elif "\0" in t:
                whole[i] = SPACE + t.replace(" ", SPACE)
                marked.append("")
            elif "  " in t or SPACE in t or t[0] == " ":
                marked.append("\0".join(_BREAK.split((SPACE + t.replace(" ", SPACE)).replace("\n", "\0\n\0"))))
            else:
                marked.append(SPACE + t.replace(" ", f"\0{SPACE}").replace("\n", "\0\n\0"))
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), "\0")
        coded = lists.values.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        got = self.remembered(strings(coded.dictionary))
        flat = np.frombuffer(b"".join(got), "<u4")
        n = np.fromiter(map(len, got), np.int64, len(got)) // 4
        each = n[index]
        reached = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat((np.cumsum(n) - n)[index] - reached[:-1], each) + np.arange(reached[-1])]
        bounds = reached[lists.offsets.to_numpy()]
        if whole:
            rows = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i, t in whole.items():
                rows[i] = np.frombuffer(self.encode_chunks([t])[0], "<u4")
            ids, bounds = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts in UTF-8, without the space that encoding puts first."""
        n = self.piece_length[ids]
        reached = np.concatenate(([0], np.cumsum(n)))
        data = self.piece_bytes[np.repeat(self.piece_start[ids] - reached[:-1], n) + np.arange(reached[-1])].tobytes()
        ends = reached[bounds].tolist()
        return [data[a + 1 : b] if data[a : a + 1] == b" " else data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def coder(vocabulary: str) -> PieceCoder:
    """One per worker process, kept between tasks."""
    return worker_cache(("pieces", vocabulary), lambda: PieceCoder(vocabulary))


def encode_pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(key, n_ids, ids_crc32, ids, reads_back): the ids of each whole text, their CRC-32 as little-endian 32-bit
    integers, and whether decoding them gives the text again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = text_column(part, "text").to_pylist()
                ids, bounds = pieces.encode(texts)
                back = [a == b.encode() for a, b in zip(pieces.decode(ids, bounds), texts, strict=True)]
                flat, ends = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), lists, pa.array(back, pa.bool_())], [key, "n_ids", "ids_crc32", "ids", "reads_back"])

    source = documents.select(F.col(key), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(encode, f"`{key}` {source.schema[0].dataType.simpleString()}, n_ids long, ids_crc32 long, ids array<int>, reads_back boolean")


def decode_pieces(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(key, text) from arrays of ids; a null array gives the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = coder(vocabulary)
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
            texts = pieces.decode(np.concatenate(rows) if rows else np.zeros(0, np.int64), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], [key, "text"])

    source = encoded.select(F.col(key), F.col(ids).cast("array<int>").alias("ids"))
    return source.mapInArrow(decode, f"`{key}` {source.schema[0].dataType.simpleString()}, text string")
