"""Jaccard join of word shingles by PartEnum signatures, down to connected components.

A document's set holds the 64-bit hashes of its distinct runs of ``WORDS`` words.  Sizes are cut into bands that grow
by 1 / 0.8, so that sets as similar as 0.8 are in one band or in neighbouring ones; a scheme for each pair of
neighbours says in how many elements, k, such sets may differ at most.  It cuts the domain of hashes into more than
k / 2 groups of ``PARTS`` parts each.  Some group holds one difference at most, so similar sets agree on two of its three
parts at least: the signatures of a set are the hashes of what it has in every pair of parts of a group.  Pairs of
empty parts say little and are left out, unless a set has so many that another set could agree with it on those
alone: nothing similar is missed.

Sets that are equal are joined first and represented by their smallest key.  Sets with a common signature form a
bucket.  Signatures that a sample of the documents shows to be hot are salted, so that no task ever holds a whole
bucket that is large; the sample only says how many salts.  A task looks at one block of a bucket, or at two, and
compares bit parities of the sets, whose number of different bits never exceeds the number of different elements.  In a
first round, over single blocks, it passes on a spanning forest of the pairs that remain, which is verified on the sets.
In a second round, over single blocks and pairs of blocks of buckets that aren't one component by then, it passes on
every remaining pair whose members aren't yet in one component.  So no link between components is lost, and a group of
copies costs about as many verified pairs as it has members.

Documents without words have no set and no links.  Null keys have no component; rows repeated under one key are one
document, linked by any of its texts.  Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmend.llm._shared import Scratch, drop_caches, fresh, slices, stored, strings, text_column
from trackmend.llm.components import components

WORDS, PERCENT = 5, 80
#: Parts of a group, of which similar sets agree on all but one in some group.
PARTS = 3
#: Partitions of the domain that a set is tried under, if too many of its pairs of parts are empty: chances are below a
#: half in each, so about one set in 2 ** TURNS, if that, has to be found by empty pairs.
TURNS = 32
#: Elements of sets that are signed together.
TOGETHER = 1 << 19
#: Members of a block of a bucket at most, and bytes of their parities.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
#: One document in so many tells which signatures are hot; members that it must find; cells that hot signatures share.
SAMPLE, HOT, CELLS = 64, 32, 1 << 20
#: Edges of one member in a spanning forest, about.
HUB = 64
#: Bits of a signature that number the pair of parts; above them stands the scheme, below them the hash.
NUMBER_BITS = 25
#: A-Z become a-z and white space a space, byte by byte, which leaves the rest of UTF-8 as it is.
_FOLDED = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRIME = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words, the one of all its words."""
    import xxhash

    spaced = pa.array([t.encode().translate(_FOLDED) for t in texts.to_pylist()], pa.large_binary()).view(pa.large_string())
    lists = pc.split_pattern(spaced, " ")
    coded = lists.values.dictionary_encode()
    # white space in a row, or at either end, leaves empty words
    each = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in strings(coded.dictionary)], np.uint64)
    flat = each[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    reached = np.concatenate(([0], np.cumsum(flat != 0)))
    bounds = reached[lists.offsets.to_numpy()].tolist()
    flat = flat[flat != 0]
    n = max(0, len(flat) - WORDS + 1)
    rolled = _mix(sum((flat[i : i + n] * _PRIME[i] for i in range(WORDS)), np.zeros(n, np.uint64)))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        else:
            words = flat[a:b]
            out.append(_mix(np.array([(words * _PRIME[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)) if b > a else words)
    return out


class Schemes:
    """Bands of set sizes and, for each band with the next one, its partition of the domain."""

    def __init__(self):
        self.low = [1]
        self.made: dict[int, tuple[int, int, np.ndarray]] = {}

    def band(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * 100 // PERCENT + 1)
        return bisect.bisect_right(self.low, size) - 1

    def most(self, b: int) -> int:
        """The largest size in a band."""
        while len(self.low) < b + 2:
            self.low.append(self.low[-1] * 100 // PERCENT + 1)
        return self.low[b + 1] - 1

    def scheme(self, b: int) -> tuple[int, int, np.ndarray]:
        """(differences allowed, words of 64 parity bits, lower bounds of the parts)."""
        if b not in self.made:
            most = self.most(b)
            # r + s - 2 * common, with common >= 0.8 * union
            k = (most + most * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
            parts = PARTS * (k // 2 + 1 + k // 24) if k else 0
            self.made[b] = k, -(-2 * most // 64), np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        return self.made[b]

    def of(self, size: int) -> list[int]:
        """The schemes of a set; none where only equal sets are similar."""
        b = self.band(size)
        return [x for x in ((b - 1, b) if b else (b,)) if self.scheme(x)[0]]

    def signatures(self, s: np.ndarray, b: int) -> np.ndarray:
        """Those of one set."""
        return self.signatures_of(s, np.array([len(s)]), b)[0]

    def signatures_of(self, flat: np.ndarray, sizes: np.ndarray, b: int) -> list[np.ndarray]:
        """For each of the sorted sets that ``flat`` holds one after another, a 32-bit hash for each pair of parts of a
        group, under scheme ``b``; 0 for pairs that are left out.  With the scheme and its number a hash makes the
        signature; equal hashes of different elements only add pairs to verify.

        Similar sets agree on ``2 * groups - k`` pairs at least.  A set with fewer empty ones agrees on one that isn't, so
        its empty pairs are left out.  Of a set with more, all pairs that it agrees on with a similar one may be empty;
        but then they are empty in that one too, which thus has as many.  Such sets meet in a further turn, under another
        partition of the domain, and so on; a set's last turn is the first in which its empty pairs are few enough.
        """
        k, _, lower = self.scheme(b)
        enough = 2 * (len(lower) + 1) // PARTS - k
        out: list[list[np.ndarray]] = [[] for _ in sizes]
        which = np.arange(len(sizes))
        for turn in range(TURNS):
            if turn:
                flat = _mix(flat + np.uint64(turn * int(_PRIME[4]) % (1 << 64)))
                flat = flat[np.lexsort((flat, np.repeat(np.arange(len(sizes)), sizes)))]
            h, empty = self._turn(flat, sizes, lower)
            few = empty.sum(1) < enough
            h[empty & (few[:, None] | (turn < TURNS - 1))] = 0
            for i, row in zip(which.tolist(), h, strict=True):
                out[i].append(row)
            if few.all():
                break
            flat, which, sizes = flat[np.repeat(~few, sizes)], which[~few], sizes[~few]
        return [rows[0] if len(rows) == 1 else np.concatenate(rows) for rows in out]

    @staticmethod
    def _turn(flat: np.ndarray, sizes: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a hash, whether it is empty) of each set and each pair of parts of a group."""
        parts = len(lower) + 1
        # cells are in order, so each is a run of elements
        cell = np.searchsorted(lower, flat, side="right") + np.repeat(np.arange(len(sizes)) * parts, sizes)
        size = np.bincount(cell, minlength=len(sizes) * parts)
        ends = np.concatenate(([0], np.cumsum(size)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(flat ^ _PRIME[3]), dtype=np.uint64)))[ends]
        size, held = size.reshape(len(sizes), -1, PARTS), (sums[1:] - sums[:-1]).reshape(len(sizes), -1, PARTS)
        following = [1, 2, 0]
        h = (_mix(held * _PRIME[0] + held[..., following] * _PRIME[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        h[h == 0] = 1
        return h.reshape(len(sizes), -1), (size + size[..., following] == 0).reshape(len(sizes), -1)

    def block(self, b: int) -> int:
        """Members of a block under scheme ``b``, whose parities have a quarter byte for each element of the largest set."""
        return min(BLOCK, max(16, 4 * BLOCK_BYTES // self.most(b)))

    def parities(self, flat: np.ndarray, sizes: np.ndarray, b: int) -> np.ndarray:
        """The bit parities of each set, a row of bytes each."""
        bits = 64 * self.scheme(b)[1]
        at = ((_mix(flat ^ _PRIME[1]) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
        count = np.bincount(at.astype(np.int64) + np.repeat(np.arange(len(sizes)) * bits, sizes), minlength=len(sizes) * bits)
        return np.packbits((count & 1).astype(np.uint8).reshape(len(sizes), bits), axis=1)

    def marks(self, sets: list[np.ndarray]) -> list[list[tuple[int, np.ndarray, bytes]]]:
        """(scheme, signatures, parities) of each set, for each of its schemes; sets of one scheme are taken together."""
        out: list[list[tuple[int, np.ndarray, bytes]]] = [[] for _ in sets]
        by = defaultdict(list)
        for i, s in enumerate(sets):
            for b in self.of(len(s)) if len(s) else ():
                by[b].append(i)
        for b in sorted(by):
            at, taken = 0, by[b]
            while at < len(taken):
                held, to = 0, at
                while to < len(taken) and (to == at or held + len(sets[taken[to]]) <= TOGETHER):
                    held, to = held + len(sets[taken[to]]), to + 1
                some = [sets[i] for i in taken[at:to]]
                flat, sizes = np.concatenate(some), np.array([len(s) for s in some])
                for i, h, p in zip(taken[at:to], self.signatures_of(flat, sizes, b), self.parities(flat, sizes, b), strict=True):
                    out[i].append((b, h, p.tobytes()))
                at = to
        return out


def _described(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, set_hash, marks): of each set, its scheme's number, signatures and parities."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        drop_caches()
        schemes = Schemes()
        kind = pa.list_(pa.struct([("scheme", pa.int32()), ("hashes", pa.list_(pa.int32())), ("parity", pa.binary())]))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = shingle_sets(text_column(part, "text"))
                marks = schemes.marks(sets)
                flat = [m for one in marks for m in one]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(m[1]) for m in flat]), pa.int32()), pa.array(np.concatenate([m[1] for m in flat]) if flat else np.zeros(0, np.int32)))
                structs = pa.StructArray.from_arrays([pa.array([m[0] for m in flat], pa.int32()), lists, pa.array([m[2] for m in flat], pa.binary())], fields=list(kind.value_type))
                nested = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(m) for m in marks]), pa.int32()), structs)
                hashes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), hashes, nested], ["key", "n_shingles", "set_hash", "marks"])

    source = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(describe, "key long, n_shingles long, set_hash binary, marks array<struct<scheme:int,hashes:array<int>,parity:binary>>")


def _near(parity: np.ndarray, size: np.ndarray, comp: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each member, the later ones that it may be similar to (and whose component differs)."""
    m, bound = len(parity), (100 - PERCENT) / (100 + PERCENT)
    step = max(1, (1 << 18) // max(1, m))
    words = np.ascontiguousarray(parity.T)
    for at in range(0, m, step):
        to = min(m, at + step)
        differ = np.zeros((to - at, m - at), np.int32)
        for word in words:  # long rows of one word each: much faster than short sums
            differ += np.bitwise_count(word[at:to, None] ^ word[None, at:])
        ok = differ <= (size[at:to, None] + size[None, at:]) * bound + 1e-9
        if comp is not None:
            ok &= comp[at:to, None] != comp[None, at:]
        for i in range(to - at):
            yield at + i, np.flatnonzero(ok[i, i + 1 :]) + at + i + 1


def _forest(keys: np.ndarray, parity: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect all that near pairs connect, from members with many near ones first, then small keys.  A member
    that would get many edges passes most of them on to the first of each class of keys, so that no key is hot when edges
    are verified.  Classes don't depend on the bucket: buckets that share their members share most edges as well."""
    m = len(parity)
    near = np.zeros((m, m), bool)
    for i, js in _near(parity, size, None):
        near[i, js] = near[js, i] = True
    many = np.frexp(near.sum(1))[1]
    mixed = _mix(keys.view(np.uint64))
    root = np.arange(m)
    out = []
    for i in np.lexsort((keys, -many)):
        new = []
        for j in np.flatnonzero(near[i] & (root != root[i])):
            if root[j] != root[i]:
                new.append(int(j))
                root[root == root[j]] = root[i]
        bits = np.uint64(64 - max(0, len(new) - 1).bit_length() + HUB.bit_length() - 1)
        leads: dict[int, int] = {}
        for j in new:
            hub = leads.setdefault(int(mixed[j] >> bits) if bits < 64 else 0, j)
            out.append((hub, j) if hub != j and near[hub, j] else (int(i), j))
    return out


def _candidates(buckets: DataFrame, forest: bool) -> DataFrame:
    """(a, b): pairs of members of (bucket, key, n_shingles, parity[, component]) to verify."""

    def pairs_of(rows: pa.Table) -> list[tuple[int, int]]:
        rows = rows.take(pc.sort_indices(rows.column("key")))
        keys = rows.column("key").to_numpy()
        parity = np.frombuffer(b"".join(rows.column("parity").to_pylist()), np.uint64).reshape(len(keys), -1)
        size = rows.column("n_shingles").to_numpy()
        if forest:
            return [(int(keys[i]), int(keys[j])) for i, j in _forest(keys, parity, size)]
        return [(int(keys[i]), int(keys[j])) for i, js in _near(parity, size, rows.column("component").to_numpy()) for j in js]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table) -> pa.RecordBatch:
            bucket = table.column("bucket").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            found = {(min(p), max(p)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1 for p in pairs_of(table.slice(a, b - a))}
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            table = table.combine_chunks()
            if not table.num_rows:
                continue
            bucket = table.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1], side="left"))
            if last:
                yield done(table.slice(0, last))
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield done(held)

    dealt = buckets.repartition("bucket")
    if not forest:  # buckets of one component have nothing to pass on
        whole = Window.partitionBy("bucket")
        dealt = dealt.withColumn("_least", F.min("component").over(whole)).withColumn("_most", F.max("component").over(whole)).where("_least <> _most").drop("_least", "_most")
    return dealt.sortWithinPartitions("bucket").mapInArrow(work, "a long, b long").distinct()


def _verified(documents: DataFrame, pairs: DataFrame, key: str, text: str, bits: int = 24) -> DataFrame:
    """The pairs whose sets are similar.  Sets are built again for documents that a bitmap of fixed size lets pass."""
    spark = documents.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    cells = wanted.select(F.pmod(F.xxhash64("key"), F.lit(1 << bits)).alias("c")).select(F.shiftright("c", 6).alias("w"), F.expr("shiftleft(1L, int(c & 63))").alias("x"))
    words = np.zeros(1 << (bits - 6), np.uint64)
    for r in cells.groupBy("w").agg(F.bit_or("x").alias("x")).collect():  # 2**18 rows at most
        words[r.w] = np.uint64(r.x & 0xFFFFFFFFFFFFFFFF)
    bitmap = spark.sparkContext.broadcast(words.view(np.uint8).tobytes())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        bits_ = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            cell = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(((bits_[cell >> 3] >> (cell & 7)) & 1).astype(bool)))
            for part in slices(batch, "text"):
                sets = shingle_sets(text_column(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "set"])

    source = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null")
    source = source.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(1 << bits)))
    sets = source.mapInArrow(build, "key long, set binary").join(wanted, "key", "left_semi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common > 0 and 100 * common >= PERCENT * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _blocks(reps: DataFrame) -> DataFrame:
    """(signature, block, keys): the members of buckets of two or more, in blocks."""
    schemes = Schemes()
    sizes = F.array(*[F.lit(schemes.block(b)) for b in range(100)])  # a set of 2**31 elements has scheme 96
    # a number wraps around only in sets of over 80 million elements, which adds pairs to verify
    number = F.col("number").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)).cast("long")
    signature = F.shiftleft(F.col("scheme").cast("long"), NUMBER_BITS + 32).bitwiseOR(F.shiftleft(number, 32)).bitwiseOR(F.col("hash").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))

    def signed(rows: DataFrame) -> DataFrame:
        return rows.select("key", "scheme", F.posexplode("hashes").alias("number", "hash")).where("hash <> 0").select(signature.alias("signature"), "key")

    def cell() -> Column:
        return F.pmod(F.xxhash64("signature"), F.lit(CELLS))

    size = sizes[F.shiftrightunsigned("signature", NUMBER_BITS + 32).cast("int")]
    seen = signed(reps.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)).groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT)
    hot = seen.select(cell().alias("cell"), F.ceil(F.col("n") * SAMPLE / size).alias("salts")).groupBy("cell").agg(F.max("salts").alias("salts")).collect()  # CELLS rows at most
    rows = signed(reps)
    if hot:
        table = reps.sparkSession.createDataFrame([(r.cell, r.salts) for r in hot], "cell long, salts long")
        rows = rows.withColumn("cell", cell()).join(F.broadcast(table), "cell", "left")
        rows = rows.select("signature", "key", F.coalesce(F.pmod(F.xxhash64("key", "signature"), F.col("salts")), F.lit(-1)).alias("salt"))
    else:
        rows = rows.withColumn("salt", F.lit(-1).cast("long"))
    placed = Window.partitionBy("signature", "salt").orderBy("key")
    rows = rows.select("signature", "salt", "key", F.row_number().over(placed).alias("place"), (F.lag("key").over(placed).isNotNull() | F.lead("key").over(placed).isNotNull() | (F.col("salt") >= 0)).alias("shared"))
    rows = rows.where("shared").select("signature", "salt", F.floor((F.col("place") - 1) / size).alias("slice"), "key")
    return rows.groupBy("signature", "salt", "slice").agg(F.sort_array(F.collect_list("key")).alias("keys")).select("signature", F.struct("salt", "slice").alias("block"), "keys")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row: size of its set, smallest key that links reach from it."""
    scratch = Scratch(documents.sparkSession)
    scratch.release()  # of what was shuffled before
    rows = scratch.stored(_described(documents, key, text), "shingles")
    nodes = rows.where("key is not null and set_hash is not null")
    small = nodes.select("key", "set_hash")
    # the smallest key of each set that several rows have; both sides of the join are dealt anew, so that AQE can split it
    copied = scratch.stored(small.groupBy("set_hash").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("set_hash", "rep"), "copied-sets")
    same = stored(small.join(copied, "set_hash", "left").select("key", F.coalesce("rep", "key").alias("rep")).distinct(), "equal-sets")
    # texts under one key join their sets
    tied = same.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    tied = same.join(tied.select(F.col("a").alias("least")).distinct(), same["rep"] == F.col("least"), "left_semi").select("key").join(same, "key").groupBy("key").agg(F.min("rep").alias("a")).join(same, "key").select("a", F.col("rep").alias("b")).where("a <> b")

    # the join and the distinct deal rows by the same key: marks move once
    reps = nodes.join(same.where("key = rep").select("key"), "key", "left_semi").dropDuplicates(["key", "set_hash"]).select("key", "n_shingles", F.explode("marks").alias("mark"))
    reps = reps.select("key", "n_shingles", "mark.scheme", "mark.hashes", "mark.parity")
    blocks = scratch.stored(_blocks(reps), "blocks")
    scheme = F.shiftrightunsigned("signature", NUMBER_BITS + 32).cast("int").alias("scheme")

    def listed(groups: DataFrame) -> DataFrame:
        """(bucket, scheme, key) of lists of keys; equal ones are looked at once."""
        groups = groups.distinct().select("scheme", "keys", F.xxhash64("scheme", "keys").alias("bucket"))
        return groups.select("bucket", "scheme", F.explode("keys").alias("key")).distinct()

    def with_parity(members: DataFrame) -> DataFrame:
        return members.join(reps.select("key", "scheme", "n_shingles", "parity"), ["key", "scheme"]).select("bucket", "key", "n_shingles", "parity")

    buckets = scratch.stored(with_parity(listed(blocks.where("size(keys) > 1").select(scheme, "keys"))), "buckets")
    first = scratch.stored(_candidates(buckets, True), "candidates")
    links = scratch.stored(_verified(documents, first, key, text).unionByName(tied), "links")
    comp = components(links)

    def labelled(members: DataFrame) -> DataFrame:
        return members.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))

    # buckets of several blocks whose members aren't all in one component
    several = blocks.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("signature")
    split = blocks.join(several, "signature", "left_semi")
    apart = labelled(split.select("signature", F.explode("keys").alias("key"))).groupBy("signature").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("signature")
    split = split.join(apart, "signature", "left_semi")
    left, right = (split.select("signature", F.col("block").alias(f"{n}_block"), F.col("keys").alias(f"{n}_keys")) for n in ("left", "right"))
    crossed = left.join(right, "signature").where("left_block < right_block").select(scheme, F.concat("left_keys", "right_keys").alias("keys"))
    every = labelled(buckets)
    if not crossed.isEmpty():
        every = every.unionByName(labelled(with_parity(listed(crossed))))
    second = scratch.stored(_candidates(every, False).join(first, ["a", "b"], "left_anti"), "candidates")
    if not second.isEmpty():
        links = scratch.stored(links.unionByName(_verified(documents, second, key, text)), "links")
        comp = components(links)
    sizes = stored(rows.select("key", "n_shingles"), "set-sizes")
    scratch.clear()
    least = same.join(comp, F.col("rep") == F.col("node"), "left").groupBy("key").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sizes.join(least, "key", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"))


def drop_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, that with the smallest key, with all its columns; of rows repeated under that key, the
    longest text's.  Rows with a null key stay."""
    found = near_duplicates(documents, key, text).where(F.col(key).isNotNull())
    mark, n, row = (fresh(documents, c) for c in ("_key", "_n", "_row"))
    marks = found.groupBy(F.col(key).alias(mark)).agg(F.count(F.lit(1)).alias(n), F.min("component_id").alias("least"))
    marks = stored(marks.select(mark, F.when(F.col(mark) == F.col("least"), F.col(n)).otherwise(0).alias(n)).where(F.col(n) != 1), "near-marks")
    marked = documents.join(marks, F.col(key) == F.col(mark), "left").where(F.col(n).isNull() | (F.col(n) > 0))
    order = [F.desc(F.length(text)), *[F.col(c).cast("string") for c in documents.columns]]
    one = marked.where(F.col(n).isNotNull()).withColumn(row, F.row_number().over(Window.partitionBy(mark).orderBy(*order))).where(F.col(row) == 1)
    return marked.where(F.col(n).isNull()).select(documents.columns).unionByName(one.select(documents.columns))
