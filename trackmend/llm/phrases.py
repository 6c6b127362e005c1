"""Collocations: phrases of 2 to 5 words that stand together more often than their parts would, by language.

Texts are lower-cased (A-Z), split into pieces at sentence marks and line ends, and pieces into words.  All sequences of
one length are counted in one pass, the shorter ones first:

* a task counts the sequences of its shard, sorts them, and builds incrementally a weighted acyclic automaton for each
  range of sequences that start alike (``automaton``); these byte strings, not the sequences, are shuffled;
* a task that has a range unites its automata, adds up the weights, and keeps what is frequent as one automaton;
* the next pass looks only at places where both shorter sequences may be frequent, which a bitmap of fixed size tells.
  The bitmap lets too much pass where it is crowded, never too little: counts are exact at any size.

A candidate is then cut in two at every place; requests for the counts of its parts go to the ranges of these parts,
where they are composed with the automata.  Ranges that are asked for much are dealt out with salts.

The ranges are chosen from a bounded sample of documents and are as many as the text has ``RANGE`` bytes; they decide
where sequences are added up, never what is found.  Sequences longer than a piece aren't counted, overlapping ones are.

Null texts count as empty, a null language as ``und``.  Rows that are repeated count as often as they stand there.
Scores are exact; equal scores rank by count, then by the phrase.  An empty table gives an empty result; columns
besides text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmend.llm._shared import Scratch, drop_caches, slices, strings, text_column
from trackmend.llm.automaton import Automaton, Union, automata_by_range, build, ranges_of, sorted_words, summed

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text that one range stands for, about.
RANGE = 32 << 20
#: Documents that the ranges are chosen from, one in so many of their places, and bytes of a word in a bound.
SAMPLED, THINNED, BOUND = 4096, 61, 32
#: Distinct sequences and words that a shard holds before it is passed on.
SHARD, SHARD_WORDS = 3_000_000, 1_000_000
#: Characters of text that are looked at together.
SLICE = 4 << 20
#: Requests that one task answers at once, about; bits of the bitmap at most, and for each frequent sequence.
ASKED, BITS, BITS_EACH = 200_000, 27, 16
#: A-Z become a-z, a tab a space, and whatever ends a piece a line feed.
_FOLDED = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK = b"\n"
_PRIME = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_AUTOMATA = "lang string, range int, length int, data binary, total long, frequent long"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, the words of all texts as indices into them, with -1 where a piece ends)."""
    folded = b" \n ".join(t.encode().translate(_FOLDED).replace(b"\n", b" \n ") for t in texts.to_pylist())
    lists = pc.split_pattern(pa.array([folded], pa.large_binary()).view(pa.large_string()), " ")
    coded = lists.values.dictionary_encode()
    words = coded.dictionary.view(pa.large_binary())
    flat = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.arange(len(words))
    kept = ~np.isin(np.array(strings(coded.dictionary), object), ["", "\n"]) if len(words) else np.zeros(0, bool)
    number = np.where(kept, np.cumsum(kept) - 1, -2)
    for i, w in enumerate(strings(coded.dictionary)) if not kept.all() else ():
        if w == "\n":
            number[i] = -1
    flat = number[flat]
    return words.filter(pa.array(kept, pa.bool_())), flat[flat != -2]


def _word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)


def _gram_hashes(hashes: np.ndarray, grams: np.ndarray, lang: str) -> np.ndarray:
    import xxhash

    h = np.full(len(grams), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for j in range(grams.shape[1]):
        h += hashes[grams[:, j]] * _PRIME[j % len(_PRIME)] + np.uint64(j)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Bitmap:
    """Which hashes may be there."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits, self.cells = bits, cells

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.cells[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def grams_at(flat: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    return np.stack([flat[starts + j] for j in range(length)], 1) if len(starts) else np.zeros((0, length), np.int64)


def candidate_places(flat: np.ndarray, length: int) -> np.ndarray:
    """Where a sequence of ``length`` words begins that no end of a piece cuts."""
    if len(flat) < length:
        return np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(flat < 0)))
    return np.flatnonzero(ends[length:] == ends[: len(flat) - length + 1])


class _Shard:
    """The sequences of one language that a task has counted and not yet passed on."""

    def __init__(self, length: int):
        self.length, self.known = length, {}
        self.words: list[bytes] = []
        self.grams, self.counts, self.held = [], [], 0

    def add(self, words: pa.Array, grams: np.ndarray) -> None:
        grams, counts = summed(grams, np.ones(len(grams), np.int64), len(words))
        used = np.unique(grams)
        place = np.zeros(len(words), np.int64)
        for i, w in zip(used.tolist(), words.take(pa.array(used)).to_pylist(), strict=True):
            number = self.known.get(w)
            if number is None:
                number = self.known[w] = len(self.words)
                self.words.append(w)
            place[i] = number
        self.grams.append(place[grams])
        self.counts.append(counts)
        self.held += len(counts)

    def combine(self) -> None:
        grams, counts = summed(np.concatenate(self.grams), np.concatenate(self.counts), len(self.words))
        self.grams, self.counts, self.held = [grams], [counts], len(counts)

    def automata(self, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, bytes]]:
        self.combine()
        return automata_by_range(*sorted_words(pa.array(self.words, pa.large_binary()), self.grams[0], self.counts[0]), bounds)


def _counted(source: DataFrame, length: int, bitmap: Bitmap | None, bounds: list[tuple[bytes, ...]]) -> DataFrame:
    """(lang, range, data): the automata of shards."""
    spark = source.sparkSession
    given = spark.sparkContext.broadcast((bitmap, bounds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        filter_, limits = given.value
        shards: dict[str, _Shard] = {}

        def passed(lang: str) -> Iterator[pa.RecordBatch]:
            for number, data in shards.pop(lang).automata(limits):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([number], pa.int32()), pa.array([data], pa.binary())], ["lang", "range", "data"])

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                langs = part.column(0).dictionary_encode()
                for number, lang in enumerate(langs.dictionary.to_pylist()):
                    words, flat = split_words(text_column(part, "text").filter(pc.equal(langs.indices, number)))
                    starts = candidate_places(flat, length)
                    if filter_ is not None:
                        hashes = _word_hashes(words)
                        short = candidate_places(flat, length - 1)
                        ok = np.zeros(len(flat) + 1, bool)
                        ok[short] = filter_(_gram_hashes(hashes, grams_at(flat, length - 1, short), lang))
                        starts = starts[ok[starts] & ok[starts + 1]]
                    if len(starts):
                        shards.setdefault(lang, _Shard(length)).add(words, grams_at(flat, length, starts))
                    if sum(s.held for s in shards.values()) > SHARD:
                        for shard in shards.values():
                            shard.combine()
                        while sum(s.held for s in shards.values()) > SHARD // 2:
                            yield from passed(max(shards, key=lambda name: shards[name].held))
                    while sum(len(s.words) for s in shards.values()) > SHARD_WORDS:
                        yield from passed(max(shards, key=lambda name: len(shards[name].words)))
        for lang in list(shards):
            yield from passed(lang)

    return source.mapInArrow(count, "lang string, range int, data binary")


def _united(automata: DataFrame, length: int, least: int) -> DataFrame:
    """One automaton for each language and range, of the sequences that are counted ``least`` times or more; ``total``
    is the sum of all counts."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        now, union, total = None, None, 0

        def done() -> pa.RecordBatch:
            words, grams, counts = union.result(least)
            arrays = [pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([length], pa.int32()), pa.array([build(words, grams, counts)], pa.binary()), pa.array([total], pa.int64()), pa.array([len(counts)], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "range", "length", "data", "total", "frequent"])

        for batch in batches:
            for lang, number, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                of = lang.as_py(), number.as_py()
                if of != now:
                    if now is not None:
                        yield done()
                    now, union, total = of, Union(length), 0
                data = data.as_py()
                total += int(Automaton(data).paths()[1].sum()) if length == 1 else 0
                union.add(data)
        if now is not None:
            yield done()

    return automata.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(unite, _AUTOMATA)


def _bitmap(spark: SparkSession, automata: DataFrame, frequent: int) -> Bitmap:
    """Of the sequences in ``automata``: a bit for each cell, in words of 64, at most 2 ** (BITS - 6) rows."""
    bits = min(BITS, max(16, (frequent * BITS_EACH).bit_length()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column(0), batch.column(1), strict=True):
                one = Automaton(data.as_py())
                h = _gram_hashes(_word_hashes(one.words), one.paths()[0], lang.as_py())
                at = np.unique(h >> np.uint64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.diff(at >> 6, prepend=-1))
                word = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(at[first] >> 6), pa.array(word.view(np.int64))], ["w", "x"])

    found = automata.select("lang", "data").mapInArrow(cells, "w long, x long").groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("w").to_numpy()] = found.column("x").to_numpy()
    return Bitmap(bits, words.view(np.uint8))


def _bounds(source: DataFrame) -> list[tuple[bytes, ...]]:
    """Where the ranges of sequences begin, but for the first one."""
    spark = source.sparkSession
    size = source.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.bytes or 0) // RANGE))
    share = min(1.0, SAMPLED / max(1, size.n))
    some = source.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) <= int(share * (1 << 40)))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, flat = split_words(text_column(part, "text"))
                places = candidate_places(flat, 1)[::THINNED]
                spelt = words.to_pylist()
                out = []
                for at in places.tolist():
                    run = flat[at : at + LONGEST].tolist()
                    run = run[: run.index(-1)] if -1 in run else run
                    out.append([spelt[i][:BOUND] for i in run])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], ["words"])

    found = some.select("text").mapInArrow(starts, "words array<binary>").orderBy(F.xxhash64("words")).limit(SAMPLED * 16).collect()
    places = sorted(tuple(bytes(w) for w in r.words) for r in found)
    bounds = {places[len(places) * i // ranges] for i in range(1, ranges)} if places else set()
    return sorted(bounds)


def _requests(automata: DataFrame, bounds: list[tuple[bytes, ...]]) -> DataFrame:
    """(lang, range, length, phrase, a, cut, rest, part): for each frequent sequence of two words or more, its parts
    and where their counts are."""
    given = automata.sparkSession.sparkContext.broadcast(bounds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = given.value
        for batch in batches:
            for lang, data in zip(batch.column(0), batch.column(1), strict=True):
                one = Automaton(data.as_py())
                grams, counts = one.paths()
                spelt = np.array([w.decode() for w in one.words.to_pylist()], object)
                for at in range(0, len(grams), 50_000):
                    some, times = grams[at : at + 50_000], counts[at : at + 50_000]
                    phrases = [" ".join(p) for p in spelt[some].tolist()]
                    for k in range(1, one.length):
                        for rest, part in ((False, some[:, :k]), (True, some[:, k:])):
                            distinct, _ = summed(part, np.ones(len(part), np.int64), len(spelt))
                            cuts = ranges_of(one.words, distinct, limits)
                            number = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                            where = {tuple(g): r for g, r in zip(distinct.tolist(), number.tolist(), strict=True)}
                            rows = [where[tuple(g)] for g in part.tolist()]
                            n = len(part)
                            words = pa.array(spelt[part].tolist(), pa.list_(pa.string()))
                            columns = [pa.array([lang.as_py()] * n), pa.array(rows, pa.int32()), pa.array([part.shape[1]] * n, pa.int32()), pa.array(phrases), pa.array(times), pa.array([k] * n, pa.int32()), pa.array([rest] * n), words]
                            yield pa.RecordBatch.from_arrays(columns, ["lang", "range", "length", "phrase", "a", "cut", "rest", "part"])

    kind = "lang string, range int, length int, phrase string, a long, cut int, rest boolean, part array<string>"
    return automata.where("length > 1 and frequent > 0").select("lang", "data").mapInArrow(cut, kind)


def _answers(automata: DataFrame, requests: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, phrase, a, cut, rest, part, times): the requests with the counts of their parts."""
    place = ["lang", "range", "length"]
    busy = requests.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("salts"))
    busy = scratch.stored(busy, "asked")
    dealt = requests.join(busy, place).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.col("salts")).cast("int")).drop("salts")
    copies = automata.select(*place, "data").join(busy, place).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    both = copies.withColumn("asks", F.lit(False)).unionByName(dealt.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    both = both.select(*place, "salt", "asks", "data", "phrase", "a", "cut", "rest", "part").repartition(*place, "salt").sortWithinPartitions(*place, "salt", "asks")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        one: Automaton | None = None
        for batch in batches:
            asks = batch.column(4).to_numpy(zero_copy_only=False)
            cut = [0, *np.flatnonzero(~asks).tolist(), len(asks)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                run = batch.slice(a, b - a)
                if a < b and not asks[a]:  # an automaton stands in front of the requests that it answers
                    one, run = Automaton(run.column(5)[0].as_py()), run.slice(1)
                if run.num_rows:
                    coded = run.column(10).flatten().cast(pa.large_binary()).dictionary_encode()
                    grams = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(run.num_rows, -1)
                    times = one.compose(coded.dictionary, grams)
                    if not times.all():
                        raise AssertionError("a part of a frequent phrase has no count")
                    joined = pc.binary_join(run.column(10), " ")
                    yield pa.RecordBatch.from_arrays([run.column(0), run.column(6), run.column(7), run.column(8), run.column(9), joined, pa.array(times)], ["lang", "phrase", "a", "cut", "rest", "part", "times"])

    return both.mapInArrow(look_up, "lang string, phrase string, a long, cut int, rest boolean, part string, times long")


def phrase_counts(documents: DataFrame, scratch: Scratch, least: int, longest: int, text: str, lang: str) -> tuple[DataFrame, list[tuple[bytes, ...]]]:
    """(the automata of all frequent sequences of up to ``longest`` words by language, range and length; the bounds)."""
    spark = documents.sparkSession
    source = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    bounds, bitmap, out = _bounds(source), None, None
    for length in range(1, longest + 1):
        level = scratch.stored(_united(_counted(source, length, bitmap, bounds), length, least), "automata")
        out = level if out is None else out.unionByName(level)
        frequent = level.agg(F.sum("frequent")).first()[0] or 0
        if not frequent or length == longest:
            return out, bounds
        bitmap = _bitmap(spark, level, frequent)
    return out, bounds


def phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best phrases of each language.

    a is the count of the phrase, n the number of words; of the cuts in two, with counts l and r, that with the lowest
    floor(1000 * a * n / (l * r)) counts, the shortest first part among equals.  A phrase that stands only within a
    longer one is left out.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    automata, bounds = phrase_counts(documents, scratch, least, longest, text, lang)
    requests = scratch.stored(_requests(automata, bounds), "requests")
    answers = scratch.stored(_answers(automata, requests, scratch), "answers")
    # a phrase within a longer one of the same count is within one that is one word longer, at either end
    words = F.size(F.split("phrase", " ")) - 1
    inner = answers.where((F.col("times") == F.col("a")) & F.when(F.col("rest"), F.col("cut") == 1).otherwise(F.col("cut") == words) & (words > 1)).select("lang", F.col("part").alias("phrase")).distinct()

    sizes = automata.where("length = 1").groupBy("lang").agg(F.sum("total").alias("n"))
    whole = "decimal(38,0)"
    cuts = answers.repartition("lang", "phrase").groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(~F.col("rest"), F.col("times"))).alias("l"), F.max(F.when(F.col("rest"), F.col("times"))).alias("r"))
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (F.col("a").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)")), F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)"))
    cuts = cuts.join(sizes, "lang").withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.join(inner, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "n", "best.score", "best.l", "best.r")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = Window.partitionBy("lang", "salt").orderBy(*order)
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang, piece, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), s AS (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING f >= {LEAST}
), t AS (
  SELECT coalesce(lang, 'und') AS lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY 1
), c AS (
  SELECT f.lang, f.phrase, f.f AS a, t.n, string_split(f.phrase, ' ') AS ws, unnest(range(1, f.k)) AS cut FROM f JOIN t USING (lang) WHERE f.k >= 2
), p AS (
  SELECT c.*, x.f AS l, y.f AS r, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ')
), b AS (
  SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT DISTINCT c.lang, array_to_string(c.ws[i:j], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM c WHERE cut = 1) c, LATERAL (SELECT unnest(range(i + 1, len(ws) + 1)) AS j) WHERE j - i + 1 < len(ws)
), k AS (
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = b.lang AND inside.phrase = b.phrase AND 100 * inside.a >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM k QUALIFY rank <= {TOP}
"""
