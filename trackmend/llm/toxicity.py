"""Toxicity behind disguises: a noisy channel from written tokens back to words.

A token becomes a lattice: each character stands for itself, for the letters that it imitates, or for nothing, if it is
a sign or repeats the one before.  Neighbouring tokens of ``FEW`` letters at most (signs at the edges and repeats don't
count) become one lattice, in which the gap between two of them ends a word or stands for nothing too.  A Viterbi search
under a character trigram model finds the likeliest word, or words.  Words, written or restored, are looked up in a
lexicon of beginnings of words that toxic documents have much more often than others; a logistic model turns the
strongest entry and the number of such tokens into a probability.

Only lattices that hold a word with an entry are searched.  Whether one does is found by stepping through the lexicon,
as a tree of letters, with all readings at once; nothing that the search could find is left out by that.

The fit (lexicon, trigrams, calibration) reads all labelled rows that aren't held out.  Each distinct token is decoded once in a worker.  Scoring reads whole texts where they lie, without a shuffle.

Empty and null texts, and texts without an entry, get the score of the features 0.  Without labelled rows of one
class the score is the share of the other.  Null keys aren't held out.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmend.llm._labelled import Logistic, dealt, fit, held_out, training_rows
from trackmend.llm._shared import drop_caches, slices, strings, text_column

#: Letters that a character imitates.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou"}
#: Characters that may stand between letters for nothing.
SILENT = set(" .-_*~'`´^,:;/\\|+=#​­()[]{}<>\"")
AS_IS, IMITATED, DROPPED, STRANGE = 0.0, -1.0, -0.7, -9.0
#: Stands in a restored word where the gap between two tokens was dropped.
JOINED = "\n"
_EDGE = ".,;:!?\"'()[]{}<>*$%&#|-_~"
SHORTEST, LONGEST = 4, 12
#: Letters that a token has at most that may be a part of a spaced word.
FEW = 3
#: Steps through the lexicon that a worker remembers before it starts again.
STEPS = 500_000
#: Tokens that a worker remembers before it starts again, and the length up to which it does.
CACHE_ENTRIES, LONGEST_KEY = 250_000, 64
#: Beginnings and words that a task of the fit counts before it passes them on.
COUNTED = 1_000_000


def beginnings(word: str) -> list[str]:
    """What the lexicon has of a word: its first letters, and the word with its end."""
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + ([word + "$"] if len(word) > 2 else [])


def readable(core: str) -> bool:
    """Whether a token may be a word in disguise; numbers of up to three digits never are."""
    return any(c.isalpha() for c in core) or sum(c in IMITATES for c in core) >= 4


class Channel:
    """The character trigram model and the search."""

    def __init__(self, trigrams: dict[str, int]):
        self.three, self.two, self.one = dict(trigrams), Counter(), Counter()
        self.history: Counter[str] = Counter()
        for t, n in trigrams.items():
            self.history[t[:2]] += n
            self.two[t[1:]] += n
            self.one[t[2]] += n
        self.middle: Counter[str] = Counter()
        for t, n in self.two.items():
            self.middle[t[0]] += n
        self.total = max(1, sum(self.one.values()))
        self.known: dict[str, float] = {}

    def log_p(self, a: str, b: str, c: str) -> float:
        t = a + b + c
        if (p := self.known.get(t)) is None:
            one = (self.one[c] + 0.1) / (self.total + 100)
            two = (self.two[b + c] + 2 * one) / (self.middle[b] + 2)
            p = self.known[t] = math.log((self.three.get(t, 0) + 2 * two) / (self.history[a + b] + 2))
        return p

    def restore(self, token: str) -> str:
        """The likeliest word behind ``token``."""
        return self.words([token])[0].replace(JOINED, "")

    def words(self, tokens: list[str]) -> list[str]:
        """The likeliest words behind a run of tokens; ``JOINED`` marks where one goes on from a token to the next."""
        best: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}  # paths as linked lists
        before = ""
        for number, token in enumerate(tokens):
            if number:
                ends = [(score + self.log_p(a, b, "$"), path) for (a, b), (score, path) in best.items() if b != "^"]
                following = {state: (score + DROPPED, (path, JOINED)) if state[1] != "^" else (score, path) for state, (score, path) in best.items()}
                if ends and (end := max(ends, key=lambda e: e[0]))[0] > following.get(("^", "^"), (-math.inf,))[0]:
                    following[("^", "^")] = (end[0], (end[1], " "))
                best = following
            for ch in token:
                options = [(ch, AS_IS if ch.isalpha() else STRANGE)]
                options += [(c, IMITATED) for c in IMITATES.get(ch, "")]
                if ch in SILENT or ch == before:
                    options.append(("", DROPPED))
                following = {}
                for (a, b), (score, path) in best.items():
                    for c, cost in options:
                        state, value = ((a, b), score + cost) if not c else ((b, c), score + cost + self.log_p(a, b, c))
                        if state not in following or value > following[state][0]:
                            following[state] = (value, (path, c) if c else path)
                best, before = following, ch
        ended = [(score + self.log_p(a, b, "$"), path) for (a, b), (score, path) in best.items()]
        top = max(score for score, _ in ended)
        return max(_written(path) for score, path in ended if score == top).split(" ")


class Reach:
    """The lexicon as a tree of letters, and steps through it with all readings of a character at once.

    A state is a number that stands for a set of nodes; 0 is the empty set, 1 the root.  ``FOUND`` means that some
    reading has passed an entry.
    """

    FOUND = -1

    def __init__(self, lexicon: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.entry, self.whole = {}, set()
        for word in lexicon:
            node = 0
            for c in word.removesuffix("$"):
                node = self.child[node].setdefault(c, len(self.child))
                if node == len(self.child):
                    self.child.append({})
            if word.endswith("$"):
                self.whole.add(node)
            else:
                self.entry[node] = True
        self._start()

    def _start(self) -> None:
        self.sets, self.number = [frozenset(), frozenset([0])], {frozenset(): 0, frozenset([0]): 1}
        self.steps: dict[tuple[int, str, bool], int] = {}
        self.over: dict[tuple[int, str], int] = {}

    def step(self, state: int, ch: str, same: bool) -> int:
        if (found := self.steps.get((state, ch, same))) is None:
            nodes = self.sets[state]
            after = {n for c in (ch, *IMITATES.get(ch, "")) for node in nodes if (n := self.child[node].get(c)) is not None}
            if ch in SILENT or same:
                after |= nodes
            if any(n in self.entry for n in after):
                found = self.FOUND
            else:
                key = frozenset(after)
                if (found := self.number.get(key)) is None:
                    found = self.number[key] = len(self.sets)
                    self.sets.append(key)
            self.steps[state, ch, same] = found
        return found

    def token(self, state: int, token: str) -> int:
        """Where a token leads, whatever stood before it: its first character may always repeat."""
        if (found := self.over.get((state, token))) is None:
            found, before = state, None
            for ch in token:
                found = self.step(found, ch, before is None and state != 1 or ch == before)
                before = ch
                if found <= 0:
                    break
            self.over[state, token] = found
        return found

    def ends(self, state: int) -> bool:
        """Whether a word that ends here has an entry."""
        return state == self.FOUND or (state > 0 and not self.whole.isdisjoint(self.sets[state]))

    def turn(self) -> None:
        """To be called between batches."""
        if len(self.steps) + len(self.over) > STEPS:
            self._start()


def _written(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    trigrams: dict[str, int]
    calibration: Logistic | None = None


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.lexicon, self.channel, self.reach, self.known = model.lexicon, Channel(model.trigrams), Reach(model.lexicon), {}
        self.parts: dict[str, str | None] = {}
        self.runs: dict[tuple[str, ...], list[float]] = {}

    def entry(self, word: str) -> float:
        return max((self.lexicon[x] for x in beginnings(word) if x in self.lexicon), default=0.0)

    def restored(self, core: str) -> float:
        return self.entry(self.channel.restore(core)) if readable(core) and self.reach.ends(self.reach.token(1, core)) else 0.0

    def token(self, token: str) -> float:
        """The strongest entry of a lower-case token, written or restored."""
        if (found := self.known.get(token)) is None:
            core = token.strip(_EDGE)
            found = self.entry(core) or self.restored(core)
            # signs at the edges may be letters
            if not found and core != token and any(c in IMITATES for c in token):
                found = self.restored(token.strip(".,;:?\"'"))
            if len(token) <= LONGEST_KEY:
                self.known[token] = found
        return found

    def part(self, token: str) -> str | None:
        """The token without its edges, if it has few letters; None for others."""
        if token not in self.parts:
            core = token if len(token) == 1 else token.strip(_EDGE)
            letters, before = 0, ""
            for c in core:
                letters += c != before and (c.isalpha() or c in IMITATES)
                before = c
            word = len(core) < 2 or any(c.isalpha() for c in core)
            found = core if letters <= FEW and len(core) <= LONGEST_KEY and word else None
            if len(token) > LONGEST_KEY:
                return found
            self.parts[token] = found
        return self.parts[token]

    def run(self, parts: tuple[str, ...]) -> list[float]:
        """The entries of the words that go on from one token to another."""
        if (found := self.runs.get(parts)) is None:
            joined = (w for w in self.channel.words(list(parts)) if JOINED in w)
            found = [e for w in joined if (e := self.entry(w.replace(JOINED, "")))]
            if len(parts) <= LONGEST_KEY:
                self.runs[parts] = found
        return found

    def spaced(self, words: list[str], index: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list[float]]]:
        """(text, entries) of the runs of short tokens that hold a word with an entry."""
        part = [self.part(w) for w in words]
        short = np.array([p is not None for p in part], bool)[index]
        first = np.array([self.reach.token(1, p) if p else 0 for p in part], np.int64)
        alive = (first != 0)[index]
        last = np.zeros(len(index) + 1, bool)
        last[bounds[1:]] = True  # where a text begins anew
        # a start goes on to a short token of the same text; each pair of tokens is looked at once
        at = np.flatnonzero(alive[:-1] & short[:-1] & short[1:] & ~last[1:-1]) if len(index) > 1 else np.zeros(0, np.int64)
        if not len(at):
            return
        pair, of = np.unique(index[at] * len(words) + index[at + 1], return_inverse=True)
        reached = np.array([self._on(int(first[k // len(words)]), part[k % len(words)]) for k in pair.tolist()], np.int64)
        done = -1
        for i in at[reached[of] != 0].tolist():
            if i < done:
                continue
            state, j = int(first[index[i]]), i
            while True:
                if j > i and (state == Reach.FOUND or self.reach.ends(state)):
                    break
                j += 1
                if state == 0 or j >= len(index) or last[j] or not short[j]:
                    state = 0
                    break
                state = self._on(state, part[index[j]])
            if state == 0:
                continue
            low, done = i, j + 1
            while low > 0 and not last[low] and short[low - 1]:
                low -= 1
            while done < len(index) and not last[done] and short[done]:
                done += 1
            text = int(np.searchsorted(bounds, i, side="right")) - 1
            yield text, self.run(tuple(part[k] for k in index[low:done].tolist()))

    def _on(self, state: int, part: str) -> int:
        return state if state == Reach.FOUND else self.reach.token(state, part)

    def features(self, texts: pa.Array) -> np.ndarray:
        """(strongest entry, its square, log of one more than the tokens that have one) for each text."""
        for held in (self.known, self.parts, self.runs):
            if len(held) > CACHE_ENTRIES:
                held.clear()
        self.reach.turn()
        lower = pc.utf8_lower(texts.cast(pa.large_string()))
        lists = pc.utf8_split_whitespace(lower)
        coded = lists.values.dictionary_encode()
        index, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), strings(coded.dictionary)
        each = np.array([self.token(t) for t in words], float)[index] if len(words) else np.zeros(0)
        bounds = lists.offsets.to_numpy()
        hits = np.flatnonzero(each > 0)
        row = np.searchsorted(bounds, hits, side="right") - 1
        top, count = np.zeros(len(texts)), np.zeros(len(texts))
        np.maximum.at(top, row, each[hits])
        np.add.at(count, row, 1)
        for i, found in self.spaced(words, index, bounds) if len(words) else ():
            for e in found:
                top[i], count[i] = max(top[i], e), count[i] + 1
        return np.c_[top, top**2, np.log1p(count)]


def fit_toxicity(documents: DataFrame, labels: DataFrame, least: int = 4, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns from every labelled row that isn't held out: lexicon and trigrams from two thirds, the calibration from the
    rest.  Entries stand in ``least`` toxic rows or more."""
    spark = documents.sparkSession
    known_labels, sizes = training_rows(labels, label, key)
    source = documents.where(~held_out(F.col(key))).select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # rows are dealt out before the join, so that a text is shuffled for its own step only; labels of a large corpus are too
    # many to broadcast
    learn, check = (source.where(w).join(known_labels.hint("merge"), "key").select("y", "text") for w in (dealt(F.col("key")) < 0.67, dealt(F.col("key")) >= 0.67))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[Counter[str]] = [Counter(), Counter()]
        seen: Counter[str] = Counter()
        parts: dict[str, list[str]] = {}

        def counted() -> pa.RecordBatch:
            trigrams: Counter[str] = Counter()
            for w, n in seen.items():
                padded = f"^^{w}$"
                for i in range(len(padded) - 2):
                    trigrams[padded[i : i + 3]] += n
            rows = [("e" + k, entries[0][k], entries[1][k]) for k in entries[0].keys() | entries[1].keys()] + [("t" + k, n, 0) for k, n in trigrams.items()]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            for held in (*entries, seen, parts):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["entry", "clean", "toxic"])

        for batch in batches:
            for part in slices(batch, "text"):
                for y, t in zip(part.column(0).to_pylist(), text_column(part, "text").to_pylist(), strict=True):
                    words = {w.strip(_EDGE) for w in t.lower().split()}
                    words = {w for w in words if w.isalpha()}
                    for w in words:
                        if w not in parts:
                            parts[w] = beginnings(w)
                    entries[y].update({b for w in words for b in parts[w]})
                    entries[y][""] += 1
                    seen.update(words)
                if len(entries[0]) + len(entries[1]) + len(parts) > COUNTED:
                    yield counted()
        yield counted()

    # entries of the lexicon begin with an e, that of no letters counts the rows; trigrams begin with a t
    counts = learn.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.where(f"entry like 't%' or entry = 'e' or toxic >= {least}").persist()
    clean, toxic = next(((r.clean, r.toxic) for r in counts.where("entry = 'e'").collect()), (0, 0))
    # the log of the ratio of the shares, less for entries that few rows have
    value = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1)) - 2 / F.sqrt("toxic")
    lexicon = {r.entry[1:]: r.value for r in counts.where("entry like 'e_%'").withColumn("value", value).where("value > 2").orderBy("entry").collect()}
    model = ToxicityModel(lexicon, {r.entry[1:]: r.clean for r in counts.where("entry like 't%'").orderBy("entry").collect()})
    counts.unpersist()
    known = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        scorer = Scorer(known.value)
        for batch in batches:
            for part in slices(batch, "text"):
                f = scorer.features(text_column(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(f[:, i]) for i in range(3))], ["y", "a", "b", "c"])

    # rows of the same features are one with a number: an entry and a count of tokens say it all
    alike = check.mapInArrow(features, "y int, a double, b double, c double").groupBy("y", "a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    held = sorted(tuple(r) for r in alike.collect())
    calibration = fit(np.array([r[1:4] for r in held]).reshape(-1, 3), np.array([r[0] for r in held]), sizes, times=np.array([r[4] for r in held]))
    return ToxicityModel(model.lexicon, model.trigrams, calibration)


def score_toxicity(documents: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) for each row: score is the probability that the label is 1."""
    known = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        scorer = Scorer(known.value)
        for batch in batches:
            for part in slices(batch, "text"):
                p = known.value.calibration(scorer.features(text_column(part, "text")))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [key, "held_out", "score", "predicted"])

    source = documents.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(score, f"`{key}` {source.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")
