"""Phrases and the automata that count them against plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trackmend.llm import automaton, phrases

DOC = "text string, lang string, phrase string, n int, range string"


def brute(rows, least, longest=5, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {(q, a) for p, a in known.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) for q in [p[i:j]]}
        found = []
        for p, a in known.items():
            if (p, a) in inside:
                continue
            score, _, left, right = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "a", "New", "york", "é", "日本", "x" * 70, "0", "of\x0bthe", "nul\0", "\xa0", "b", "c"]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "; ", "?!", "\r\n"]
    return [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]


ODD = [(None, None), ("", "en"), (" \t ", "en"), (".,;:!?", "en"), ("a b c d e f g " * 400, "long"), ("one two", "long"), ("same row here", "de"), ("same row here", "de"), ("word " * 25_000, "en")]


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (5, 7), (1, 40)])
def test_phrases(spark, least, top):
    rows = ODD + rows_of(least)
    df = spark.createDataFrame([(t, x, "p", 1, "r") for t, x in rows], DOC).repartition(5)
    assert sorted(map(tuple, phrases.phrases(df, least=least, top=top).collect())) == brute(rows, least, top=top)


def test_small_shards_ranges_and_a_full_bitmap(spark, monkeypatch):
    """Everything is passed on, salted and filtered in tiny amounts: the counts stay exact."""
    for name, value in (("SHARD", 60), ("SHARD_WORDS", 9), ("RANGE", 500), ("ASKED", 3), ("BITS", 16), ("SLICE", 400), ("THINNED", 3)):
        monkeypatch.setattr(phrases, name, value)
    rows = rows_of(9, 60) + ODD[:-1]
    df = spark.createDataFrame([(t, x, "p", 1, "r") for t, x in rows], DOC).repartition(3)
    assert sorted(map(tuple, phrases.phrases(df, least=3).collect())) == brute(rows, 3)


def test_other_lengths_and_no_rows(spark):
    rows = rows_of(4, 50)
    df = spark.createDataFrame([(t, x, "p", 1, "r") for t, x in rows], DOC)
    assert sorted(map(tuple, phrases.phrases(df, least=4, longest=3).collect())) == brute(rows, 4, 3)
    assert phrases.phrases(df.where("false")).count() == 0
    assert phrases.phrases(df, least=10**9).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_automata(seed):
    rng = np.random.default_rng(seed)
    length, n = int(rng.integers(1, 6)), int(rng.integers(0, 400))
    spelt = sorted({bytes(rng.integers(0, 256, rng.integers(0, 4), dtype=np.uint8)) for _ in range(12)})
    lists = []
    for _ in range(3):
        found = Counter(tuple(spelt[i] for i in g) for g in rng.integers(0, len(spelt), (n, length)).tolist())
        lists.append(found)
    union, total = automaton.Union(length, limit=50), Counter()
    words = pa.array(spelt, pa.large_binary())
    bounds = sorted({tuple(spelt[i] for i in g) for g in rng.integers(0, len(spelt), (4, 2)).tolist()})
    for found in lists:
        total.update(found)
        grams = np.array([[spelt.index(w) for w in g] for g in found], np.int64).reshape(-1, length)
        grams, counts = automaton.summed(grams, np.array(list(found.values()), np.int64), len(spelt))
        one = automaton.Automaton(automaton.build(words, grams, counts))
        back, times = one.paths()
        assert (back == grams).all() and (times == counts).all()
        asked = rng.integers(0, len(spelt), (50, length))
        assert one.compose(words, asked).tolist() == [found[tuple(spelt[i] for i in g)] for g in asked.tolist()]
        parts = list(automaton.automata_by_range(words, grams, counts, bounds))
        assert [k for k, _ in parts] == sorted({sum(b <= tuple(spelt[i] for i in g) for b in bounds) for g in grams.tolist()})
        for _, data in parts:
            union.add(data)
    spelt_, grams, counts = union.result()
    names = spelt_.to_pylist()
    assert [(tuple(names[i] for i in g), c) for g, c in zip(grams.tolist(), counts.tolist(), strict=True)] == sorted(total.items())


def test_equal_endings_are_stored_once():
    """A thousand first words before the same three endings make one state for the endings."""
    words = pa.array(sorted(f"{i:04d}".encode() for i in range(1003)), pa.large_binary())
    grams = np.array([(i, 1000 + j) for i in range(1000) for j in range(3)], np.int64)
    one = automaton.Automaton(automaton.build(words, grams, np.tile([5, 6, 7], 1000)))
    assert len(one.first) - 1 == 2 and len(one.label) == 1003
