"""The manifest and the mix against plain computations, on odd rows, deep trees and hot sources."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from trackmend.llm import merkle, mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, copies int"
WHITE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def doc(i, text, source, lang="en"):
    return (i, text, lang, source, None if text is None else len(text), "x", 7)


ODD = [
    doc(3, None, None), doc(1, "", None), doc(None, "No Key", None), doc(2, "A b\tC\n\x0bd", "é"), doc(2, "A b\tC\n\x0bd", "é"), doc(9, "same key, OTHER text", "é"), doc(9, "Same", "é"),
    doc(4, "  ", "a"), doc(-5, "NEG ative", "a", None), doc(5, "wörd " * 30_000, "b"), doc(6, " one", "Z"), doc(7, "one two", ""),
]
DEEP = [doc(i, f"Text {i} " + "w " * (i % 11), "hot" if i % 3 else f"s{i % 40}") for i in range(900)]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, DOC)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, lower=False):
    text = r[1].translate(str.maketrans(merkle._UPPER, merkle._LOWER)) if lower and r[1] is not None else r[1]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def grow(leaves):
    """(root, steps of each leaf as (left, right))."""
    ways, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for way, i in zip(ways, at, strict=True):
            run = now[i - i % 16 : i - i % 16 + 16]
            way.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        now, at = [sha("".join(now[k : k + 16])) for k in range(0, len(now), 16)], [i // 16 for i in at]
    return now[0], ways


def manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by["" if r[3] is None else "s" + r[3]].append(r)
    names, trees = sorted(by, key=str.encode), {}
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = grow([leaf(r) for r in by[name]])
    root, tops = grow([trees[name][0] for name in names])
    out = Counter()
    for name, top in zip(names, tops, strict=True):
        for r, way in zip(by[name], trees[name][1], strict=True):
            at = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in way + top:
                at = sha(left + at + right)
            out[r[0], leaf(r), trees[name][0], root, sha("".join(a + b for a, b in way + top)), at, at == root] += 1
    return out


@pytest.mark.parametrize("rows", [ODD, DEEP, ODD[:1]], ids=["odd", "deep", "single"])
def test_manifest(spark, rows):
    found = merkle.verified_manifest(rows_of(spark, rows)).collect()
    assert Counter(map(tuple, found)) == manifest(rows)


def test_ways_of_a_manifest_lead_to_its_root(spark):
    found = merkle.manifest(rows_of(spark, DEEP)).withColumn("folded", merkle.folded(merkle._hex(merkle.F.col("leaf")), merkle.F.col("way")))
    rows = found.collect()
    assert len(rows) == 900 and all(r.folded == r.root.hex() for r in rows) and {len(r.way) for r in rows} == {1 + 2, 3 + 2}


def words(text):
    return len((text or "").translate(WHITE).split(" ")) - (text or "").translate(WHITE).split(" ").count("")


def targets(sizes):
    """Target of each source (None last) by rounds in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    held = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        free = [s for s in names if s not in held]
        out = {s: Fraction(3 * sizes[s]) for s in held} | {s: Fraction(rest * weight[s], sum(weight[f] for f in free)) for s in free}
        above = {s for s in free if out[s] > 3 * sizes[s]}
        if not above:
            return out
        held |= above


@pytest.mark.parametrize("rows", [ODD, DEEP, [doc(1, None, "a"), doc(2, " ", None)]], ids=["odd", "deep", "wordless"])
def test_mix(spark, rows):
    found = mixing.mix(rows_of(spark, rows)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((words(r[1]), r[0] is not None, r[0] or 0))
    want, sizes = Counter(), {s: sum(x[0] for x in g) for s, g in by.items()}
    target = targets(sizes)
    for s, g in by.items():
        name = "t" if s is None else "s" + s
        rate, at = (target[s] / sizes[s] if sizes[s] else Fraction(0)), Fraction(int(sha("0:" + name)[:4], 16), 1 << 16)
        for size, keyed, key in sorted(g):
            copies = (at + rate).__floor__() - at.__floor__()
            at += rate
            assert copies <= 3
            want[key if keyed else None, size, sizes[s], float(target[s]), size * copies, copies] += 1
    assert Counter((r.doc_id, r.size, r.source_size, r.target, r.taken, r.copies) for r in found) == want
    taken = Counter()
    for r in found:
        taken[r.source_size, r.target] += r.taken
    alike = Counter((sizes[s], float(target[s])) for s in by)
    longest = {(sizes[s], float(target[s])): max(x[0] for x in g) for s, g in by.items()}
    assert all(abs(n - t) <= longest[size, t] for (size, t), n in taken.items() if alike[size, t] == 1)


def test_mixture_has_each_document_as_often_as_planned(spark):
    docs = rows_of(spark, ODD + DEEP)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id, r.size] += r.copies
    found = mixing.mixture(docs)
    assert found.columns == docs.columns
    assert Counter((r.doc_id, words(r.text)) for r in found.collect()) == +plan


def test_columns_that_clash_with_those_of_the_plan(spark):
    docs = rows_of(spark, ODD)
    for c in ("_key", "_n", "_size", "_spot", "target", "size", "before", "total", "g", "other"):
        docs = docs.withColumn(c, mixing.F.lit("x"))
    found = mixing.mixture(docs)
    assert found.columns == docs.columns and found.count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert merkle.verified_manifest(docs).count() == len(ODD)


def test_no_rows(spark):
    none = rows_of(spark, [])
    assert merkle.verified_manifest(none).count() == 0 and mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0


def test_other_seeds_and_weights(spark):
    docs = rows_of(spark, DEEP)
    a, b = (sorted((r.doc_id, r.copies) for r in mixing.mix(docs, seed=seed).collect()) for seed in (0, 0))
    assert a == b
    assert a != sorted((r.doc_id, r.copies) for r in mixing.mix(docs, seed=1).collect())
    even = mixing.mix(docs, weights=(1,), most=10).collect()
    assert len({r.target for r in even if r.target < 10 * r.source_size}) <= 1
