"""Operators that SQL can't express, against plain computations; and rows that are odd in every way."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import ODD, SF, ids_of, linked
from trackmend.llm import decontam, exact_dedup, langid, ngram_join, pieces, quality, token_counts, token_store, toxicity, warc
from trackmend.llm._shared import fresh, shared_folder

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_quality_scores_are_those_of_the_dictionaries(spark, docs):
    import zstandard

    model = quality.fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert max(len(model.bad), len(model.good)) <= quality.DICTIONARY
    compressors = []
    for data in (model.bad, model.good):
        known = zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None
        compressors.append(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
    rows = docs.unionByName(spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id: r for r in quality.score_quality(rows, model).collect()}
    c = model.calibration
    for r in rows.collect():
        data = (r.text or "").encode()
        bad, good = (sum(len(z.compress(data[at : at + quality.BLOCK])) for at in range(0, len(data), quality.BLOCK)) for z in compressors)
        x = [(bad - good) / len(data), min(bad, good) / len(data)] if data else [0.0, 0.0]
        z = c.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(c.weights[1:], x, c.mean, c.scale, strict=True))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_dictionaries_take_whole_texts_and_tiny_ones():
    tail = "only the end of this long text says zyxwvutsrq " * 40
    texts = ["start " * 500 + f"{i} " + tail for i in range(40)]
    assert b"zyxwvutsrq" in quality.dictionary([b for t in texts for b in quality._blocks(t.encode())])
    assert quality.dictionary([]) == b"" and quality.dictionary([b"ab"]) == b"ab"


@pytest.mark.parametrize("token", ["1d1ot", "m0r0n", "t1mm", "a@a", "oo", "b|b", "4x", "stt", "1-1d", "..a"])
def test_viterbi_is_the_best_of_all_readings(token):
    words = "idiot moron timid add aaa odd bib lid at ox stint dad it".split() * 2
    channel = toxicity.Channel(Counter(f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1)))
    options = []
    for i, c in enumerate(token):
        one = [(c, toxicity.AS_IS if c.isalpha() else toxicity.STRANGE)] + [(x, toxicity.IMITATED) for x in toxicity.IMITATES.get(c, "")]
        if c in toxicity.SILENT or (i and token[i - 1] == c):
            one.append(("", toxicity.DROPPED))
        options.append(one)
    scores = defaultdict(lambda: -math.inf)
    for reading in itertools.product(*options):
        word = "".join(c for c, _ in reading)
        padded = f"^^{word}$"
        value = sum(cost for _, cost in reading) + sum(channel.log_p(*padded[i : i + 3]) for i in range(len(padded) - 2))
        scores[word] = max(scores[word], value)
    best = max(scores.values())
    assert scores[channel.restore(token)] == pytest.approx(best, abs=1e-9)


@pytest.mark.parametrize("tokens", [list("abab"), list("1t1s"), list("a00b"), ["ab", "a", "b"], ["1", "ts"], ["bb", "0b"], ["i.t", "a"], ["-", "it", "s"]], ids="".join)
def test_viterbi_over_tokens_is_the_best_of_all_cuts(tokens):
    words = "a ab ba it is its at to bob b".split() * 2
    channel = toxicity.Channel(Counter(f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1)))
    flat = [(c, i == 0) for t in tokens for i, c in enumerate(t)]
    options = []
    for k, (c, starts) in enumerate(flat):
        one = [(c, toxicity.AS_IS if c.isalpha() else toxicity.STRANGE)] + [(x, toxicity.IMITATED) for x in toxicity.IMITATES.get(c, "")]
        if c in toxicity.SILENT or (k and flat[k - 1][0] == c):
            one.append(("", toxicity.DROPPED))
        gaps = [(" ", 0.0), (toxicity.JOINED, toxicity.DROPPED)] if starts and k else [("", 0.0)]
        options.append([(g + x, v + w) for g, v in gaps for x, w in one])
    scores = defaultdict(lambda: -math.inf)
    for reading in itertools.product(*options):
        text, value = "", 0.0
        for x, v in reading:
            gap = x[:1] if x[:1] in (" ", toxicity.JOINED) else ""
            # nothing ends or goes on before the first letter of a word
            if gap and (not text or text[-1] == " "):
                value += v - (toxicity.DROPPED if gap == toxicity.JOINED else 0.0)
                text += x[1:]
            else:
                value, text = value + v, text + x
        for word in text.split(" "):
            padded = f"^^{word.replace(toxicity.JOINED, '')}$"
            value += sum(channel.log_p(*padded[i : i + 3]) for i in range(len(padded) - 2))
        scores[text] = max(scores[text], value)
    assert scores[" ".join(channel.words(tokens))] == pytest.approx(max(scores.values()), abs=1e-9)


@pytest.mark.parametrize("seed", range(8))
def test_no_reading_with_an_entry_is_left_out(seed):
    """What the steps through the lexicon pass over has no reading with an entry."""
    rng = random.Random(seed)
    lexicon = {"idio": 1.0, "mor$": 1.0, "tool": 1.0, "bel$": 1.0, "ssss": 1.0}
    scorer = toxicity.Scorer(toxicity.ToxicityModel(lexicon, {}))
    for _ in range(150):
        token = "".join(rng.choice("idomrtl01!.-se5b8") for _ in range(rng.randint(1, 6)))
        options = []
        for i, c in enumerate(token):
            options.append([c, *toxicity.IMITATES.get(c, "")] + ([""] if c in toxicity.SILENT or (i and token[i - 1] == c) else []))
        any_ = any(scorer.entry("".join(r)) for r in itertools.product(*options))
        assert scorer.reach.ends(scorer.reach.token(1, token)) == any_, token



def test_languages_by_plain_arithmetic(spark, docs):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    more = [(-1, None, None), (-2, "http://x.de/", ""), (-3, "http://x.de/", "<html lang='de'><p>ein"), (-4, "nonsense", "<p>one</p>"), (-4, "nonsense", "<p>one</p>"), (-5, "http://a.b.c.org/x", "<p>" + "lang " * 30_000)]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id long, url string, html string"))
    known, table = langid.text_model(docs)
    k = len(known)
    rows = []
    for r in pages.collect():
        url, html = r.url or "", r.html or ""
        m = re.search(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url)
        host = (m[1] if m else "").lower()
        domain, suffix = (x[1] if (x := re.search(p, host)) else "" for p in (r"([^.]+\.[^.]+)$", r"\.([^.]+)$"))
        m = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", html, re.I)
        data = langid.visible(html).lower().encode()
        cells = langid.trigram_index(data)
        e = table[:, cells].astype(float).sum(1) * (min(len(cells), langid.TEXT_WEIGHT) / max(1, len(cells)))
        e -= e.max()
        rows.append((r.page_id, suffix, domain, host, (m[1] if m else "").lower(), e, np.exp(e) / np.exp(e).sum(), len(data)))
    sums = [defaultdict(lambda: np.zeros(k)) for _ in range(5)]
    levels = [lambda r: (), lambda r: r[1], lambda r: r[1:3], lambda r: r[1:4], lambda r: r[4]]
    for r in rows:
        for s, of in zip(sums, levels, strict=True):
            s[of(r)] = s[of(r)] + r[6]
    want = Counter()
    for r in rows:
        left = [np.maximum(s[of(r)] - r[6], 0) for s, of in zip(sums, levels, strict=True)]
        total = [max(s[of(r)].sum() - 1, 0) for s, of in zip(sums, levels, strict=True)]
        prior = (left[0] + 1) / (total[0] + k)
        for i in (1, 2, 3):
            prior = (left[i] + langid.SMOOTHING * prior) / (total[i] + langid.SMOOTHING)
        logs = r[5] + np.log(prior) + (np.log((left[4] + 0.5) / (left[0] + k)) if r[4] else 0)
        logs = np.round(logs, 9)
        want[(r[0], known[int(np.argmax(logs))], round(float(1 / np.exp(logs - logs.max()).sum()), 4), r[4], r[7])] += 1
    got = Counter((r.page_id, r.lang, round(r.probability, 4), r.declared, r.n_text_bytes) for r in langid.page_languages(pages, docs).collect())
    assert got == want


def test_no_language_is_left_out(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(3)
    names = [a + b for a in letters[:10] for b in letters[:9]]  # 90 languages
    syllables = {n: ["".join(rng.choice(letters) for _ in range(3)) for _ in range(12)] for n in names}
    text = lambda n: " ".join("".join(rng.choice(syllables[n]) for _ in range(2)) for _ in range(60))
    given = spark.createDataFrame([(i, text(n), n) for i, n in enumerate(names * 2)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, f"http://h{i}.x{i}/", f"<p>{text(n)}</p>") for i, n in enumerate(names)], "page_id long, url string, html string")
    for cells in (1 << 24, 1 << 19):  # the model's bound makes cells fewer, not languages
        monkeypatch.setattr(langid, "MODEL", cells)
        got = {r.page_id: r.lang for r in langid.page_languages(pages, given).collect()}
        assert sum(got[i] == n for i, n in enumerate(names)) >= 85


def words_of(text):
    return [x for x in ("".join(c for c in w if c.isalnum()) for w in text.lower().split()) if x]


def test_two_substitutions_over_a_table(spark, docs):
    rng = random.Random(11)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bench += [(700 + n, " ".join(f"i{n}w{j}" for j in range(n))) for n in range(1, 20)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(300):  # passages with none to four words changed, between other words
        w = rng.choice(bench)[1].split()
        at = rng.randint(0, max(0, len(w) - 14))
        w = w[at : at + rng.randint(13, 20)] if len(w) > 13 else list(w)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 99)}"
        ends = [[f"q{rng.randint(0, 999)}" for _ in range(rng.randint(0, 3))] for _ in range(2)]
        rows.append((50_000 + i, " ".join([*ends[0], *w, *ends[1]])))
    code = {}
    number = lambda t: np.array([code.setdefault(w, len(code)) for w in words_of(t)], int)
    want = set()
    items = {i: number(t) for i, t in bench}
    for key, text in rows:
        d = number(text or "")
        for i, w in items.items():
            n = min(len(w), decontam.WINDOW)
            allowed = 2 if n == decontam.WINDOW else 1 if n >= decontam.SHORT else 0
            if n == 0 or len(d) < n or (n < decontam.QUOTED and len(d) != n):
                continue
            windows = np.lib.stride_tricks.sliding_window_view(d, n)
            for at in range(len(w) - n + 1):
                if ((windows != w[at : at + n]).sum(1) <= allowed).any():
                    want.add((key, i))
                    break
    assert len(want) > 150
    given, passages = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(given, passages).collect()} == want
    assert {r.doc_id for r in decontam.drop_contaminated(given, passages).collect()} == {k for k, _ in rows} - {k for k, _ in want}


def test_a_full_bitmap_loses_nothing(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontam, "LEAST_BITS", decontam.PAGE)
    monkeypatch.setattr(decontam, "MOST_BITS", decontam.PAGE)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == want and want


def test_hot_signatures_are_salted(spark, docs, monkeypatch):
    for name, value in (("SAMPLE", 1), ("HOT", 3), ("BLOCK", 4), ("HUB", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base, line = [f"w{i}" for i in range(90)], [f"l{i}" for i in range(60)]
    for i in range(40):
        w = list(base)
        w[rng.randrange(90)] = f"n{i}"
        rows.append((1000 + i, " ".join(w)))
        rows.append((2000 + i, " ".join([*line, *[f"o{i}x{j}" for j in range(rng.randint(5, 60))]])))  # a passage that many share
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows)


@pytest.mark.parametrize("seed", range(15))
def test_similar_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    schemes = ngram_join.Schemes()
    for _ in range(30):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = int(rng.integers(0, len(a) // 5 + 1))
        b = np.delete(a, rng.choice(len(a), gone, replace=False))
        while True:  # new elements, as many as 80 % bear
            more = np.unique(np.append(b, rng.integers(0, 2**63, 1).astype(np.uint64)))
            common = len(np.intersect1d(a, more))
            if 100 * common < 80 * (len(a) + len(more) - common) or rng.random() < 0.02:
                break
            b = more
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common) or np.array_equal(a, b):
            continue
        shared = set(schemes.of(len(a))) & set(schemes.of(len(b)))
        both = [(schemes.signatures(a, s), schemes.signatures(b, s)) for s in shared]
        assert any(((x[:n] == y[:n]) & (x[:n] != 0)).any() for x, y in both for n in [min(len(x), len(y))])


@pytest.mark.parametrize("size", [5, 8, 12, 18, 24, 30, 40, 60, 74, 80, 120, 150, 300, 400])
def test_unlike_sets_share_no_signatures(size):
    rng = np.random.default_rng(size)
    schemes, n = ngram_join.Schemes(), 2000
    met = Counter()
    for _ in range(n):
        s = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        met.update((b, i, x) for b in schemes.of(len(s)) for i, x in enumerate(schemes.signatures(s, b).tolist()) if x)
    pairs = sum(m * (m - 1) // 2 for m in met.values())
    assert pairs <= 1e-5 * n * n / 2 and max(met.values()) <= 3


def test_sets_with_many_empty_pairs_meet_in_a_later_turn(monkeypatch):
    """Sets that lie in a small part of the domain have too many empty pairs in the first turn, and still meet."""
    schemes, rng = ngram_join.Schemes(), np.random.default_rng(3)
    for size in (10, 29, 74, 90):
        for _ in range(50):
            a = np.unique(rng.integers(0, 2**60, size, dtype=np.uint64))
            b = np.unique(np.append(a[: len(a) - len(a) // 10], rng.integers(0, 2**60, len(a) // 20, dtype=np.uint64)))
            shared = set(schemes.of(len(a))) & set(schemes.of(len(b)))
            both = [(schemes.signatures(a, s), schemes.signatures(b, s)) for s in shared]
            assert any(((x[:n] == y[:n]) & (x[:n] != 0)).any() for x, y in both for n in [min(len(x), len(y))])


def test_columns_that_clash(spark):
    names = ["doc_id", "text", "_key", "_n", "_kept", "_digest", "_row", "key", "least", "n", "Window", "size", "hash"]
    rows = [(i, t, *["x"] * 11) for i, t in [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (None, "k"), (4, "one two three four five six seven eight nine")]]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    exact, near, clean = exact_dedup.drop_exact_duplicates(df), ngram_join.drop_near_duplicates(df), decontam.drop_contaminated(df, bench)
    assert exact.columns == near.columns == clean.columns == names
    assert Counter(r.doc_id for r in exact.collect()) == Counter([1, 3, 4, None])
    assert Counter(r.doc_id for r in near.collect()) == Counter([1, 3, 4, None])
    assert Counter(r.doc_id for r in clean.collect()) == Counter([1, 2, 2, 3, None])
    assert fresh(df, "_key") == "__key" and fresh(df, "window") == "_window" and fresh(df, "other") == "other"


def test_rows_of_a_surviving_key(spark):
    """Of rows repeated under one key one stays, the longest text's; a dropped key's rows all go."""
    text = "a b c d e f g h i j k l m n"
    rows = [(1, text, 0), (1, text + " o", 1), (1, text, 2), (5, text, 3), (5, "quite another text of seven words", 4), (7, "quite another text of seven words", 5), (None, text, 6), (None, text, 7), (9, "", 8), (9, "", 9)]
    left = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, at int"))
    assert sorted((r.doc_id or 0, r.at) for r in left.collect() if r.doc_id != 9) == [(0, 6), (0, 7), (1, 1)]
    assert left.where("doc_id = 9").count() == 1


def test_token_store_with_null_and_repeated_keys(spark):
    rows = [(None, "no key"), (None, None), (3, "same"), (3, "same"), (3, "another"), (1, ""), (2, "word " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = shared_folder(spark, "store")
    token_store.write_token_store(df, path, shard_tokens=50)
    got = token_store.read_token_store(spark, path).orderBy("start").collect()
    crc = lambda x: zlib.crc32(np.array([*x, 0], "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x) + 1, crc(x)) for i, _, x in ids_of(df))
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 3, 3]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_very_long_chunks(monkeypatch):
    import public_tokenizers
    import sentencepiece

    monkeypatch.setattr(pieces, "BLOCK", 40)
    model, coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), pieces.PieceCoder("piece_bpe_32k.model")
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdeéñthein日😀()") for _ in range(rng.randint(60, 700))) for _ in range(60)] + ["x" * 1000, "internationalization" * 30]
    ids, bounds = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == model.encode(texts)


def test_long_texts(spark):
    """Texts far beyond the tables' longest."""
    many = " ".join(f"w{i % 70_001}" for i in range(90_000))
    rows = [(1, many), (2, many + " end"), (3, "short text of a few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(69_000, 69_020)))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(df, bench).collect()} == {1, 2}
    page = spark.createDataFrame([(1, "http://a.de/", f"<p>{many}</p>")], "page_id long, url string, html string")
    assert langid.page_languages(page, spark.read.parquet(f"{SMALL}/documents.parquet")).first().n_text_bytes == len(many)


def test_a_revisit_names_the_payload_that_it_repeats(spark):
    """Rows of the target's key with other payloads stand before and behind the one that is meant."""
    body = "m" * 1500
    rows = [(1, "u", body), (9, "u", "a" * 1200), (9, "u", body), (9, "u", "z" * 1300), (9, "u", "short"), (4, "u", "z" * 1300), (None, "u", body)]
    path = shared_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.assemble(warc.read_warc(spark, path, with_payload=True)).collect()
    held = {r.capture_id: bytes(r.response.payload).decode() for r in got if r.response.payload is not None}
    assert len({r.capture_id for r in got}) == len(rows)
    again = {r.metadata.page: held[r.response.refers_to] for r in got if r.response.kind == "revisit"}
    assert again == {1: body, 4: "z" * 1300}


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path / "sf")
    rows = [(i, t, None, None, None, "more") for i, t in enumerate(ODD)] + [(0, None, None, None, None, "again"), (None, "no key at all", None, None, None, None), (None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, _key string, _n string"
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").select(F.col("doc_id") + 1000, "text", "lang", "source", F.lit("x"), F.lit(None).cast("string"))
    spark.createDataFrame(rows, schema).union(base).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.reads_back or "▁" in ODD[r.doc_id] for r in out)
    empty = str(tmp_path / "none")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_features_of_empty_texts():
    scorer = toxicity.Scorer(toxicity.ToxicityModel({}, {}))
    assert scorer.features(pa.array([], pa.string())).shape == (0, 3) and scorer.features(pa.array(["", " "])).tolist() == [[0, 0, 0]] * 2


LONG = "word Other, " * 15_000 + "\n" + " ".join(f"w{i}" for i in range(12_000)) + " end"


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of far more than 20,000 words, one of them twice, beside short ones."""
    return spark.createDataFrame([(1, LONG), (2, LONG.replace(" ", "  ")), (3, "short"), (4, LONG + "!"), (5, None)], "doc_id long, text string")


def test_long_texts_are_counted_and_stored_whole(spark, long_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in long_docs.collect()}
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(long_docs).collect()} == {i: (len(t.encode()), len(ids[i])) for i, t in texts.items()}
    path = shared_folder(spark, "store")
    token_store.write_token_store(long_docs, path, shard_tokens=20_000)
    want = {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in ids.items()}
    assert {r.doc_id: r.ids_crc32 for r in token_store.read_token_store(spark, path).collect()} == want


def test_long_texts_are_deduplicated_and_scored_whole(spark, long_docs):
    rows = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(long_docs).collect()}
    assert rows == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}
    # what tells them stands at the very end
    toxic = spark.createDataFrame([(i, f"good words {i} here " + ("you idiot" if i % 2 else "you there")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(toxic, labels)
    ends = spark.createDataFrame([(1, LONG + " you idiot"), (2, LONG + " you there"), (3, LONG + " i d i o t")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(ends, model).collect()}
    assert score[1] > 0.7 > score[2] and score[3] > 0.7
    fitted = quality.fit_quality(toxic, labels)
    parts = quality.Compressors(fitted.bad, fitted.good)
    got = {r.doc_id: r.score for r in quality.score_quality(long_docs, fitted).collect()}
    for r in long_docs.collect():
        assert got[r.doc_id] == pytest.approx(float(fitted.calibration(np.array([parts.features(r.text or "")]))[0]))


def test_long_and_mixed_payloads_are_read_back(spark, monkeypatch):
    """Payloads of all classes of size, null keys and equal payloads: files stay small, nothing is lost."""
    monkeypatch.setattr(warc, "SMALL_BYTES", 200)
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    rng = random.Random(2)
    bodies = ["x" * 1500, LONG, ""] + ["".join(rng.choice("abc é") for _ in range(10**k)) for k in (1, 2, 3, 4) for _ in range(6)]
    rows = [(i if i % 4 else None, f"http://h/{i}", b) for i, b in enumerate(bodies * 2)]
    path = shared_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = warc.read_warc(spark, path, with_payload=True).where("kind in ('response', 'revisit')").collect()
    assert Counter((r.payload_bytes, r.payload_digest) for r in found) == Counter((len(b.encode()), hashlib.sha1(b.encode()).hexdigest()) for _, _, b in rows)
    largest = {}
    for i, _, b in rows:
        if i is not None and len(b.encode()) >= 1000:
            largest[b] = max(largest.get(b, i), i)
    assert sum(r.kind == "revisit" for r in found) == sum(i is not None and b in largest and i != largest[b] for i, _, b in rows)


def test_documents_without_keys_dont_crowd_the_language_sample(spark, monkeypatch):
    texts = [f"the cat and dog number {i} of many" for i in range(3000)]
    rows = [(None, t, "en") for t in texts] + [(7, t, "de") for t in texts] + [(None, texts[0], "en")] * 500
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known, table = langid.text_model(given, per_language=100)
    whole, full = langid.text_model(given, per_language=10_000)
    assert known == whole == ["de", "en"]
    sums = [np.exp(t.astype(np.float64)) for t in (table, full)]
    # a cell that all texts fill: shares are alike, while the sample has about a thirtieth of the counts
    seen = [1 / s.min(1) for s in sums]
    assert all(x < y / 8 for x, y in zip(*seen, strict=True))
