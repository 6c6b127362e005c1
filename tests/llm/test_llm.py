"""The operators for training text against brute force, exact round trips and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackmend.llm import components, decontam, exact_dedup, langid, ngram_join, pieces, quality, queries, token_counts, token_store, toxicity, warc
from trackmend.llm._shared import shared_folder

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "  \n\t ", "a", "a b", "it's  two   spaces\n\n\nand lines \n", "tab\tand\r\nreturn", "\0nul \0", "<|endoftext|>x <|endoftext|>", "▁under ▁▁ score", "日本語のテキスト、ですよ。", "naïve café ﬁ 😀😀 ​ x",
    "x" * 5000, "word " * 3000, "don't we'll I'VE 12345 3.14 !!! ...,;", "same text", "same text", "same  text",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, 1, None) for i, t in enumerate(ODD)] + [(3, ODD[3], 1, None), (None, "no key", 1, None), (None, None, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, keep_id string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(df):
    rows = df.select("doc_id", "text").collect()
    coded = tokenizer().encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    return [(r.doc_id, r.text or "", e.ids) for r, e in zip(rows, coded, strict=True)]


def key(r):
    return (r[0] is None, r)


def test_pieces_are_the_library_s(spark, odd, docs, none):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for df in (odd, docs):
        rows = pieces.encode_pieces(df).collect()
        texts = [r.text or "" for r in df.select("text").collect()]
        assert Counter(tuple(r.ids) for r in rows) == Counter(tuple(model.encode(t)) for t in texts)
        assert sum(r.reads_back for r in rows) == sum("▁" not in t for t in texts)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_ids == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(pieces.encode_pieces(docs)).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert pieces.encode_pieces(none).count() == 0


def test_pieces_of_random_text():
    import public_tokenizers
    import sentencepiece

    model, coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), pieces.coder("piece_bpe_32k.model")
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdeé ñ  \n\t.,0123▁!-'()的日😀thein") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    ids, bounds = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == model.encode(texts)


def test_token_counts_are_the_library_s(odd, docs, none):
    for df in (odd, docs):
        want = sorted(((i, len(t.encode()), len(x), len(x) > 512) for i, t, x in ids_of(df)), key=lambda r: (r[0] is None, r[0] or 0, r))
        got = sorted(map(tuple, token_counts.count_tokens(df, entries=500).collect()), key=lambda r: (r[0] is None, r[0] or 0, r))
        assert got == want
    assert token_counts.count_tokens(none).count() == 0


def test_token_store_reads_back(spark, odd, docs, none):
    for df in (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), docs):
        path = shared_folder(spark, "store")
        token_store.write_token_store(df, path, shard_tokens=50_000)
        want, start = [], 0
        for i, _, x in sorted(ids_of(df)):
            want.append((i, start, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())))
            start += len(x) + 1
        assert sorted(map(tuple, token_store.read_token_store(spark, path).collect())) == want
        shard = spark.read.parquet(path).orderBy(F.desc("n_tokens")).first().asDict()
        ids = {i: x for i, _, x in ids_of(df)}
        for i in (0, len(shard["keys"]) // 2, len(shard["keys"]) - 1):
            assert token_store.decode_document(shard, i).tolist() == [*ids[shard["keys"][i]], 0]
    path = shared_folder(spark, "store")
    token_store.write_token_store(none, path)
    assert token_store.read_token_store(spark, path).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, rng.integers(1, 40), rng.integers(0, 5000)).astype(np.uint32)
    body, left, right, expansion = token_store.compress(ids, 50257, least=2)
    assert token_store.expand(body, left, right, expansion, 50257).tolist() == ids.tolist()


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    return {norm: (min(g)[2], len(g)) for norm, g in groups.items()}


def test_exact_duplicates(odd, docs, none):
    for df in (odd, docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        groups = brute_groups(rows)
        want = Counter((i, *groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]) for i, t in rows)
        got = exact_dedup.exact_duplicates(df).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert len(kept) == len(groups) and set(kept.values()) == {1}
        left = exact_dedup.drop_exact_duplicates(df)
        assert left.columns == df.columns and left.count() == len(groups)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_shared_digests_are_told_apart(odd, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_duplicates(odd).select("doc_id", "keep_id", "group_size", "kept").collect()))
    sha2 = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: sha2(F.substring(c, 1, 1), n))
    assert sorted(map(str, exact_dedup.exact_duplicates(odd).select("doc_id", "keep_id", "group_size", "kept").collect())) == want


def held_out(spark, name, label):
    rows = queries.queries()[name](spark, SF.replace("0.01", "0.1")).join(spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet"), "doc_id")
    return rows.where("held_out").select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_quality_on_held_out_labels(spark):
    assert held_out(spark, "op4_quality", "quality") > 0.97


def test_toxicity_on_held_out_labels(spark):
    assert held_out(spark, "op6_toxicity", "toxic") > 0.97


def test_classifiers_on_odd_rows(spark, odd, docs, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    nothing = labels.limit(0)
    for model, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        for given in (labels, nothing):
            fitted = model(docs, given)
            got = score(odd, fitted).collect()
            assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
            assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(ODD))}
            assert score(none, fitted).count() == 0


def test_disguised_words():
    words = "you are an idiot moron loser worthless stupid trash the house is large and the garden green".split() * 3
    channel = toxicity.Channel(Counter(f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1)))
    model = toxicity.ToxicityModel({b: 6.0 for w in ("idiot", "moron", "loser", "worthless", "stupid", "trash") for b in toxicity.beginnings(w)}, dict(channel.three))
    scorer = toxicity.Scorer(model)
    for w in ("1d10t", "i.d.i.o.t", "m0r0n", "stuuuupid", "tr@sh", "w0rthl3ss", "idiot!!!", "l-o-s-e-r"):
        assert scorer.token(w) > 0, w
    for w in ("house", "green", "2024", "garden...", "e3b0c44298fc1c14"):
        assert scorer.token(w) == 0, w
    f = scorer.features(pa.array(["", "an i d i o t here", "the large house"]))
    assert f[0].tolist() == [0, 0, 0] and f[1][0] > 0 and f[2].tolist() == [0, 0, 0]


def test_more_disguises():
    words = "you are such a an idiot moron loser worthless stupid trash the house is large and the garden green".split() * 3
    trigrams = Counter(f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1))
    scorer = toxicity.Scorer(toxicity.ToxicityModel({b: 6.0 for w in ("idiot", "moron", "loser", "worthless", "stupid", "trash") for b in toxicity.beginnings(w)}, dict(trigrams)))
    for w in ("iiddiioott", "m000ron", "stuupid", "tr@@sh", "!diot" + "!" * 70):
        assert scorer.token(w) > 0, w
    assert all(scorer.token(w) == 0 for w in ("green", "garden", "see", "2000"))
    spaced = ["id iot", "i d iot", "id i o t", "i. d. i. o. t.", "i, d, i, o, t", "(i)(d)(i)(o)(t)", "ii dd ii oo tt", "you - i - d - i - o - t", "a m0 r0n", "tr as h", "a i d i o t", "i  d  i  o  t", "i\td\ti\to\tt", "i\nd\r\ni\no\nt", "i\u00a0d\u3000i o t", "s u c h a m o r o n", "the 1 d 1 0 t is", "l o s e r"]
    f = scorer.features(pa.array(spaced + ["t h e h o u s e", "g r e e n", "i d i o t s t u p i d"]))
    assert [s for s, x in zip(spaced, f[:, 0], strict=False) if x <= 0] == []
    assert f[-3:, 0].tolist() == [0, 0, 6] and f[-1, 2] == pytest.approx(np.log1p(2))
    assert scorer.features(pa.array(["i d", "i o t"]))[:, 0].tolist() == [0, 0]  # no run over two texts
    long = "x y " * 20_000
    assert scorer.features(pa.array([long]))[0, 0] == 0


def test_pairs_are_replaced_until_none_is_frequent():
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.tile(rng.integers(0, 500, 200), 40), rng.integers(0, 500, 3000), np.tile(rng.integers(0, 500, 512), 20)])
    body, left, right, expansion = token_store.compress(ids, 500)
    assert np.array_equal(token_store.expand(body, left, right, expansion, 500), ids)
    pairs = Counter(zip(body[:-1].tolist(), body[1:].tolist(), strict=True))
    assert max(pairs.values()) < 16 and expansion.max() > 32
    same, *rules = token_store.compress(np.zeros(5000, int), 1)
    assert len(same) < 32 and np.array_equal(token_store.expand(same, *rules, 1), np.zeros(5000, int))


def test_items_with_wide_spaces_and_items_without_an_id(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    items = spark.createDataFrame([(1, "\u00a0".join(words)), (None, "one two three four five six seven eight nine")], "item_id long, text string")
    rows = [(1, "so " + " ".join(words) + " end"), (4, "x one two three four five six seven eight nine y")]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(r.doc_id for r in found) == [1, 4]
    assert {r.doc_id: r.item_id for r in found if r.doc_id < 4} == {1: 1}


def test_languages(spark, docs):
    got = langid.page_languages(spark.read.parquet(f"{SF}/pages.parquet"), docs).collect()
    assert sum(r.lang == r.declared for r in got) / len(got) > 0.98
    odd_pages = spark.createDataFrame([(1, None, None, 5), (2, "nonsense", "", 5), (2, "nonsense", "", 5), (None, "http://a.b/c", "<html lang=de><p>der die und nicht das", 5)], "page_id long, url string, html string, lang int")
    found = langid.page_languages(odd_pages, docs).collect()
    assert len(found) == 4 and all(0 < r.probability <= 1 for r in found)
    assert next(r for r in found if r.page_id is None).lang == "de"
    assert langid.page_languages(odd_pages, docs.limit(0)).count() == 0
    assert langid.page_languages(odd_pages.limit(0), docs).count() == 0


def linked(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_duplicates(spark, docs, none):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 400").collect()]
    for i in range(60):  # a group of copies, each edited elsewhere; and chains of edits
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"n{rng.randint(0, 9999)}"
        rows.append((1000 + i, " ".join(w)))
    w = [f"c{i}" for i in range(100)]
    for i in range(12):
        w[8 * i % 100] = f"x{i}"
        rows.append((2000 + i, "  ".join(w).upper()))
    rows += [(3000, "a b c d"), (3001, "a b c d"), (3002, "a b c"), (3003, "a b c d e"), (3004, ""), (3005, None), (3006, " \n"), (3007, "a\tb\nc d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert got == linked(rows)
    left = ngram_join.drop_near_duplicates(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {c for _, c in got.values()}
    assert ngram_join.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (3, "q r s t u v"), (None, "q r s t u v")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join.near_duplicates(twice).collect()) == [(0, None), (1, 1), (2, 1), (2, 1), (3, 1)]


def test_large_buckets_are_compared_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 200").collect()]
    base = [f"w{i}" for i in range(80)]
    rows += [(1000 + i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(500, i) for i in range(501, 700)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for i in root}


def test_decontamination(spark, docs, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    w = item.text.split()
    rows = [(1, "x y z " + item.text + " q r s"), (2, " ".join(w[:12])), (3, "pre " + " ".join([*w[:5], "CHANGED", *w[6:10], "TOO", *w[11:13]]) + " post"), (4, " ".join([*w[:3], "A", *w[4:6], "B", *w[7:9], "C", *w[10:13]])), (5, ""), (6, None), (None, item.text), (7, item.text.upper().replace(" ", " -- ")), (1, "x y z " + item.text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("window", F.lit(0))
    odd_bench = bench.unionByName(spark.createDataFrame([(901, None), (902, ""), (903, "one two three"), (904, "these eight words are here for one match")], "item_id long, text string"))
    found = decontam.contaminated(df.unionByName(spark.createDataFrame([(8, "so THESE eight words are here for one match."), (9, "one two three")], "doc_id long, text string").withColumn("window", F.lit(0))), odd_bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, item.item_id), (3, item.item_id), (7, item.item_id), (8, 904), (9, 903)}
    assert {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()} == {2, 4, 5, 6, None}
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_seeds_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, 40).astype(np.uint64)
    b = a.copy()
    at = rng.integers(0, 40 - decontam.WINDOW)
    b[:at], b[at + decontam.WINDOW :] = 7, 7
    b[at + rng.integers(0, decontam.WINDOW, 2)] = 9
    bounds = np.array([0, 40])
    one, two = ({m: dict(zip(p.tolist(), h.tolist(), strict=True)) for m, _, p, h in decontam.seeds(x, bounds, [])} for x in (a, b))
    assert any(one[m][at] == two[m][at] for m in one)


def test_captures(spark):
    long = "é" * 600
    rows = [(1, "http://a/1", long), (2, None, long), (5, "http://a/5\r\nX: y", long), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (6, "http://a/6", None), (7, "http://a/7", "\r\n\r\nWARC/1.1\r\n" * 90), (8, "u", ""), (8, "u", "two rows")]
    path = shared_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(1)), path, records_per_file=4)
    records = warc.read_warc(spark, path, with_payload=True)
    assert records.count() == 3 * len(rows)
    got = warc.assemble(records).collect()
    assert Counter((r.metadata.page, r.response.kind, r.response.payload_bytes) for r in got) == Counter([(1, "revisit", 1200), (2, "revisit", 1200), (5, "response", 1200), (3, "response", 5), (4, "response", 5), (6, "response", 0), (7, "response", 1260), (8, "response", 0), (8, "response", 8)])
    assert {bytes(r.response.payload).decode() for r in got if r.metadata.page == 7} == {rows[6][2]}
    last = next(r for r in got if r.metadata.page == 5)
    assert all(r.response.refers_to == last.capture_id for r in got if r.response.kind == "revisit") and all(r.request.uri == r.response.uri for r in got)
    empty = shared_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.assemble(warc.read_warc(spark, empty)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score_quality(docs, model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    groups = brute_groups(rows)
    rows = [(i, t) for i, t in rows if groups[re.sub(r"[\x20\x09-\x0D]", "", t)][0] == i]
    near = linked(rows)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: [x for x in ("".join(c for c in w if c.isalnum()) for w in t.lower().split()) if x]
    held = {tuple(w[i : i + 13]) for w in map(words, bench) for i in range(len(w) - 12)}
    rows = [(i, t) for i, t in rows if not any(tuple(w[k : k + 13]) in held for w in [words(t)] for k in range(len(w) - 12))]
    assert set(out) == {i for i, _ in rows}
    assert all(r.reads_back for r in out.values())
