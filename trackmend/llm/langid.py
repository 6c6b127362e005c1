"""Language of web pages by fusing evidence.

Three kinds of evidence are multiplied and normalised for each page:

* the text: byte trigram frequencies of each language, learned from documents that name theirs.  Neighbouring trigrams
  aren't independent, so the evidence counts as that of ``TEXT_WEIGHT`` trigrams at most;
* the language that the markup declares: P(declared | language), a table that grouped aggregation over all pages fills
  with the texts' own verdicts;
* a prior for the host: the shares of the verdicts of the host's other pages, smoothed towards those of its domain,
  these towards those of the address suffix, and these towards those of all pages.

Counts by (suffix, domain, host) come from one grouped aggregation, the levels above from sums of it; a page's own
verdict is taken out of each level before it serves as a prior for that page.  Only these counts and small rows without
text are shuffled; the join with a hot host is split by AQE.

The text model reads about ``per_language`` documents of each language, picked by a hash of key and text, and all of
smaller ones; of documents that are alike in both it reads one.  It has ``TABLE`` cells for each language, and
fewer where the languages are so many that it would hold more than ``MODEL`` cells (64 MB): no language is left out.  A page
that is equally likely in several languages, up to nine digits, is given the first one by name.  Null or empty pages have no text evidence;
null addresses share one empty host.  Rows repeated under a key are pages of their own.  Without documents that name a
language the result is empty.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmend.llm._shared import drop_caches, slices, stored, text_column

TABLE, MODEL = 1 << 16, 1 << 24
SPAN = 1 << 40
TEXT_WEIGHT = 60.0
#: Pages that the prior of the level above counts for.
SMOOTHING = 5.0
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def trigram_index(data: bytes, cells: int = TABLE) -> np.ndarray:
    """The cell of each trigram; ``cells`` is a power of two."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((b[:-2] * 40503 + b[1:-1] * 2654435 + b[2:] * 97) >> np.uint32(3)) & np.uint32(cells - 1) if len(b) > 2 else np.zeros(0, np.uint32)


def visible(page: str) -> str:
    return " ".join(_html.unescape(_HIDDEN.sub(" ", page)).split())


def text_model(documents: DataFrame, per_language: int = 1000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram cell in each language), from a bounded sample."""
    named = documents.where(F.col(lang).isNotNull() & (F.col(lang) != "")).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sizes = {r.lang: r.n for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    known = sorted(sizes)
    cells = TABLE
    while cells * len(known) > MODEL and cells > 256:
        cells //= 2
    if not known:
        return [], np.zeros((0, cells), np.float32)
    # a threshold for the hash of the key, by language: no shuffle, and no task that gets a whole language
    shares = documents.sparkSession.createDataFrame([(n, int(SPAN * min(1.0, per_language / sizes[n]))) for n in known], "lang string, below long")
    # rows without a key, or with a common one, are told apart by their texts; rows that are wholly alike count once
    drawn = named.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("key", "text"), F.lit(SPAN)) < F.col("below"))
    rows = drawn.dropDuplicates(["key", "lang", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), text_column(batch, "text").to_pylist(), strict=True):
                at = trigram_index(t.lower().encode(), cells)
                sums[name] = sums.get(name, np.zeros(cells, np.int64)) + np.bincount(at, minlength=cells)
        for name, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "cell", "n"])

    table, place = np.full((len(known), cells), 0.02, np.float32), {name: i for i, name in enumerate(known)}
    for r in rows.select("lang", "text").mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toLocalIterator():  # MODEL rows at most
        table[place[r.lang], r.cell] += r.n
    return known, np.log(table / table.sum(1, keepdims=True, dtype=np.float64)).astype(np.float32)


def _address(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix)."""
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"\.([^.]+)$", 1)


def page_languages(pages: DataFrame, documents: DataFrame, key: str = "page_id", uri: str = "url", page: str = "html", per_language: int = 1000) -> DataFrame:
    """(key, lang, probability, declared, text_lang, n_text_bytes): the likeliest language of each page and its probability."""
    spark = pages.sparkSession
    known, table = text_model(documents, per_language)
    k = len(known)
    given = spark.sparkContext.broadcast(table)
    host, domain, suffix = _address(F.col(uri))
    body = F.coalesce(F.col(page).cast("string"), F.lit(""))
    source = pages.select(F.col(key).alias("key"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.lower(F.regexp_extract(body, _DECLARED, 1)).alias("declared"), body.alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    if not k:
        return source.where("false").select(F.col("key").alias(key), F.lit("").alias("lang"), F.lit(0.0).alias("probability"), "declared", F.lit("").alias("text_lang"), F.lit(0).cast("long").alias("n_text_bytes"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        model = given.value
        cells = model.shape[1]
        for batch in batches:
            for part in slices(batch, "text"):
                out, size = np.zeros((part.num_rows, k)), []
                for i, t in enumerate(text_column(part, "text").to_pylist()):
                    data = visible(t).lower().encode()
                    at = trigram_index(data, cells)
                    if len(at):
                        n = np.bincount(at, minlength=cells)
                        used = np.flatnonzero(n)
                        out[i] = model[:, used].astype(np.float64) @ n[used] * (min(len(at), TEXT_WEIGHT) / len(at))
                    size.append(len(data))
                evidence = out - out.max(1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * part.num_rows + 1, k, dtype=np.int32)), pa.array(evidence.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), lists, pa.array(size, pa.int64())], ["key", "host", "domain", "suffix", "declared", "evidence", "n_text_bytes"])

    read_schema = f"key {kind}, host string, domain string, suffix string, declared string, evidence array<double>, n_text_bytes long"
    rows = stored(source.mapInArrow(read, read_schema), "page-evidence")
    # the texts' verdicts: a share of each page for each language
    total = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumn("e", F.transform("evidence", lambda x: F.exp(x))).withColumn("verdict", F.transform("e", lambda x: x / total)).drop("e")
    sums = [F.sum(F.col("verdict")[i]).alias(f"s{i}") for i in range(k)]
    up = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]

    def packed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        counts = [F.col(f"s{i}") for i in range(k)]
        return df.select(*keys, F.array(*counts).alias(f"n_{name}"), F.greatest(sum(counts[1:], counts[0]) - 1, F.lit(0.0)).alias(f"t_{name}"))

    hosts = stored(rows.groupBy("suffix", "domain", "host").agg(*sums), "host-counts")
    domains = hosts.groupBy("suffix", "domain").agg(*up)
    suffixes = domains.groupBy("suffix").agg(*up)
    everywhere = suffixes.agg(*up)
    declared = rows.groupBy("declared").agg(*sums)
    levels = packed(hosts, ["suffix", "domain", "host"], "host").join(packed(domains, ["suffix", "domain"], "domain"), ["suffix", "domain"]).join(packed(suffixes, ["suffix"], "suffix"), "suffix")
    levels = levels.crossJoin(F.broadcast(packed(everywhere, [], "all")))  # one row
    claims = packed(declared, ["declared"], "declared")

    def others(level: str) -> Column:
        """The level's sums without the page's own verdict."""
        return F.zip_with(f"n_{level}", "verdict", lambda n, own: F.greatest(n - own, F.lit(0.0)))

    def smoothed(level: str, prior: Column) -> Column:
        return F.zip_with(others(level), prior, lambda n, p: (n + SMOOTHING * p) / (F.col(f"t_{level}") + SMOOTHING))

    joined = rows.join(levels, ["suffix", "domain", "host"]).join(claims, "declared")
    prior = F.transform(others("all"), lambda n: (n + 1) / (F.col("t_all") + k))
    for level in ("suffix", "domain", "host"):
        prior = smoothed(level, prior)
    claim = F.zip_with(others("declared"), others("all"), lambda n, of: F.when(F.col("declared") == "", 0.0).otherwise(F.log((n + 0.5) / (of + k))))
    logs = F.zip_with(F.zip_with("evidence", claim, lambda e, c: e + c), prior, lambda x, p: F.round(x + F.log(p), 9))
    scored = joined.select("key", "declared", "n_text_bytes", "evidence", logs.alias("logs"))
    names = F.array(*[F.lit(n) for n in known])
    best = F.array_max("logs")
    return scored.select(
        F.col("key").alias(key),
        names[F.array_position("logs", best).cast("int") - 1].alias("lang"),
        F.round(1 / F.aggregate(F.transform("logs", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, b: a + b), 6).alias("probability"),
        "declared",
        F.when(F.col("n_text_bytes") > 2, names[F.array_position("evidence", F.array_max("evidence")).cast("int") - 1]).alias("text_lang"),
        "n_text_bytes",
    )
