"""Merkle manifest of a table by sibling-shift self-joins.

Each row is a leaf; the leaves of a source, in the order of their keys, carry a tree of ``ARITY`` children a node, and
the roots of the sources, in the order of their names, carry the tree above.  Every level is one equijoin: a node asks
for the indices that lie at each slot offset in its run, and the nodes of these indices answer.  A node then knows what
stands to its left and right in the run, and rows of slot zero emit the parents.  Leaves are numbered by a two-level
scan, runs have ``ARITY`` members, and levels are written tables, so no source is ever in one task.

Sibling digests travel as 32 bytes each.  The way from a node to the root, as pairs of what stands left and right, is
put together from the root downwards: each level joins the one above by (source, run).

Nulls have an encoding of their own in a leaf; null sources are one source, which comes first; null keys come first in
their source and are never tampered with.  Rows that are repeated are leaves of their own; rows of one key are ordered
by their leaves.  An empty table has no root and an empty result.  Columns besides the given ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmend.llm._shared import Scratch
from trackmend.llm.scan import running

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<left:binary,right:binary>"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_text(columns: tuple[str, ...] = COLUMNS, lowered: str | None = None) -> Column:
    """What the digest of a row is taken of; A-Z of the column ``lowered`` become a-z."""
    return F.concat(*[_field(F.translate(c, _UPPER, _LOWER) if c == lowered else F.col(c)) for c in columns])


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """(g, i, n, digest, other, key, left, right): what stands left and right of each node in its run."""
    slot = F.pmod("i", F.lit(ARITY))
    # a node also asks for itself, at offset zero, so that nodes alone in their run are there
    asks = nodes.where("n > 1").select("g", "i", "n", F.explode(F.sequence(F.lit(0), F.lit(ARITY - 1))).alias("offset"))
    asks = asks.select("g", "i", (F.col("i") - slot + F.pmod(slot + F.col("offset"), F.lit(ARITY))).alias("j"), "n").where("j < n")
    answers = nodes.where("n > 1").select("g", F.col("i").alias("j"), "digest", "other", "key")
    met = asks.join(answers, ["g", "j"])
    own = F.col("i") == F.col("j")
    met = met.select("g", "i", "n", "j", "digest", F.when(own, F.col("other")).alias("other"), F.when(own, F.col("key")).alias("key"))
    run = met.groupBy("g", "i", "n").agg(F.sort_array(F.collect_list(F.struct("j", "digest"))).alias("run"), F.max("other").alias("other"), F.max("key").alias("key"))

    def joined(side) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter("run", side), lambda x: F.hex(x["digest"])), ""))

    own_digest = F.filter("run", lambda x: x["j"] == F.col("i"))[0]["digest"]
    run = run.select("g", "i", "n", own_digest.alias("digest"), "other", "key", joined(lambda x: x["j"] < F.col("i")).alias("left"), joined(lambda x: x["j"] > F.col("i")).alias("right"))
    return run.unionByName(nodes.where("n = 1").select("g", "i", "n", "digest", "other", "key", F.lit(b"").alias("left"), F.lit(b"").alias("right")))


def tree_levels(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels of the trees over ``nodes`` (g, i, n, digest, other, key): of group g the i-th of n leaves.  The root
    of a group is its row with n = 1."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while True:
        levels.append(scratch.stored(_with_siblings(nodes), "level"))
        if most <= 1:
            return levels
        first = levels[-1].where((F.col("n") > 1) & (F.pmod("i", F.lit(ARITY)) == 0))
        up = _digest(_hex(F.concat("digest", "right")))
        nodes = first.select("g", F.expr(f"i div {ARITY}").alias("i"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), up.alias("digest"), F.lit(None).cast("binary").alias("other"), F.lit(None).cast("long").alias("key"))
        most = -(-most // ARITY)


def _ways(levels: list[DataFrame], ends: DataFrame, scratch: Scratch) -> DataFrame:
    """The lowest level with ``way``, the steps from its nodes to the root, and the columns of ``ends`` (g, way, ...),
    which has the way of each group's root."""
    more = [c for c in ends.columns if c not in ("g", "way")]
    above = None
    for number, level in reversed(list(enumerate(levels))):
        columns = ["g", "i"] if number else level.columns
        found = level.where("n = 1").join(ends, "g").select(*columns, "way", *more)
        if above is not None:
            parent = above.select("g", F.col("i").alias("up"), F.col("way").alias("rest"), *more)
            inner = level.where("n > 1").withColumn("up", F.expr(f"i div {ARITY}")).join(parent, ["g", "up"])
            found = found.unionByName(inner.select(*columns, F.concat(F.array(F.struct("left", "right").cast(_STEP)), "rest").alias("way"), *more))
        above = scratch.stored(found, "ways") if number else found
    return above


def manifest(documents: DataFrame, key: str = "doc_id", source: str = "source", columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, way, other, n_siblings) for each row: its digest, its source's root, the root of all,
    its steps to that root, and the digest of ``tampered_text`` where ``tampered`` holds."""
    scratch = Scratch(documents.sparkSession)
    altered = F.when(tampered, _digest(tampered_text)) if tampered is not None else F.lit(None).cast("binary")
    # null first, then names byte by byte
    group = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    leaves = scratch.stored(documents.select(group.alias("g"), F.col(key).cast("long").alias("key"), _digest(leaf_text(columns)).alias("digest"), altered.alias("other")), "leaves")
    placed = running(leaves, "g", ["key", "digest"], None, scratch)
    lower = tree_levels(scratch.stored(placed.select("g", F.col("before").alias("i"), F.col("total").alias("n"), "digest", "other", "key"), "placed"), scratch)

    roots = lower[0].where("n = 1").select("g", "digest")
    for level in lower[1:]:
        roots = roots.unionByName(level.where("n = 1").select("g", "digest"))
    roots = scratch.stored(roots.select(F.col("g").alias("name"), "digest", F.lit(0).alias("g")), "subroots")
    placed = running(roots, "g", ["name"], None, scratch)
    named = scratch.stored(placed.select("g", F.col("before").alias("i"), F.col("total").alias("n"), "digest", F.col("name").cast("binary").alias("other"), F.lit(None).cast("long").alias("key")), "placed")
    upper = tree_levels(named, scratch)
    top = upper[-1].where("n = 1").select("digest").first()
    end = upper[-1].where("n = 1").select("g", F.array().cast(f"array<{_STEP}>").alias("way"))
    ends = _ways(upper, end, scratch).select(F.col("other").cast("string").alias("g"), "way", F.col("digest").alias("subroot"))
    ways = _ways(lower, scratch.stored(ends, "ends"), scratch)
    found = ways.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", F.lit(bytes(top.digest) if top else None).cast("binary").alias("root"), "way", "other")
    return found


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf (as hex text) leads to along its way."""
    return F.aggregate(way, leaf, lambda at, step: F.sha2(F.concat(_hex(step["left"]), at, _hex(step["right"])).cast("binary"), 256))


def proof_text(way: Column) -> Column:
    """The digests of the siblings along the way, from left to right, level by level."""
    return F.array_join(F.transform(way, lambda step: _hex(F.concat(step["left"], step["right"]))), "")


def verified_manifest(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The manifest as digests, and what becomes of it when A-Z in the texts of some rows become a-z: those whose key,
    in decimal, has a CRC-32 that 5 divides.

    (key, leaf, subroot, root, proof_sha256, folded_root, verified)
    """
    tampered = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = manifest(documents, key, source, tampered=tampered, tampered_text=leaf_text(lowered=text))
    found = found.withColumn("folded", folded(_hex(F.coalesce("other", "leaf")), F.col("way")))
    return found.select(
        key,
        _hex(F.col("leaf")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        F.sha2(proof_text(F.col("way")).cast("binary"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == _hex(F.col("root"))).alias("verified"),
    )


def _oracle(levels: int = 5, tops: int = 3) -> str:
    """SQL for tables of up to 16 ** levels rows a source and 16 ** tops sources, level by level."""

    def tree(name: str, depth: int) -> str:
        out = ""
        for k in range(depth):
            out += f""",
{name}r{k} AS (SELECT g, i // {ARITY} AS run, max(n) AS n, list(digest ORDER BY i) AS run_digests FROM {name}{k} GROUP BY ALL),
{name}{k + 1} AS (SELECT g, run AS i, (n + {ARITY - 1}) // {ARITY} AS n, CASE WHEN n = 1 THEN run_digests[1] ELSE sha256(array_to_string(run_digests, '')) END AS digest FROM {name}r{k})"""
        return out

    def climb(name: str, depth: int, start: str, keys: str) -> str:
        out, at = "", start
        for k in range(depth):
            new = f"{name}c{k}"
            slot = f"((a.i // {ARITY**k}) % {ARITY})"
            left, right = f"coalesce(array_to_string(r.run_digests[1:{slot}], ''), '')", f"coalesce(array_to_string(r.run_digests[{slot} + 2:], ''), '')"
            out += f""",
{new} AS (SELECT {keys}, a.g, a.i, CASE WHEN r.n = 1 THEN a.proof ELSE a.proof || {left} || {right} END AS proof,
  CASE WHEN r.n = 1 THEN a.folded ELSE sha256({left} || a.folded || {right}) END AS folded
  FROM {at} a JOIN {name}r{k} r ON a.g = r.g AND a.i // {ARITY ** (k + 1)} = r.run)"""
            at = new
        return out

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    head = " || ".join(field(c) for c in COLUMNS[:-1])
    lowered = f"coalesce(strlen(text) || ':' || translate(text, '{_UPPER}', '{_LOWER}'), '-')"
    # CRC-32 bit by bit: each byte is followed by eight steps
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS g, sha256({head} || {field("text")}) AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {lowered}) END AS other FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d
), t0 AS (SELECT g, i, n, leaf AS digest FROM p){tree("t", levels)},
u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, digest, g AS name FROM t{levels}){tree("u", tops)},
s AS (SELECT doc_id, leaf, '' AS proof, coalesce(other, leaf) AS folded, g, i FROM p){climb("t", levels, "s", "doc_id, leaf")},
m AS (SELECT c.doc_id, c.leaf, u0.digest AS subroot, 0 AS g, u0.i, c.proof, c.folded FROM tc{levels - 1} c JOIN u0 ON u0.name = c.g){climb("u", tops, "m", "doc_id, leaf, subroot")}
SELECT doc_id, leaf, subroot, u{tops}.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u{tops}.digest AS verified FROM uc{tops - 1}, u{tops}
"""


ORACLE_SQL = _oracle()
