"""Near-duplicate documents: chosen-path set similarity join.

A document is the set of its distinct ``k``-word shingles. Documents of equal
sets form one class, and classes are joined by recursive branching: a node of
a tree holds documents that share a path of selected minwise tokens, and it
sends each of them on by the tokens at one or two positions of their minhash
signature, chosen by the node (1/similarity children per document on
average, so a similar pair survives a level in one child on average). Small
nodes are compared exhaustively. ``TREES`` independent trees are walked
together to reach the target recall: a pair right at the threshold is missed
with a chance of about 0.3**10 after three levels and 0.46**10 after six.

What keeps big groups linear: in a node too big to compare, one pivot is
compared with everyone and leaves the node, and the others go down some more
levels. Pairs that are already connected need no comparison, so a node whose members are, but for a few, in one
component is finished by comparing those few. The recursion goes on until no
node is left; there's no cap on depth, partners or candidates.

A comparison first estimates similarity from two bits per signature position
(the bound lies 6.5 standard deviations below the threshold), then sizes;
what passes is confirmed on the full shingle sets of the whole texts.

Edge cases: null and empty texts, or texts of white space, have no shingle
and stay alone; texts of fewer than ``k`` words are one shingle; equal and
repeated rows fall in one class; a null id takes part but can't name a
component that has another id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemill.llm.graph import components, contract, nearest_labels
from tastemill.llm.pairing import few, identified, shared_nodes, step
from tastemill.llm.textbuf import (MASK, WHITESPACE, constants, flat, hash_spans, mix, shingles, spans, table,
                                   text_batches)
from tastemill.session import discard, materialize, sweep

POSITIONS, TREES = 64, 10
LEVELS = 3                         # levels that rows go down before nodes are looked at
GROUP_SHINGLES = 4_000_000         # in the sets of a group that confirms pairs, about
SIGNATURE = "struct<n:bigint,ha:bigint,hb:bigint,s1:bigint,s2:bigint,tokens:array<bigint>>"


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def minwise_tokens(u: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """For each position the element of ``u`` with the least rank."""
    a = (constants(positions, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (constants(positions, 12) >> np.uint64(32)).astype(np.uint32)
    best, at = None, None
    for i in range(0, len(u), 8192):
        x = (u[i:i + 8192] >> np.uint64(32)).astype(np.uint32)
        rank = x[None, :] * a[:, None] + b[:, None]
        own = rank.argmin(axis=1)
        low = rank[np.arange(positions), own]
        if best is None:
            best, at = low, own
        else:
            less = low < best
            best, at = np.where(less, low, best), np.where(less, own + i, at)
    return u[at]


def sketch(tokens: np.ndarray) -> tuple[int, int]:
    """Two bits per position, in two 64-bit words."""
    bits = mix(tokens) >> np.uint64(62)
    shift = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return tuple(int(np.bitwise_or.reduce(bits[i:i + 32] << shift)) for i in (0, 32))


def signature(u: np.ndarray) -> dict:
    if not len(u):
        return {"n": 0, "ha": 0, "hb": 0, "s1": 0, "s2": 0, "tokens": []}
    with np.errstate(over="ignore"):
        tokens = minwise_tokens(u)
        words = sketch(tokens)
        sums = [int(mix(u ^ np.uint64(c)).sum()) & MASK for c in (0x51ED270B, 0xA24BAED4963EE407)]
    to_long = lambda x: x - (1 << 64) if x >> 63 else x
    return {"n": len(u), "ha": to_long(sums[0]), "hb": to_long(sums[1]), "s1": to_long(words[0]), "s2": to_long(words[1]),
            "tokens": signed(tokens)}


def shingle_sets(col, k: int) -> list[np.ndarray]:
    data, off = flat(col)
    starts, ends, per = spans(data, off, WHITESPACE)
    return shingles(hash_spans(data, starts, ends), per, k)


def _signatures(k: int):
    kind = pa.struct([(c, pa.int64()) for c in ("n", "ha", "hb", "s1", "s2")] + [("tokens", pa.list_(pa.int64()))])

    @arrow_udf(SIGNATURE)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            yield pa.array([signature(u) for u in shingle_sets(col, k)], type=kind)

    return run.asNondeterministic()


def _sets(k: int):
    @arrow_udf("array<bigint>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            yield pa.array([np.sort(signed(u)) for u in shingle_sets(col, k)], type=pa.list_(pa.int64()))

    return run.asNondeterministic()


def alike(a: str, b: str, percent: int) -> Column:
    """Could the sketched rows ``a`` and ``b`` be similar enough?"""
    p = percent / 100 + (1 - percent / 100) / 4
    least = math.floor(POSITIONS * p - 6.5 * math.sqrt(POSITIONS * p * (1 - p)))
    low = 0x5555555555555555

    def differ(s: str) -> Column:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(low)))

    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return sizes & (F.lit(POSITIONS) - differ("s1") - differ("s2") >= least)


def roots(percent: int) -> list[tuple[int, int]]:
    """(tree, position) of the first branching: one position per tree, and a
    second one for the share of trees that the threshold asks for."""
    extra = round(TREES * (100 / percent - 1))
    step = POSITIONS // TREES
    return [(t, t * step) for t in range(TREES)] + [(t, t * step + step // 2) for t in range(extra)]


def descend(nodes: Column, percent: int, levels: int) -> Column:
    """Nodes some levels below ``nodes`` for a row with ``tokens``: a node
    sends a document on by the token at a position that the node chooses,
    and a share of the nodes at a second one too. A path depends on the
    document's own tokens alone, so several levels need no shuffle between."""
    def children(node):
        at = lambda seed: F.pmod(F.xxhash64(node, F.lit(seed)), F.lit(POSITIONS)).cast("int")
        second = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(10_000)) < round(10_000 * (100 / percent - 1))
        child = lambda p: F.xxhash64(node, p, F.get("tokens", p))
        return F.when(second & (at(1) != at(2)), F.array(child(at(1)), child(at(2)))).otherwise(F.array(child(at(1))))

    for _ in range(levels):
        nodes = F.flatten(F.transform(nodes, children))
    return nodes


def branch(rows: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Rows of big nodes ``LEVELS`` levels further down."""
    return rows.join(tokens, "rep").select(F.explode(descend(F.array("node"), percent, LEVELS)).alias("node"), "rep", "n", "s1", "s2")


class Links:
    """Confirms candidate pairs on full sets. A set is made once, a pair is
    confirmed once, and a set travels once to each group of pairs that share
    rows instead of once per pair."""

    def __init__(self, numbered: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent, self.sets, self.tested = numbered, k, percent, None, None

    def confirm(self, pairs: DataFrame) -> DataFrame:
        if self.tested is not None:
            new = materialize(pairs.join(few(self.tested, self.tested.count()), ["a", "b"], "left_anti"), "pairs")
            discard(pairs)
            pairs = new
        self.tested = pairs.select("a", "b") if self.tested is None else self.tested.unionByName(pairs.select("a", "b"))
        members = materialize(pairs.select("g", F.col("a").alias("_uid")).union(pairs.select("g", "b")).distinct(), "members")
        keys = members.select("_uid").distinct()
        if self.sets is not None:
            keys = keys.join(self.sets.select("_uid"), "_uid", "left_anti")
        keys = materialize(keys, "keys")
        n = keys.count()
        if n or self.sets is None:
            made = self.docs.select("_uid", "text").join(few(keys, n), "_uid", "left_semi").select("_uid", _sets(self.k)(F.col("text")).alias("set"))
            made = materialize(made, "sets")
            self.sets = made if self.sets is None else self.sets.unionByName(made)
        rows = members.count()
        total = self.sets.select("_uid", F.size("set").alias("n")).join(few(members, rows), "_uid").agg(F.sum("n")).first()[0] or 0
        parts = max(int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_SHINGLES))
        part = F.pmod("g", F.lit(parts)).alias("part")
        carried = self.sets.join(few(members.select(part, "_uid").distinct(), rows), "_uid")
        found = pairs.select(part, "a", "b").groupBy("part").cogroup(carried.groupBy("part")).applyInArrow(_confirmed(self.percent), "a bigint, b bigint")
        found = materialize(found, "links")
        discard(members, keys)
        return found


def _confirmed(percent: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {u: s.values.to_numpy() for u, s in zip(sets.column("_uid").to_pylist(), sets.column("set"))}
        out = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = held[a], held[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if shared * 100 >= (len(x) + len(y) - shared) * percent:
                out.append((a, b))
        cols = list(zip(*out)) if out else [(), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def find(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
    """(documents as ``_uid`` and ``_row``, classes): per row ``_uid``, ``id``,
    ``n_shingles`` and ``label``, the least row identity of its component."""
    spark = docs.sparkSession
    text_batches(spark)
    numbered = identified(docs)
    field = F.col("_row").getField
    made = numbered.select("_uid", field(id_col).alias("_id"), _signatures(k)(field(text_col)).alias("s"))
    sig = materialize(made.select("_uid", "_id", "s.*"), "signatures")
    same = ["n", "ha", "hb"]
    classes = sig.where("n > 0").groupBy(*same).agg(F.min("_uid").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    places = roots(percent)
    first = F.array(*[F.xxhash64(F.lit(t), F.lit(p), F.get("tokens", F.lit(p))) for t, p in places])
    narrow = sig.select("_uid", "_id", *same, "s1", "s2", F.when(F.col("n") > 0, descend(first, percent, LEVELS - 1)).alias("first"))
    members = materialize(narrow.join(classes, same, "left").withColumn("rep", F.coalesce("rep", "_uid")), "members")
    reps = members.where((F.col("rep") == F.col("_uid")) & (F.col("n") > 0))
    payload = ["n", "s1", "s2"]
    rows = shared_nodes(reps.select(F.explode("first").alias("node"), "rep", *payload))
    links, tokens = Links(numbered.select("_uid", field(text_col).alias("text")), k, percent), sig.select(F.col("_uid").alias("rep"), "tokens")
    edges, labels = None, None
    while True:
        pairs, rest = step(rows, labels, lambda a, b: alike(a, b, percent), payload)
        if not pairs.isEmpty():
            found = links.confirm(pairs)
            edges = contract(found if edges is None else found.union(edges))
            labels = nearest_labels(edges)
        discard(rows)
        rows = shared_nodes(branch(rest, tokens, percent))
        discard(rest)
        if rows.isEmpty():
            break
        sweep(spark)
    if edges is not None:
        labels = components(edges)
        members = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    else:
        members = members.withColumn("label", F.col("rep"))
    return numbered, members.select("_uid", F.col("_id").alias("id"), F.col("n").alias("n_shingles"), "label")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_shingles``, ``component_id`` (the
    least id in its component) and ``kept`` (the row has that id)."""
    _, found = find(docs, k, percent, id_col, text_col)
    found = materialize(found, "classes")
    least = found.groupBy("label").agg(F.min("id").alias("component_id"))
    return found.join(least, "label").select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the least id, of equal ids
    the first row."""
    numbered, found = find(docs, k, percent, id_col, text_col)
    found = materialize(found, "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_uid"))
    least = found.groupBy("label").agg(first.alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    gone = materialize(found.join(least, "label").where(F.col("_uid") != F.col("first._uid")).select("_uid"), "gone")
    return numbered.join(few(gone, gone.count()), "_uid", "left_anti").select("_row.*")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
c AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.r, w.doc_id) AS component_id,
  coalesce(c.r, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
