"""Merkle manifest of a dataset: checkpoint and recompute.

Every row is a leaf; the leaves of one source, in the order of their keys,
make a tree of ``FAN`` children a node, and the sources' roots make a tree of
the same kind. Only every ``LEVELS``-th level is stored. An aligned subtree
between two stored levels holds at most ``FAN ** LEVELS`` stored nodes, so it
is one small group whatever the size of its source: building hashes it up to
its top and stores that; proof extraction goes down from the root, regenerates
the levels in between from the stored nodes below, emits each node's siblings
behind those of its ancestor, and drops the regenerated nodes again.

Places of the leaves come from one written layout in the trees' order, so a
source with a third of all rows is spread over many tasks.

Edge cases: a null field counts as ``-``; a null source is a tree of its own
and comes first; null keys come first in their tree; rows of equal keys are
ordered by their leaf, so equal rows are leaves of their own that can change
places without a difference; a tree of one leaf has that leaf as its root; an
empty table has no root and no proofs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastemill.llm.textbuf import spread, table
from tastemill.session import materialize

FAN, LEVELS = 16, 3
SUBTREE = FAN ** LEVELS                 # stored nodes of an aligned subtree at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """Stored levels: ``sources`` from the leaves (``tree``, ``pos``,
    ``digest`` and carried columns) to one root per source; ``top`` from these
    roots to the root of all."""

    sources: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> str | None:
        row = self.top[-1].select(F.lower(F.hex("digest"))).first()
        return None if row is None else row[0]


def leaf(cols: list[Column]) -> Column:
    """A row's digest in lower-case hex."""
    parts = []
    for c in cols:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def runs(nodes: list[str]) -> list[str]:
    """Children of every parent, joined."""
    return ["".join(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)]


def regenerate(nodes: list[str], alone: bool) -> list[list[str]]:
    """The levels of an aligned subtree from its stored nodes to its top. A
    subtree that is a whole tree (``alone``) ends where one node is left."""
    levels = [nodes]
    while len(levels) <= LEVELS and not (alone and len(levels[-1]) == 1):
        levels.append([digest(run) for run in runs(levels[-1])])
    return levels


def in_order(group: pa.Table) -> tuple[pa.Table, list[str], bool]:
    """A subtree's rows by place, their digests, and whether it is its tree."""
    group = group.sort_by("pos")
    nodes = [d.hex() for d in group["digest"].to_pylist()]
    return group, nodes, group["pos"][0].as_py() == 0 and len(nodes) < SUBTREE


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their ``tree`` from 0, in a
    written table. Ties are split by the scan, so no range holds more than
    its share; the sizes to add up are one row per range and tree."""
    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = ["tree", *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    # an id holds the partition above bit 33 and the place in it below
    laid = materialize(dealt.withColumn("at", F.monotonically_increasing_id()).drop("tie"), "leaves").withColumn("part", F.shiftright("at", 33))
    size = laid.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = size.select("part", "tree", (F.sum("rows").over(Window.partitionBy("tree").orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"))
    out = laid.join(before, ["part", "tree"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    return materialize(out, "manifest")


def subtrees(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("pos") / SUBTREE)).groupBy("tree", "block")


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """Stored levels above ``nodes`` up to one node per tree, ``nodes`` first."""
    def top(key: tuple, group: pa.Table) -> pa.Table:
        _, held, alone = in_order(group)
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [bytes.fromhex(regenerate(held, alone)[-1][0])]})

    out = [nodes]
    while not out[-1].where("pos > 0").isEmpty():
        level = out[-1].select("tree", "pos", "digest")
        out.append(materialize(subtrees(level).applyInArrow(top, "tree string, pos bigint, digest binary"), "manifest"))
    return out


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry`` names more columns for the leaves'
    table (not hashed). Only these columns are read."""
    named = [c.alias(n) for n, c in (carry or {}).items()]
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("tree")     # null first
    rows = docs.select(tree, F.col(key).alias("key"), F.unhex(leaf([F.col(c) for c in fields])).alias("digest"), *named)
    sources = stored_levels(placed(rows, ["key", "digest"]))
    roots = sources[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    return Manifest(sources, stored_levels(placed(roots, ["name"])))


def with_paths(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The columns of ``nodes`` with ``path`` (siblings left and right, level
    by level to the root) and ``root``, ``subroot`` of the ``parents``: the
    stored level above with theirs."""
    kept = [f for f in nodes.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + f", path {PATH}, subroot string, root string"

    def extract(key: tuple, group: pa.Table, above: pa.Table) -> pa.Table:
        group, held, alone = in_order(group)
        up = above.to_pylist()[0]
        tail_left, tail_right = [p["left"] for p in up["path"]], [p["right"] for p in up["path"]]
        levels = regenerate(held, alone)[:-1]
        joined = [runs(level) for level in levels]
        left, right = [], []
        for i in range(len(held)):
            at = i
            for level in joined:
                run, j = level[at // FAN], at % FAN * 64
                left.append(run[:j])
                right.append(run[j + 64:])
                at //= FAN
            left += tail_left
            right += tail_right
        off = np.arange(len(held) + 1, dtype=np.int32) * (len(levels) + len(tail_left))
        path = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        out = {f.name: group[f.name] for f in kept}
        return pa.table({**out, "path": path, "subroot": pa.array([up["subroot"]] * len(held), pa.string()), "root": pa.array([up["root"]] * len(held), pa.string())})

    return subtrees(nodes).cogroup(parents.groupBy("tree", "pos")).applyInArrow(extract, schema)


def down(levels: list[DataFrame], parents: DataFrame) -> DataFrame:
    """Paths of the lowest stored level from those of the highest."""
    for i, nodes in reversed(list(enumerate(levels[:-1]))):
        parents = with_paths(nodes, parents.select("tree", "pos", "path", "subroot", "root"))
        if i:
            parents = materialize(parents, "paths")
    return parents


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf (``tree``, ``pos``, ``key``, ``digest``, carried columns)
    with its ``path``, ``subroot`` and ``root``. All that is written are the
    paths of stored interior nodes, one for ``SUBTREE`` leaves."""
    none, hexed = F.array().cast(PATH).alias("path"), F.lower(F.hex("digest"))
    last = manifest.top[-1].select("tree", "pos", none, F.lit("").alias("subroot"), hexed.alias("root"))
    if len(manifest.top) > 1:
        last = down(manifest.top, last).drop("subroot").withColumn("subroot", hexed)
    else:
        last = manifest.top[0].select("name", none, hexed.alias("subroot"), hexed.alias("root"))
    last = materialize(last.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", "subroot", "root"), "paths")
    if len(manifest.sources) > 1:
        return down(manifest.sources, last)
    return manifest.sources[0].join(last, ["tree", "pos"])      # no source has two rows


def fold(leaf_hex: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_hex, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]).cast("binary"), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select(*FIELDS))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    forged = leaf([F.translate("text", upper, lower) if c == "text" else F.col(c) for c in FIELDS])
    done = proofs(build(docs, carry={"forged": F.when(chosen, F.unhex(forged))}))
    shown = done.select(F.col("key").alias("doc_id"), F.lower(F.hex("digest")).alias("leaf"), "subroot", "root",
                        F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256).alias("proof_sha256"),
                        fold(F.lower(F.hex(F.coalesce("forged", "digest"))), F.col("path")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The same by one aggregation per level (``UP`` levels hold 16^6 leaves a
    source) with every level's siblings kept."""
    up = 6
    fields = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
    lowered = fields.replace("CAST(text AS VARCHAR)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    bit = "xor(c.c >> 1, CASE WHEN c.c % 2 = 1 THEN 3988292384 ELSE 0 END)"
    ctes = [f"bits AS (SELECT i, i AS v, 0 AS step FROM range(256) r(i) UNION ALL SELECT i, {bit.replace('c.c', 'v')}, step + 1 FROM bits WHERE step < 8)",
            "crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8)",
            "raw AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256(" + fields + ") AS leaf, sha256(" + lowered + ") AS other, "
            "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), "
            "lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM documents, crc_table)",
            "l0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM raw)",
            "n0 AS (SELECT tree, place AS pos, leaf AS node FROM l0)"]

    def climb(name: str, out: str) -> None:
        for k in range(up):
            prev, cur = f"{name}{k}", f"{name}{k + 1}"
            ctes.append(f"{out}{k} AS (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS n, "
                        f"coalesce(string_agg(node, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, "
                        f"coalesce(string_agg(node, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {prev})")
            ctes.append(f"{cur} AS (SELECT tree, pos // 16 AS pos, CASE WHEN min(n) = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node "
                        f"FROM {out}{k} GROUP BY tree, pos // 16)")

    climb("n", "s")
    ctes.append(f"m0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, node, tree AS name FROM n{up})")
    climb("m", "t")
    text = "WITH RECURSIVE " + ",\n".join(ctes)
    joins, proof = "", []
    for side, tree, pos in (("s", "l.tree", "l.place"), ("t", "''", "m.pos")):
        for k in range(up):
            a = f"{side}{k}"
            joins += f"\nJOIN {a} ON {a}.tree = {tree} AND {a}.pos = {pos} // {16 ** k}"
            proof += [f"{a}.lft", f"{a}.rgt"]
        if side == "s":
            joins += "\nJOIN m0 m ON m.name = l.tree"
    # fold level by level (a nested expression would double at every level)
    steps, last = [], "f"
    cols = ", ".join(f"{side}{k}.n AS {side}{k}n, {side}{k}.lft AS {side}{k}l, {side}{k}.rgt AS {side}{k}r" for side in "st" for k in range(up))
    text += (f",\nf AS (SELECT l.doc_id, l.leaf, m.node AS subroot, z.node AS root, sha256({' || '.join(proof)}) AS proof_sha256, CASE WHEN l.crc % 5 = 0 THEN l.other ELSE l.leaf END AS folded, {cols}\n"
             f"FROM l0 l{joins}\nCROSS JOIN (SELECT node FROM m{up}) z)")
    for side in "st":
        for k in range(up):
            a, name = f"{side}{k}", f"f{side}{k}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN {a}n = 1 THEN folded ELSE sha256({a}l || folded || {a}r) END AS folded) FROM {last})")
            last = name
    return text + ",\n" + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}"


SQL = _sql()
