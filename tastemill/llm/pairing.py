"""Shared parts of the similarity joins: row identities, nodes (buckets) of
candidates, and one level of comparing them.

Rows of a node table: ``node`` (bucket), ``rep`` (whom it holds) and payload
columns that the quick comparison needs. Several nodes may hold a pair.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.session import discard, materialize

LEAF = 128                         # a quick comparison is a few bit operations
BROADCAST_IDS = 1_000_000          # ids sent to all executors at most (8 MB)


def identified(docs: DataFrame) -> DataFrame:
    """``_uid`` and ``_row`` (all columns of ``docs`` as one struct, so no
    name can clash): ``_uid`` is one number per row that every later read of
    the same table repeats: file (by a checksum of its name) and row within
    it. A frame that isn't a plain table read is written once first."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    for attempt in (docs, None):
        if attempt is None:
            attempt = materialize(docs, "numbered")
        names = [zlib.crc32(os.path.basename(unquote(f)).encode()) for f in attempt.inputFiles()]
        if names and len(set(names)) == len(names):
            file = F.crc32(F.col("_metadata.file_name").cast("binary"))
            try:
                return attempt.select(whole, F.shiftleft(file, 31).bitwiseOR(F.col("_metadata.row_index")).alias("_uid"))
            except AnalysisException:       # no table read below
                continue
    # an empty frame has no file, so any number will do
    return attempt.select(whole, F.monotonically_increasing_id().alias("_uid"))


def few(keys: DataFrame, count: int) -> DataFrame:
    """Broadcast a table of ids only while it is small; beyond that the join
    shuffles (and Spark may push a Bloom filter down by itself)."""
    return F.broadcast(keys) if count <= BROADCAST_IDS else keys


def shared_nodes(rows: DataFrame) -> DataFrame:
    """The rows of nodes that hold two or more, written once. Most nodes of
    a first level hold one row; only their numbers are shuffled."""
    keys = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("node"), "shared")
    out = materialize(rows.join(few(keys, keys.count()), "node", "left_semi"), "rows")
    discard(keys)
    return out


def step(rows: DataFrame, labels: DataFrame | None, alike: Callable[[str, str], Column], payload: list[str], pivots: int = 1, leaf: int | None = None):
    """Compare a node table once: (candidate pairs ``a`` < ``b``, rows left,
    both in written tables; the node table itself is used up). ``g`` numbers
    pairs that share rows: the pairs of a node with up to ``LEAF`` rows on
    each side.

    ``labels`` (``node``, ``label``) tells which rows are connected already.
    A node whose rows are all in one component is done. One with at most
    ``leaf`` (``LEAF``) rows outside its largest component is done by comparing these
    with everyone. In a bigger node ``pivots`` rows (about) are compared with
    everyone and leave; the others are the rows left."""
    cols, leaf = ["rep", *payload], LEAF if leaf is None else leaf
    if labels is None:
        rows = rows.withColumn("label", F.col("rep"))
    else:
        rows = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    first = F.min(F.struct(F.xxhash64("node", "rep").alias("h"), *cols, "label"))
    per = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"), first.alias("p"))
    nodes = per.groupBy("node").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("most"), F.min("p").alias("pivot"))
    nodes = nodes.select("node", "total", F.col("most.label").alias("top"), (F.col("total") - F.col("most.c")).alias("rest"), "pivot").where("rest > 0")
    nodes = nodes.withColumn("pivot", F.when(F.col("rest") > leaf, F.col("pivot")))           # small nodes have no pivot
    held = materialize(rows.join(nodes, "node"), "nodes")
    pair = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    group = lambda rep: F.xxhash64("node", F.pmod(F.xxhash64(rep), F.ceil(F.col("total") / LEAF))).alias("g")
    small, big = held.where(F.col("rest") <= leaf), held.where(F.col("rest") > leaf)
    x, y = small.where(F.col("label") != F.col("top")).alias("x"), small.withColumn("g", group("rep")).alias("y")
    pairs = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
                   & ((F.col("y.label") == F.col("y.top")) | (F.col("x.rep") < F.col("y.rep"))) & alike("x", "y")).select(*pair, F.col("y.g").alias("g"))
    leaves = F.col("rep") == F.col("pivot.rep")
    if pivots == 1:
        starred = big.select(F.struct(*cols, "label").alias("x"), F.col("pivot").alias("y"), group("rep"))
    else:
        leaves = leaves | (F.pmod(F.xxhash64("node", "rep", F.lit(7)), F.col("total")) < pivots - 1)
        chosen = big.where(leaves).select("node", F.struct(*cols, "label").alias("y"))
        starred = big.select("node", F.struct(*cols, "label").alias("x"), group("rep")).join(chosen, "node")
    starred = starred.where((F.col("x.label") != F.col("y.label")) & alike("x", "y")).select(*pair, "g")
    found, left = materialize(pairs.union(starred).groupBy("a", "b").agg(F.min("g").alias("g")), "pairs"), materialize(big.where(~leaves).select("node", *cols), "rows")
    discard(held)
    return found, left
