"""Chosen-path near-dedup against brute force over all pairs."""

import random
import re

import pytest

from tastemill.llm import graph, near_dedup, pairing
from tests.llm.util import awkward, find_root, frame, prose


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = {i: i for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and shared * 100 >= percent * len(sets[i] | sets[j]):
                parent[find_root(parent, i)] = find_root(parent, j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find_root(parent, i)
            ids[r] = min(ids.get(r, d), d)
    return sorted([(d, len(s), ids.get(find_root(parent, i))) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def near_copies(n, seed=5, words=120, edits=4):
    """A group of mutually similar texts beside unrelated ones that share a
    long passage (similar enough to meet, not to link)."""
    rng = random.Random(seed)
    base, passage = prose(rng, words).split(), prose(rng, 60)
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, passage + " " + prose(rng, 40)) for i in range(n)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_awkward_rows(spark, k, percent):
    rows = awkward()
    got = near_dedup.near_duplicates(frame(spark, rows), k, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()], key=str)
    assert found == brute(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("leaf", [4, 256])
def test_big_groups_are_whole(spark, monkeypatch, leaf):
    """Also with tiny leaves, so that nodes branch and pivots take turns."""
    monkeypatch.setattr(pairing, "LEAF", leaf)
    rows = near_copies(60)
    got = near_dedup.near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute(rows, 3, 85)


def test_keep_one(spark):
    rows = awkward()
    docs = frame(spark, rows)
    got = near_dedup.keep_one(docs, 5, 80)
    assert got.columns == docs.columns and got.schema == docs.schema
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 15 not in ids and ids.count(13) == 2
    assert {5, 6, 7, 8, 10, 11} <= set(ids) and 9 not in ids and 12 not in ids and ids.count(None) == 1


def test_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.keep_one(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = sorted((find_root(parent, a), find_root(parent, b)))
        parent[b] = a
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}
    for x in parent:
        r = find_root(parent, x)
        least[r] = min(least.get(r, x), x)
    assert got == {x: least[find_root(parent, x)] for x in parent if least[find_root(parent, x)] != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_identified_repeats(spark, tmp_path):
    """Numbers don't depend on how a table is split or which columns are read."""
    frame(spark, awkward(), 4).write.parquet(str(tmp_path / "d.parquet"))
    docs = spark.read.parquet(str(tmp_path / "d.parquet"))
    one = {(r["_uid"], r["text"]) for r in pairing.identified(docs).select("_uid", "_row.text").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    two = {(r["_uid"], r["text"]) for r in pairing.identified(docs.select("doc_id", "text")).select("_uid", "_row.text").collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one == two and len({u for u, _ in one}) == docs.count()
