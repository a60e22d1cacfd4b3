"""The manifest against a plain recursive version, for trees of one to four
stored levels, and its proofs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tastemill.llm import merkle as M
from tests.llm.util import awkward, frame, write_tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row) -> str:
    return h("".join(field(v) for v in row))


def tree(nodes: list[str]):
    """Root, and for every leaf its siblings level by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            lo, j = at[i] // M.FAN * M.FAN, at[i]
            p.append(("".join(nodes[lo:j]), "".join(nodes[j + 1:lo + M.FAN])))
        nodes = [h("".join(nodes[i:i + M.FAN])) for i in range(0, len(nodes), M.FAN)]
        at = [i // M.FAN for i in at]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        held = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s] = (held, *tree([leaf(r) for r in held]))
    root, tops = tree([subs[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        held, sub, paths = subs[s]
        for r, p in zip(held, paths):
            p = p + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], None if r[4] is None else r[4].translate(LOWER))) if hit else leaf(r)
            for a, b in p:
                node = h(a + node + b)
            out.append((r[0], leaf(r), sub, root, h("".join(a + b for a, b in p)), node, node == root))
    return sorted(map(str, out))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, digest string, path string"


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "t", 9, "d", "p") for r in rows], SCHEMA)
    return M.op11_merkle(spark, write_tables(spark, str(tmp_path), documents=df))


@pytest.mark.parametrize("sizes", [[0], [1], [1, 1], [17], [16, 15, 300, 1], [1] * 20, [4096, 1], [4097, 260]])
def test_trees_of_many_shapes(spark, tmp_path, sizes):
    rows, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i * 7 % 100003, None if s == 1 else f"s{s}é", "en" if i % 3 else None, i if i % 5 else None, f"Text {i} ABC" if i % 2 else None))
            i += 1
    done = run(spark, tmp_path, rows)
    assert done.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in done.collect()) == (brute(rows) if rows else [])


def test_awkward_rows(spark, tmp_path):
    rows = [(i, [None, "a", "="][k % 3], "en", k, t) for k, (i, t) in enumerate(awkward())] * 3
    assert sorted(str(tuple(r)) for r in run(spark, tmp_path, rows).collect()) == brute(rows)


def test_many_sources_and_deep_trees(spark, monkeypatch):
    """With small subtrees every part has several stored levels."""
    monkeypatch.setattr(M, "FAN", 2)
    monkeypatch.setattr(M, "SUBTREE", 8)
    rows = [(i, f"s{i % 30:02}" if i < 200 else "hot", "en", 1, f"T{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = M.build(df)
    assert len(m.sources) >= 4 and len(m.top) >= 2
    got = M.proofs(m)
    root, _ = tree([tree([leaf(r) for r in sorted(r for r in rows if r[1] == s)])[0] for s in sorted({r[1] for r in rows})])
    assert m.root() == root
    bad = got.select(M.fold(F.lower(F.hex("digest")), F.col("path")).alias("r"), "root").where(F.col("r") != F.col("root"))
    assert got.count() == 700 and bad.count() == 0 and got.where(F.col("root") != root).count() == 0
    # another row's digest doesn't fold to the root
    assert got.where(M.fold(F.sha2(F.lit(b"x"), 256), F.col("path")) == F.col("root")).count() == 0


def test_one_change_changes_the_root(spark):
    rows = awkward()
    a, b = M.build(frame(spark, rows)).root(), M.build(frame(spark, [*rows[:-1], (15, "other")])).root()
    assert a != b and a == M.build(frame(spark, rows[::-1], 1)).root()
    assert M.build(frame(spark, [])).root() is None
