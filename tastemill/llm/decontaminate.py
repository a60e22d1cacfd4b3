"""Benchmark decontamination with one Aho-Corasick automaton.

Normalised item texts are cut into windows of ``window`` consecutive words
(an item of fewer words is one window). Each distinct item word gets one
symbol, so a window is a short symbol string; all windows make up one
automaton, and a document, translated word by word, is scanned once. Ends of
matches are word positions, which map back to character offsets of the
original text.

The items travel as a broadcast only while their total size stays below
``PART_BYTES`` (checked first). A larger item table is dealt into parts by
a hash of the text, each with its own automaton, and the parts' hit ranges
are merged per document; results don't depend on the number of parts.

Edge cases: a null or empty text has no words and no hits; a null item text
makes no window; an item with a null id still marks words but isn't listed;
equal items and repeated documents are handled row by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemill.llm.textbuf import spread, table, text_batches

PART_BYTES = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HITS = "struct<n_words:bigint,n_hit:bigint,item_ids:array<string>,words:array<struct<a:bigint,b:bigint>>,spans:array<struct<start:bigint,end:bigint>>>"
HITS_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())),
    ("words", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _fold_table() -> bytes:
    """Byte translation: A-Z to a-z, other ASCII non-alphanumerics to space."""
    t = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        t[i] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(t)


FOLD = _fold_table()


def normalised_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD).split(b" ")


def words_of(text: str | None) -> list[bytes]:
    return [w for w in normalised_words(text) if w]


def symbols():
    """Code points 1.. without the surrogate range; 0 stands for any word
    that no item holds."""
    return (c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF)


def build(items: list[tuple], window: int):
    """Automaton over the items' windows and the word-to-symbol map."""
    import ahocorasick

    code, free, found = {}, symbols(), {}
    for item_id, text in items:
        line = []
        for w in words_of(text):
            if w not in code:
                code[w] = chr(next(free))
            line.append(code[w])
        line = "".join(line)
        for i in range(max(1, len(line) - window + 1) if line else 0):
            found.setdefault(line[i:i + window], set()).add(item_id)
    auto = ahocorasick.Automaton()
    for w, ids in found.items():
        auto.add_word(w, (len(w), frozenset(str(x) for x in ids if x is not None)))
    if found:
        auto.make_automaton()
    return (auto if found else None), code


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint sorted union of half-open ranges (touching ones join)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of ranges of words."""
    at = [m.span() for m in re.finditer(WORD, text)] if ranges else []
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


def scan_text(text: str | None, auto, code: dict) -> dict:
    words = words_of(text)
    ranges, ids = [], set()
    if auto is not None and words:
        get = code.get
        for end, (size, items) in auto.iter("".join([get(w, "\0") for w in words])):
            ranges.append((end + 1 - size, end + 1))
            ids |= items
        ranges = merged(ranges)
    return {"n_words": len(words), "n_hit": sum(b - a for a, b in ranges), "item_ids": sorted(ids),
            "words": [{"a": a, "b": b} for a, b in ranges], "spans": char_spans(text, ranges) if ranges else []}


def _scanner(items, window: int):
    @arrow_udf(HITS)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto, code = build(items.value, window)
        for col in texts:
            yield pa.array([scan_text(t, auto, code) for t in col.to_pylist()], type=HITS_ARROW)

    return scan.asNondeterministic()


def _merge_parts():
    @arrow_udf(HITS)
    def merge(texts: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for text, hits in zip(texts.to_pylist(), parts.to_pylist()):
            ranges = merged([(r["a"], r["b"]) for h in hits for r in h["words"]])
            out.append({"n_words": hits[0]["n_words"], "n_hit": sum(b - a for a, b in ranges),
                        "item_ids": sorted({i for h in hits for i in h["item_ids"]}),
                        "words": [{"a": a, "b": b} for a, b in ranges], "spans": char_spans(text or "", ranges)})
        return pa.array(out, type=HITS_ARROW)

    return merge.asNondeterministic()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text",
                  out: str = "hits", part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: ``n_words``, ``n_hit``,
    ``item_ids`` (distinct, sorted as strings), hit ranges in words and as
    character ``spans`` of the original text. A column already named ``out``
    is replaced. ``items`` has ``item_id`` and ``text``."""
    spark = docs.sparkSession
    text_batches(spark)
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    scans = []
    for p in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p)
        rows = [tuple(r) for r in own.collect()]     # at most about part_bytes
        scans.append(_scanner(spark.sparkContext.broadcast(rows), window)(F.col(text_col)))
    if parts == 1:
        return docs.withColumn(out, scans[0])
    # one pass, part after part; a document's ranges are merged in place
    return docs.withColumn(out, F.array(*scans)).withColumn(out, _merge_parts()(F.col(text_col), F.col(out)))


def digest(hits: DataFrame, col: str = "hits") -> DataFrame:
    h = F.col(col)
    return hits.select(
        "doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"),
        F.size(h["item_ids"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(h["item_ids"], ","), 256).alias("items_sha256"),
        (h["n_hit"] > 0).alias("contaminated"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return digest(contamination(docs, table(spark, sf_dir, "benchmark")))


def items_sha256(ids) -> str:
    """Reference form of the digest, used by tests."""
    return hashlib.sha256(",".join(sorted(str(i) for i in ids)).encode()).hexdigest()


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i, grams.k AS k FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(m.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
  coalesce(m.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN marked m ON d.doc_id = m.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""
