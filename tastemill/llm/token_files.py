"""Token ids as files: patched frame-of-reference blocks.

Documents are encoded in ascending order of their ids; each ends with an end
id. The stream is cut into blocks of ``BLOCK`` ids. A block keeps its minimum,
the differences to it packed at the width that holds ``PERCENTILE`` percent of
them, and the others in an exception list (place, difference).

A segment is a byte string that can be read by itself (little endian):
``PFR1``, ids, blocks, byte offset of every block, then per block minimum
(u32), width (u8, one byte unused), exceptions (u16), packed differences,
places (u16) and differences (u32) of the exceptions. A reader finds a block by
the offsets and unpacks no other. Segments are rows of a Parquet table, next
to the documents in them, so writing needs no file access of its own on the
executors, lost tasks leave nothing behind, and readers skip what they don't
need. A document of over ``SEGMENT`` ids takes several segments.

Order comes from a range partitioning; a document's place in the whole stream
is its place in the partition plus the sizes of earlier ones (one row each).

Edge cases: null and empty texts are an end id only; null document ids come
first; rows of equal ids are ordered by a hash of their text, so only equal
rows can change places; texts are encoded whole, whatever their length; an
empty table gives no segment and no row.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from tastemill.llm.textbuf import table
from tastemill.session import materialize

MODEL_PATH = "/opt/tokenizers/word_bpe_49k.json"
END = 2
BLOCK, PERCENTILE, SEGMENT = 512, 90, 1 << 16
MEMO_WORDS, MEMO_PARTS = 200_000, 800_000       # remembered words and parts of words per Python worker
LETTERS, DIGITS = "a-zA-ZÀ-ÖØ-öø-ÿ", "0-9"       # of the signs ! to ~ and À to ÿ, which no normalisation changes
MAGIC = b"PFR1"
SEGMENTS = ("shard int, seq int, first bigint, n_ids int, data binary, "
            "docs array<struct<id:{kind},no:bigint,piece:int,pieces:int,at:int,n:int>>")


# -- the format ---------------------------------------------------------------

def pack(ids: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit ids."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if n else 0, dtype=np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    nth = -(-BLOCK * PERCENTILE // 100) - 1
    cut = np.partition(delta, nth, axis=1)[:, nth].astype(np.float64)
    width = np.ceil(np.log2(cut + 1)).astype(np.int64)
    odd_row, odd_at = np.nonzero(delta >= np.left_shift(np.uint64(1), width.astype(np.uint64))[:, None])
    held = np.split(odd_at, np.searchsorted(odd_row, np.arange(1, blocks)))
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(delta[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        lines = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for r, line in zip(rows, lines):
            packed[r] = line.tobytes()
    body = [struct.pack("<IBxH", int(low[r]), int(width[r]), len(held[r])) + packed[r] + held[r].astype("<u2").tobytes() + delta[r][held[r]].astype("<u4").tobytes()
            for r in range(blocks)]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in body], dtype=np.int64)]).astype("<u4")
    return MAGIC + struct.pack("<II", n, blocks) + starts.tobytes() + b"".join(body)


def unpack(data: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids [lo, hi) of a segment; blocks outside aren't touched."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks = struct.unpack_from("<II", data, 4)
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.zeros(0, dtype=np.uint32)
    starts = np.frombuffer(data, "<u4", blocks + 1, 12)
    first, last = lo // BLOCK, (hi - 1) // BLOCK
    body, at = 12 + 4 * (blocks + 1), starts[first:last + 1].astype(np.int64)
    heads = [struct.unpack_from("<IBxH", data, body + int(x)) for x in at]
    width = np.array([h[1] for h in heads])
    out = np.zeros((len(at), BLOCK), dtype=np.uint32)
    whole = np.frombuffer(data, np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        lines = whole[(body + 8 + at[rows])[:, None] + np.arange(BLOCK * w // 8)]
        bits = np.zeros((len(rows), BLOCK, 32), dtype=np.uint8)
        bits[:, :, :w] = np.unpackbits(lines, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        out[rows] = np.packbits(bits, axis=2, bitorder="little").reshape(len(rows), -1).view("<u4")
    for line, (_, w, odd), x in zip(out, heads, at):
        if odd:
            end = body + 8 + int(x) + BLOCK * w // 8
            line[np.frombuffer(data, "<u2", odd, end)] = np.frombuffer(data, "<u4", odd, end + 2 * odd)
    out += np.array([h[0] for h in heads], dtype=np.uint32)[:, None]
    return out.reshape(-1)[lo - first * BLOCK:hi - first * BLOCK]


# -- words --------------------------------------------------------------------

def on_worker(key: str, make):
    """A value that a Python worker keeps between its tasks."""
    held = sys.__dict__.setdefault("_tastemill_worker", {})
    if key not in held:
        held[key] = make()
    return held[key]


def library_tokenizer(text: str, plain_specials: bool = False):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(text)
    found.encode_special_tokens = plain_specials
    return found


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Parts(dict):
    """Part of a word -> its ids as little-endian bytes by the library's
    model, the first ones met held up to a bound."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.limit, self.tokenize, self.sign = limit, model.tokenize, {b: c for c, b in byte_of_char().items()}
        self.blank = {b: self.sign[b] for b in b" \n"}          # the signs of plain texts that don't stand for themselves

    def __missing__(self, part: str) -> bytes:
        if not part.isascii():
            part_ = "".join(map(self.sign.__getitem__, part.encode()))
        elif part.isalnum():
            part_ = part
        else:
            part_ = part.translate(self.blank)
        got = array("I", [t.id for t in self.tokenize(part_)]).tobytes()
        if len(part) <= 64 and len(self) < self.limit:
            self[part] = got
        return got


class Words(dict):
    """Word -> its ids as little-endian bytes, the first ones met held up to a
    bound. What holds printable ASCII signs and Latin-1 letters only is cut by
    the tokenizer's own pattern, and the library's model encodes each part;
    any other word goes through the library's whole encoding."""

    def __init__(self, tokenizer, pattern: str | None, lower: bool, parts: int = MEMO_PARTS):
        super().__init__()
        self.tokenizer, self.lower, self.parts = tokenizer, lower, Parts(tokenizer.model, parts)
        self.find = re.compile(pattern).findall if pattern else None
        self.plain = re.compile("[ -~À-ÿ\n]*").fullmatch
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def quick(self, text: str) -> bool:
        """May the text be cut by the pattern?"""
        return self.find is not None and self.plain(text) is not None and not any(t in text for t in self.special)

    def by_part(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.find(text.lower() if self.lower else text)))

    def __missing__(self, word: str) -> bytes:
        got = self.by_part(word) if self.quick(word) else self.whole(word)
        if len(word) <= 64 and len(self) < MEMO_WORDS:
            self[word] = got
        return got


def word_rule(spec: dict) -> tuple[str | None, bool]:
    """(pattern of a word's parts, for plain words; whether letters fold) of a
    tokenizer file that drops white space before it looks for parts, else
    (None, False)."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    if [t["type"] for t in steps] != ["Split", "ByteLevel"] or not set(norms) <= {"NFC", "Replace", "Lowercase"} or spec["model"]["type"] != "BPE":
        return None, False
    pattern = steps[0]["pattern"].get("Regex", "")
    spaced = steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or not pattern.endswith("[^\\s\\p{L}\\p{N}]+")
    if spaced or steps[1]["use_regex"] or steps[1]["add_prefix_space"] or any(" " in t["content"] or "\n" in t["content"] for t in spec["added_tokens"]):
        return None, False
    return pattern.replace("\\p{L}", LETTERS).replace("\\p{N}", DIGITS), "Lowercase" in norms


def text_ids(text: str | None, words: Words, end: int) -> np.ndarray:
    """A text's ids and the end id. Where the tokenizer takes no white space
    into its tokens, the words between spaces are encoded one by one."""
    last = np.array([end], dtype="<u4").tobytes()
    if not text:
        got = b""
    elif words.quick(text):
        got = words.by_part(text)
    elif words.find:
        got = b"".join([words[w] for w in text.replace("\n", " ").split(" ") if w])
    else:
        got = words.whole(text)
    return np.frombuffer(got + last, dtype="<u4")


# -- tables -------------------------------------------------------------------

def write(docs: DataFrame, model_path: str = MODEL_PATH, end: int = END, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Encodes ``docs`` in the order of their ids and writes the segments to
    the shared folder; returns their table."""
    import hashlib
    import json

    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as f:
        raw = f.read()
    rule = word_rule(json.loads(raw))
    held, name = spark.sparkContext.broadcast(raw), hashlib.sha256(raw.encode()).hexdigest()      # a vocabulary file, of fixed size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, n = rows.schema["id"].dataType, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["id", "code", "tie"]
    rows = (rows.withColumn("code", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
            .repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text"))
    entry = [("no", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = on_worker(f"words {name}", lambda: Words(library_tokenizer(held.value), *rule))
        shard, seq, first, no = TaskContext.get().partitionId(), 0, 0, 0
        parts, inside, size, id_type = [], [], 0, None

        def close() -> pa.RecordBatch:
            nonlocal seq, first, parts, inside, size
            ids = np.concatenate(parts)
            cols = list(zip(*inside))
            doc = pa.StructArray.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, t) for c, (_, t) in zip(cols[1:], entry)]], ["id", *[k for k, _ in entry]])
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int32()),
                 pa.array([pack(ids)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(inside)], pa.int32()), doc)],
                names=["shard", "seq", "first", "n_ids", "data", "docs"])
            seq, first, parts, inside, size = seq + 1, first + size, [], [], 0
            return out

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                ids = text_ids(batch.column(1)[i].as_py(), words, end)
                if size and size + len(ids) > segment:
                    yield close()
                pieces = -(-len(ids) // segment)
                for p in range(pieces):
                    part = ids[p * segment:(p + 1) * segment]
                    inside.append((batch.column(0)[i].as_py(), no, p, pieces, size, len(part)))
                    parts.append(part)
                    size += len(part)
                    if p < pieces - 1:
                        yield close()
                no += 1
        if size:
            yield close()

    return materialize(rows.mapInArrow(encoded, SEGMENTS.format(kind=kind.simpleString())), "token-files")


def read(segments: DataFrame) -> DataFrame:
    """``id``, ``start`` (ids of all documents before), ``ids`` of every
    document in written segments."""
    return _documents(segments, "ids array<int>", lambda ids, off: [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.view(np.int32)))], "ids")


def checksums(segments: DataFrame) -> DataFrame:
    """Like ``read``, but the number of ids and their checksum (CRC-32 of
    little-endian unsigned 32-bit integers) in place of the ids."""
    def crcs(ids: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.diff(off)), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(off[:-1], off[1:])], pa.int64())]

    @arrow_udf(LongType())
    def crc(ids: pa.Array) -> pa.Array:
        return crcs(ids.values.to_numpy(zero_copy_only=False).view(np.uint32), ids.offsets.to_numpy())[1]

    return _documents(segments, "n_tokens bigint, crc32 bigint", crcs, F.size("ids").cast("bigint"), crc("ids"))


def _documents(segments: DataFrame, columns: str, shown, *of_split) -> DataFrame:
    """Every document with ``columns``: by ``shown`` (ids of some documents
    and their offsets -> Arrow columns) inside the task that unpacks it, by
    the expressions ``of_split`` over ``ids`` if it lies in several segments."""
    kind = segments.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    base = sizes.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))      # one row per partition

    def unpacked(batches: Iterator[pa.RecordBatch], whole: bool):
        for batch in batches:
            id_type = batch.schema.field("docs").type.value_type.field("id").type
            for row in batch.to_pylist():
                docs = [d for d in row["docs"] if (d["pieces"] == 1) == whole]
                if docs:
                    off, at = np.cumsum([0, *[d["n"] for d in docs]]), docs[0]["at"]         # one next to the other
                    start = pa.array([row["base"] + row["first"] + d["at"] for d in docs], pa.int64())
                    yield row["shard"], docs, pa.array([d["id"] for d in docs], id_type), start, unpack(row["data"], at, at + int(off[-1])), off

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", *[c.split()[0] for c in columns.split(", ")]]
        for _, _, ids_of, start, ids, off in unpacked(batches, True):
            yield pa.RecordBatch.from_arrays([ids_of, start, *shown(ids, off)], names=names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, docs, ids_of, start, ids, off in unpacked(batches, False):
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([ids_of, start, pa.array([shard] * len(docs), pa.int32()), pa.array([d["no"] for d in docs], pa.int64()),
                                              pa.array([d["piece"] for d in docs], pa.int32()), lists], names=["id", "start", "shard", "no", "piece", "ids"])

    rows = segments.join(F.broadcast(base), "shard")
    # a document's pieces meet again: together they are one row, as its text was
    split = (rows.where(F.exists("docs", lambda d: d["pieces"] > 1)).mapInArrow(pieces, f"id {kind}, start bigint, shard int, no bigint, piece int, ids array<int>")
             .groupBy("shard", "no").agg(F.first("id").alias("id"), F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("all"))
             .select("id", "start", F.flatten(F.col("all.ids")).alias("ids")))
    return rows.mapInArrow(complete, f"id {kind}, start bigint, {columns}").union(split.select("id", "start", *of_split))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = checksums(write(table(spark, sf_dir, "documents")))
    return done.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))
