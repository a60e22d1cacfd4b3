"""Cross-tokenizer alignment with an identity-map fast path.

Two tokenizers cut the same bytes (a space and the text). Offsets where both
end a token cut the text into groups; every token of one side is linked with
every token of the other side in its group.

Most groups hold one token a side with the same bytes. A map from each A id
to the B id of the same bytes is made once, so such a link is known by its A
id alone: links on the map are counted in vectors of the vocabulary's length.
Only the other links, from irregular groups, are pairs that have to be
shuffled. A link on the map inside an irregular group is counted in the vector
too, so a pair is counted in one place only.

Counts of pairs are document frequencies. Pairs that make up over 1/``HOT`` of
all are at most ``HOT``, whatever the input: they travel as one sorted array.
The others are joined by shuffle, none of them hot enough to hurt.

Texts are encoded whole and aligned some at a time, all tokens of a batch at
once: equal offsets are found in two sorted lists. Parts of words that A has
met are remembered up to a bound.

Edge cases: null and empty texts, and texts that one of the tokenizers does
not give back byte by byte (U+2581 is a space to B), have no tokens; repeated
rows count one by one; special tokens' strings are plain text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm.textbuf import spread, table
from tastemill.llm.token_files import DIGITS, LETTERS, Words, byte_of_char, library_tokenizer, on_worker
from tastemill.session import materialize

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
HOT = 50_000                         # pairs in the array that all tasks get, at most
MEMO = 400_000                       # remembered parts of words per Python worker
BYTES, BIG = 4 << 20, 1 << 12        # signs aligned at a time (or one text); links of a group that is counted by distinct ids
ID = (1 << 20) - 1
A_PARTS = f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\\s{LETTERS}{DIGITS}]+|\\s+(?!\\S)|\\s+"      # A's own pattern, for plain texts
LINKS = "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, same array<int>, same_m array<bigint>, odd array<bigint>, odd_m array<bigint>"


def a_bytes(tokenizer) -> list[bytes]:
    back, vocab = byte_of_char(), tokenizer.get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        out[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    return out


def b_bytes(model) -> list[bytes]:
    out = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode())
    return out


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """A id -> the B id of the same bytes (a piece before a byte), or -1."""
    at: dict[bytes, int] = {}
    for i, x in enumerate(b):
        if x not in at or len(x) == 1:       # single bytes come first, their characters later
            at[x] = i
    return np.array([at.get(x, -1) if x else -1 for x in a], dtype=np.int64)


def joined(of: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, their lengths and where they start."""
    size = np.array([len(x) for x in of], dtype=np.int64)
    return np.frombuffer(b"".join(of), np.uint8), size, np.cumsum(size) - size


def spelled(ids: np.ndarray, of: tuple) -> np.ndarray:
    """The bytes of a run of tokens."""
    data, size, start = of
    n = size[ids]
    return data[np.arange(int(n.sum())) + np.repeat(start[ids] - (np.cumsum(n) - n), n)]


class Aligner:
    """Both tokenizers on one Python worker."""

    def __init__(self, a_file: str, b_model: bytes):
        from sentencepiece import SentencePieceProcessor

        a, self.b = library_tokenizer(a_file, plain_specials=True), SentencePieceProcessor(model_proto=b_model)
        a_of, b_of = a_bytes(a), b_bytes(self.b)
        self.a_of, self.b_of = joined(a_of), joined(b_of)
        self.same = identity_map(a_of, b_of)
        self.words = Words(a, A_PARTS, False, MEMO)
        self.words.special = []
        self.shown = [b"%d%s" % (i, mark) for i in range(max(len(a_of), len(b_of))) for mark in (b",", b"|", b";")]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [self.words.by_part(t) if self.words.quick(t) else self.words.whole(t) for t in [" " + t for t in texts]]
        return [np.frombuffer(x, "<u4") for x in a], [np.array(x, dtype=np.uint32) for x in self.b.encode(texts, num_threads=1)]

    def ids(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides, none where a side doesn't give the bytes back."""
        a, b = self.encode(["" if t is None else t for t in texts])
        whole = [(" " + t).encode() if t else b"" for t in texts]
        ok = [len(w) > 0 for w in whole]
        for side, of in ((a, self.a_of), (b, self.b_of)):
            size = [int(of[1][x].sum()) for x in side]
            back, at = spelled(np.concatenate(side), of).tobytes(), 0
            for i, n in enumerate(size):
                ok[i] = ok[i] and back[at:at + n] == whole[i]
                at += n
        return tuple([x if k else x[:0] for x, k in zip(side, ok)] for side in (a, b))

    def documents(self, texts: list[str | None]) -> tuple:
        """Per text: tokens of A and of B, groups, links, digest of the
        groups; and the links as (text, A id, B id, occurrences), sorted."""
        sides = self.ids(texts)
        n_a, n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in sides)
        a, b = (np.concatenate(side).astype(np.int64) for side in sides)
        doc = np.repeat(np.arange(len(texts)), n_a)
        # both sides' bytes are equal text by text, so one running offset serves all texts
        end_a, end_b = np.cumsum(self.a_of[1][a]), np.cumsum(self.b_of[1][b])
        shut_a, shut_b = (np.isin(x, y, assume_unique=True) for x, y in ((end_a, end_b), (end_b, end_a)))
        group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        of_a, of_b = np.bincount(group_a), np.bincount(group_b)                         # tokens by group
        home = doc[shut_a]
        add = lambda x: np.bincount(home, weights=x, minlength=len(texts)).astype(np.int64)
        n_groups, n_links = add(np.ones(len(home))), add(of_a * of_b)

        first_a, first_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        marks = np.empty(len(a) + len(b), dtype=np.int64)                               # id and what follows it
        marks[np.arange(len(a)) + first_b[group_a]] = a * 3 + shut_a
        marks[np.arange(len(b)) + first_a[group_b] + of_a[group_b]] = b * 3 + 2 * shut_b
        ends = np.cumsum(n_a + n_b)
        texts_ = [b"".join(map(self.shown.__getitem__, marks[lo:hi].tolist()))[:-1] for lo, hi in zip(ends - n_a - n_b, ends)]
        digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts_]

        big = of_a * of_b > BIG
        each = np.where(big[group_a], 0, of_b[group_a])                                 # A tokens meet their group's B tokens
        left = np.repeat(np.arange(len(a)), each)
        right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + first_b[group_a[left]]
        keys, times = [doc[left] << 40 | a[left] << 20 | b[right]], [np.ones(len(left), dtype=np.int64)]
        for g in np.flatnonzero(big):                                                   # by distinct ids, not by occurrence
            (x, p), (y, q) = (np.unique(i[f[g]:f[g] + n[g]], return_counts=True) for i, f, n in ((a, first_a, of_a), (b, first_b, of_b)))
            keys.append((home[g] << 40 | x[:, None] << 20 | y).reshape(-1))
            times.append((p[:, None] * q).reshape(-1))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)
        return n_a, n_b, n_groups, n_links, digests, (key >> 40, key >> 20 & ID, key & ID, count)


def links(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document in a written table: counts, digest of its groups,
    links on the identity map (``same``: A ids) and other links (``odd``: A id
    << 32 | B id), each with their numbers of occurrences."""
    with open(a_path, encoding="utf-8") as f:
        a_file = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    held = docs.sparkSession.sparkContext.broadcast((a_file, b_model))        # vocabulary files, of fixed size
    name = "align " + hashlib.sha256(a_file.encode() + b_model).hexdigest()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def lists(doc: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
        off = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = on_worker(name, lambda: Aligner(*held.value))
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:                  # some texts at a time, by their bytes
                texts, size = [], 0
                while lo + len(texts) < batch.num_rows and len(texts) < 256 and size < BYTES:
                    texts.append(batch.column(1)[lo + len(texts)].as_py())
                    size += len(texts[-1] or "")
                n = len(texts)
                n_a, n_b, n_groups, n_links, digests, (doc, a, b, count) = at.documents(texts)
                same = at.same[a] == b if len(a) else np.zeros(0, dtype=bool)
                cols = [lists(doc[same], a[same], n, pa.int32()), lists(doc[same], count[same], n, pa.int64()),
                        lists(doc[~same], (a << 32 | b)[~same], n, pa.int64()), lists(doc[~same], count[~same], n, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), *[pa.array(c) for c in (n_a, n_b, n_groups, n_links)], pa.array(digests, pa.string()), *cols],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_m", "odd", "odd_m"])
                lo += n

    out = rows.mapInArrow(run, LINKS.format(kind=rows.schema["id"].dataType.simpleString()))
    return materialize(out.withColumn("uid", F.monotonically_increasing_id()), "links")


def same_counts(found: DataFrame) -> DataFrame:
    """``a``, ``n``: documents with the link of A id ``a`` on the map. Every
    task adds up one vector of the vocabulary's length."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False)      # distinct within a document
            if len(ids):
                more = np.bincount(ids, minlength=len(total))
                more[:len(total)] += total
                total = more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["a", "n"])

    return found.select("same").mapInArrow(add, "a int, n bigint").groupBy("a").agg(F.sum("n").alias("n"))


def with_counts(found: DataFrame, hot: int = HOT) -> DataFrame:
    """``found`` (of ``links``) with ``n_best`` (links whose count is the
    highest of their A id) and ``count_sum`` (counts of all links)."""
    spark = found.sparkSession
    same = materialize(same_counts(found), "same")                              # at most one row per A id
    odd = materialize(found.select(F.explode("odd").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    a_of = F.shiftright("pair", 32).cast("int")
    best = materialize(same.union(odd.select(a_of.alias("a"), "n")).groupBy("a").agg(F.max("n").alias("best")), "best")
    total = odd.agg(F.sum("n")).first()[0] or 0
    frequent = odd.where(F.col("n") > total / hot)                              # fewer than ``hot``, as they add up to ``total``

    def vector(rows, of: str) -> np.ndarray:
        rows = rows.toPandas()
        out = np.zeros(int(rows["a"].max()) + 1 if len(rows) else 1, dtype=np.int64)
        out[rows["a"].to_numpy(dtype=np.int64)] = rows[of]
        return out

    top = frequent.orderBy("pair").toPandas()
    most = vector(best, "best")
    held = spark.sparkContext.broadcast((vector(same, "n"), most, top["pair"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64)))
    kept = [f for f in found.schema.fields if f.name not in ("same", "same_m", "odd", "odd_m")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_best bigint, count_sum bigint, rare array<bigint>, rare_m array<bigint>"

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_n, highest, pairs, pair_n = held.value

        def lists(batch, name):
            col = batch.column(batch.schema.get_field_index(name))
            return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())

        def per_row(values, size):
            return np.add.reduceat(np.append(values, 0), np.minimum(np.cumsum(size) - size, len(values))) * (size > 0) if len(size) else values

        for batch in batches:
            ids, size = lists(batch, "same")
            m = lists(batch, "same_m")[0]
            n = same_n[ids] if len(ids) else m
            best_, sum_ = per_row(m * (n == highest[ids]) if len(ids) else m, size), per_row(m * n, size)
            odd_, size = lists(batch, "odd")
            m = lists(batch, "odd_m")[0]
            at = np.minimum(np.searchsorted(pairs, odd_), max(len(pairs) - 1, 0))
            hit = pairs[at] == odd_ if len(pairs) else np.zeros(len(odd_), dtype=bool)
            n = np.where(hit, pair_n[at], 0) if len(pairs) else np.zeros(len(odd_), dtype=np.int64)
            best_, sum_ = best_ + per_row(m * (hit & (n == highest[odd_ >> 32])), size), sum_ + per_row(m * n, size)
            left = per_row((~hit).astype(np.int64), size)
            off = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            rare = [pa.ListArray.from_arrays(off, pa.array(odd_[~hit])), pa.ListArray.from_arrays(off, pa.array(m[~hit]))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(best_), pa.array(sum_), *rare], names=[*[f.name for f in kept], "n_best", "count_sum", "rare", "rare_m"])

    part = materialize(found.mapInArrow(known, schema), "counted")
    others = odd.where(F.col("n") <= total / hot).join(F.broadcast(best.withColumnRenamed("a", "x")), a_of == F.col("x")).select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    rare = part.select("uid", F.explode(F.arrays_zip("rare", "rare_m")).alias("r")).select("uid", F.col("r.rare").alias("pair"), F.col("r.rare_m").alias("m"))
    more = rare.join(others, "pair").groupBy("uid").agg(F.sum(F.col("m") * F.col("top").cast("int")).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more_sum"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return part.join(more, "uid", "left").select(*[f.name for f in kept], plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return with_counts(links(docs)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
