"""Packed blocks against their definition, and token files against the library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm import token_files as T
from tests.llm.util import awkward, frame, prose


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(T.MODEL_PATH)


def expected(rows):
    """doc -> (start, ids) by the library on whole texts, in the stated order."""
    tok, out, at = library(), [], 0
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [T.END]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def shown(segments):
    """The checksums, after a look at the ids themselves."""
    rows = T.checksums(segments).select("id", "start", "n_tokens", "crc32").collect()
    ids = T.read(segments).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str((r["id"], r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))) for r in ids)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_pack_round_trip_and_exceptions(seed):
    rng = np.random.default_rng(seed)
    for ids in (np.zeros(0), np.array([7]), np.full(300, 5), np.array([0, 2**32 - 1] * 200), rng.integers(0, 50000, 1000), rng.zipf(1.5, 5000) % 2**32,
                np.concatenate([rng.integers(0, 16, 255), [2**31]])):
        ids = ids.astype(np.uint32)
        data = T.pack(ids)
        assert (T.unpack(data) == ids).all()
        for lo, hi in ((0, 1), (3, 260), (255, 257), (T.BLOCK - 1, T.BLOCK + 1), (len(ids) - 1, len(ids)), (5, 5)):
            if 0 <= lo:
                assert (T.unpack(data, lo, hi) == ids[lo:hi]).all()
    # nine of ten differences fit four bits: one exception, half a byte for the others
    data = T.pack(np.concatenate([np.arange(T.BLOCK - 1) % 16, [2**31]]).astype(np.uint32))
    assert len(data) == 12 + 8 + 8 + T.BLOCK // 2 + 6


def test_words_equal_whole_texts():
    import json
    tok = library()
    raw = open(T.MODEL_PATH, encoding="utf-8").read()
    rule = T.word_rule(json.loads(raw))
    assert rule[0] and rule[1]
    words, whole, rng = T.Words(T.library_tokenizer(raw), *rule), T.Words(T.library_tokenizer(raw), None, False), random.Random(5)
    alphabet = "aeB's  \n\t\r\x0b\x1c\x1f\x85\xa0 　́é9٣中文ß İ'll<|endoftext|>.,!ﬁ​\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(map(chr, (rng.randrange(1, top) for _ in range(30)))) for _ in range(3000) for top in (128, 256, 600)]
    texts += [f"a{chr(c)}B {chr(c)} {chr(c)}x'LL" for c in range(1, 0x3000)]
    texts += ["a <|endoftext|> b", "x<|startoftext|>y", "e ́", "  ", "\n", prose(rng, 300)]
    for t in texts:
        assert T.text_ids(t, words, 2).tolist() == tok.encode(t, add_special_tokens=False).ids + [2], repr(t)
        assert T.text_ids(t, whole, 2).tolist() == T.text_ids(t, words, 2).tolist()


def test_files_of_awkward_rows(spark):
    docs = awkward()
    df = frame(spark, docs)
    # order of the ids, nulls first, ties by the hash of the text
    rows = [tuple(r) for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select("doc_id", "text").collect()]
    want = sorted(map(str, expected(rows)))
    for segment in (T.SEGMENT, 100):           # the second splits long documents
        segments = T.write(df, segment=segment)
        assert segments.where(F.col("n_ids") > segment).count() == 0
        assert sorted(str(tuple(r)) for r in shown(segments)) == want
    assert segments.where("exists(docs, d -> d.pieces > 1)").count() > 1


def test_empty_table_and_string_ids(spark):
    assert T.read(T.write(frame(spark, []))).count() == 0
    df = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, None)], "doc_id string, text string")
    assert [tuple(r)[:3] for r in sorted(shown(T.write(df)), key=lambda r: r["start"])] == [(None, 0, 1), ("a", 1, 2), ("b", 3, 3)]
