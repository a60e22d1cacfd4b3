"""Encoding against the sentencepiece library, for BPE and unigram scores."""

import pytest

sp = pytest.importorskip("sentencepiece")

from tastemill.llm import sentencepiece_scan as S  # noqa: E402

ODD = ["", "x", " ", "  a  b\n\n c", "日本語テキスト🙂 mixed\ttab\r\n", "a" * 500, "==" * 300, " " * 37 + "x", "    " * 50,
       "IllegalArgumentExceptionaaaa1234567890" * 20, "\x00\x01", "if (x == 1) {\n        return   foo;\n    }\n" * 5,
       "The theatre of operations, über naïve façade." * 40]


def unigram_path(tmp_path):
    """The same pieces read as a unigram model (scores bounded so that single
    precision keeps them apart)."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    p = pb.ModelProto()
    p.ParseFromString(open(S.MODEL_PATH, "rb").read())
    p.trainer_spec.model_type = 1
    for q in p.pieces:
        q.score = max(q.score, -40000.0)
    path = tmp_path / "unigram.model"
    path.write_bytes(p.SerializeToString())
    return str(path)


@pytest.fixture(params=["bpe", "unigram"])
def model(request, tmp_path):
    return S.MODEL_PATH if request.param == "bpe" else unigram_path(tmp_path)


def test_words_equal_the_library(model):
    lib, t = sp.SentencePieceProcessor(model_file=model), S.load_model(model)
    for d in ODD:
        assert S.encode_text(d, t) == lib.encode(d)
        assert S.decode_ids(lib.encode(d), t) == lib.decode(lib.encode(d)) == d


@pytest.mark.parametrize("size", [32, 47, 100])
def test_chunk_matrices_give_the_same_ids(model, size):
    lib, t = sp.SentencePieceProcessor(model_file=model), S.load_model(model)
    at = S.lattice(t)
    for d in ODD[1:]:
        text, k = S.prepared(d, t), at.longest
        parts = [(text[max(0, i - k):i], text[i:i + size], text[i + size:i + size + k]) for i in range(0, len(text), size)]
        ms = [at.matrix(*p) for p in parts]
        best = S.walk(ms, sorted(ms[0]), S.last_states(ms[-1]))
        got = [i for p, a, b in zip(parts, best, best[1:]) for i in at.trace(*p, a, b)]
        if t["bpe"]:
            assert got == lib.encode(d)
        else:                       # ties between equally weighted paths may fall either way
            weight = lambda ids: sum(lib.get_score(i) for i in ids)
            assert lib.decode(got) == d and weight(got) == weight(lib.encode(d))


def test_compose_is_associative():
    t = S.load_model(S.MODEL_PATH)
    at, text = S.lattice(t), "=" * 120
    parts = [(text[max(0, i - 16):i], text[i:i + 32], text[i + 32:i + 48]) for i in range(0, 120, 32)]
    a, b, c, d = [at.matrix(*p) for p in parts]
    assert S.compose(S.compose(S.compose(a, b), c), d) == S.compose(a, S.compose(b, S.compose(c, d)))


def test_frame_with_giant_texts(spark):
    lib = sp.SentencePieceProcessor(model_file=S.MODEL_PATH)
    texts = [*ODD, None, "=" * 9000, ("over the unspaced" * 500), ODD[-1], ODD[-1]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in S.decode(S.encode(docs, chunk=64)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == lib.encode(t or "")
        assert got[i]["decoded"] == (t or "")
    assert S.encode(docs.limit(0)).count() == 0


def test_giant_texts_of_one_file_keep_their_ids(spark, tmp_path):
    """One file with one split, so that ``spread`` deals the rows anew."""
    import random

    import corpus_pipeline
    from tastemill.llm.textbuf import spread
    from tests.llm.util import prose

    lib, rng = sp.SentencePieceProcessor(model_file=S.MODEL_PATH), random.Random(8)
    rows = [(i, prose(rng, 12_000 if i % 3 == 0 else 20), "en", "s", 1, "u", "row") for i in range(48)]
    assert sum(len(r[1]) > S.CHUNK for r in rows) == 16
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid string, row string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = {r[0]: lib.encode(r[1]) for r in rows}
    got = S.encode(spread(docs)).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == want and {r["uid"] for r in got} == {"u"} and {r["row"] for r in got} == {"row"}
    done = corpus_pipeline.tokens(spark, docs, "").collect()
    assert {r["doc_id"]: list(r["ids"]) for r in done} == want and all(r["round_trip"] for r in done)
