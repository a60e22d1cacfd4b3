"""Language ID, quality, decontamination and PII on small frames."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tastemill.llm import decontaminate, lang_id, pii, quality
from tastemill.llm.textbuf import NOT_ALNUM, WHITESPACE, flat, gram_counts, hash_spans, shingles, spans
from tests.llm.util import awkward, frame, prose

SYLLABLES = {"aa": ["ba", "da", "ga"], "ee": ["ke", "te", "pe"], "oo": ["mo", "no", "lo"], "uu": ["ru", "su", "vu"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


# -- the shared text helper -----------------------------------------------------

def test_spans_and_hashes_follow_the_bytes():
    texts = ["Ab c  ab", None, "", "é É x\ty", "a-b_c9", " "]
    data, off = flat(pa.array(texts))
    for sep, rule in ((WHITESPACE, rb"[^\x20\x09-\x0D]+"), (NOT_ALNUM, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        starts, ends, per = spans(data, off, sep)
        found = [bytes(data[s:e]) for s, e in zip(starts, ends)]
        want = [re.findall(rule, (t or "").encode()) for t in texts]
        assert found == [w for ws in want for w in ws] and list(np.diff(per)) == [len(w) for w in want]
        keys = hash_spans(data, starts, ends)
        low = [w.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for w in found]
        assert len({(k, w) for k, w in zip(keys.tolist(), low)}) == len(set(low)) == len(set(keys.tolist()))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    from tastemill.llm import textbuf
    texts = pa.array([prose(random.Random(i), 50) for i in range(9)])
    data, off = flat(texts)
    starts, ends, per = spans(data, off, WHITESPACE)
    one, grams = hash_spans(data, starts, ends), gram_counts(data, off, (2, 3), 8)
    monkeypatch.setattr(textbuf, "BLOCK", 16)
    assert (hash_spans(data, starts, ends) == one).all()
    monkeypatch.setattr(textbuf.segments, "__defaults__", (16,))
    assert (gram_counts(data, off, (2, 3), 8) == grams).all()
    assert [len(s) for s in shingles(one, per, 60)] == [1] * 9


# -- language ID ------------------------------------------------------------------

@pytest.mark.parametrize("langs", [["aa"], ["aa", "ee"], ["aa", "ee", "oo", "uu"]])
def test_language_held_out(spark, langs):
    rng = random.Random(1)
    train = [(i, speech(rng, langs[i % len(langs)], 30), langs[i % len(langs)]) for i in range(80)]
    rows = [(i, speech(rng, langs[i % len(langs)], 25), langs[i % len(langs)]) for i in range(40)]
    model = lang_id.fit(spark.createDataFrame(train + [(99, None, "aa"), (98, "ba", None)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame(rows + [(100, None, "x"), (101, "", "x"), (102, "12 -- 3", "x")], "doc_id long, text string, guess string")
    got = {r["doc_id"]: r["guess"] for r in lang_id.identify(docs, model).collect()}
    assert sum(got[i]["lang"] == l for i, _, l in rows) >= 39
    assert all(0 <= g["score"] <= 1 for g in got.values())
    assert all(got[i]["lang"] == "und" and got[i]["score"] == 0 and got[i]["ambiguous"] for i in (100, 101, 102))


def test_language_without_labels_and_mixed(spark):
    empty = lang_id.fit(spark.createDataFrame([], "text string, lang string"))
    docs = spark.createDataFrame([(1, "ba da")], "doc_id long, text string")
    assert lang_id.identify(docs, empty).first()["guess"]["lang"] == "und"
    assert lang_id.identify(docs.limit(0), empty).count() == 0


@pytest.mark.parametrize("n", [2, 4, 7, 12, 40])
def test_codewords_are_far_apart(n):
    code = lang_id.codewords(n)
    gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert gap >= (code.shape[1] // 4 if n > 7 else 2 ** (n - 2))


def test_decoding_corrects_a_bit():
    code = lang_id.codewords(5)
    margins = 4.0 * code.copy()
    margins[:, 0] *= -1
    assert list(lang_id.decode(margins, code).argmax(axis=1)) == [0, 1, 2, 3, 4]


# -- quality ------------------------------------------------------------------------

def test_quality_held_out(spark):
    rng = random.Random(2)
    good = lambda: prose(rng, rng.randrange(20, 80))
    bad = lambda: " ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, 30).split()) if rng.random() < 0.5 else " ".join([rng.choice(["spam", "of"])] * 40)
    train = [(good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(240)] + [(None, 1), ("x", None)]
    model = quality.fit(spark.createDataFrame(train, "text string, label int"))
    rows = [(i, good() if i % 3 else bad()) for i in range(60)] + [(100, None), (101, "")]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string"), model).collect()}
    assert sum((got[i] >= quality.THRESHOLD) == (i % 3 > 0) for i in range(60)) >= 57
    assert 0 <= got[100] == got[101] < 0.5


@pytest.mark.parametrize("rows,want", [([], 0.5), ([("a b", 1)], 1.0), ([("a b", 0)], 0.0)])
def test_quality_of_one_label(spark, rows, want):
    model = quality.fit(spark.createDataFrame(rows, "text string, label int"))
    got = quality.score(spark.createDataFrame([("a c",)], "text string"), model).first()["score"]
    assert abs(got - want) < 1e-6


# -- decontamination -----------------------------------------------------------------

def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items, window=10):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        x = words(t)
        for s in range(max(1, len(x) - window + 1) if x else 0):
            g = x[s:s + window]
            for p in range(len(w) - len(g) + 1):
                if w[p:p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    if i is not None:
                        ids.add(str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("part_bytes", [100, 2_000_000])
def test_decontamination(spark, part_bytes):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 12, 10, 4, 1])] + [(7, None), (8, ""), (9, "-- !"), (None, prose(rng, 14)), (20, "Über ÉTÉ naïve")]
    items += [(11, items[0][1]), (11, items[0][1])]
    rows = awkward() + [(50, prose(rng, 30) + " " + items[0][1].upper()[20:150] + " " + prose(rng, 5)), (51, items[1][1]), (52, "x " + items[8][1]),
                        (53, "an Über, ÉTÉ (naïve) one"), (54, items[3][1] + "\n" + items[0][1]), (51, items[1][1])]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, part_bytes=part_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        h = r["hits"]
        assert (h["n_words"], h["n_hit"], list(h["item_ids"])) == brute_hits(r["text"], items)
        found = [w for s in h["spans"] for w in words(r["text"][s["start"]:s["end"]])]
        assert len(found) == h["n_hit"]
    one = decontaminate.digest(decontaminate.contamination(docs, bench)).where("doc_id = 50").first()
    ids = brute_hits(dict(rows)[50], items)[2]
    assert {"0", "11"} <= set(ids) and one["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest() and one["contaminated"]
    none = decontaminate.digest(decontaminate.contamination(docs, bench.limit(0)))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# -- PII ---------------------------------------------------------------------------------

KEY = b"test"


def test_feistel_is_a_permutation():
    for radix in ([10, 10, 10], [3, 26, 10], [256, 7], [10]):
        total = int(np.prod(radix))
        seen = set()
        for x in range(total):
            values = []
            for r in reversed(radix):
                x, d = divmod(x, r)
                values.append(d)
            seen.add(tuple(pii.feistel(values[::-1], radix, KEY, "t")))
        assert len(seen) == total


def luhn_ok(d):
    return pii.luhn_digit(d[:-1]) == d[-1]


def test_formats_are_kept():
    text = ("mail ann.b9@mail7.example.com or ANN@x.org, +1 (017) 555-7713, 4845168114407329 and 4845 1681 1440 7329, "
            "97.51.17.173 999.1.1.1 1999-12-31 31.12.1999 30/02/2001 123-45-6789 000-45-6789 GB82 WEST 1234 5698 7654 32\n"
            'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" order 9807915762804490 v2.0.1 12345')
    got = pii.pseudonymise(text, KEY)
    kinds = [s["kind"] for s in got["spans"]]
    assert kinds == ["email", "email", "phone", "card", "card", "ipv4", "date", "date", "ssn", "iban", "hex"]
    for s in got["spans"]:
        assert text[s["start"]:s["end"]] not in got["text"]
    assert len(got["text"].split("\n")) == 2 and "999.1.1.1" in got["text"] and "30/02/2001" in got["text"] and "9807915762804490" in got["text"]
    again = pii.pseudonymise(got["text"], KEY)["spans"]
    assert [s["kind"] for s in again] == kinds            # every pseudonym is valid in its format
    one, two = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", got["text"])[:2]
    assert one == two.replace(" ", "") and luhn_ok(one)   # equal values stay linked
    assert pii.pseudonymise(text, b"other")["text"] != got["text"]


def test_pii_frame(spark):
    rows = [(1, "call 4845168114407329"), (2, "x 4845168114407329 y"), (3, None), (4, ""), (5, "plain words"), (1, "call 4845168114407329")]
    got = pii.pseudonymise_column(frame(spark, rows), KEY).collect()
    texts = {r["doc_id"]: r["private"]["text"] for r in got}
    assert len(got) == 6 and texts[1].split()[1] == texts[2].split()[1] != "4845168114407329"
    assert texts[3] is None and texts[4] == "" and texts[5] == "plain words"
    long = ("word " * 50_000) + "ann.b9@mail7.example.com"
    assert "ann.b9" not in pii.pseudonymise(long, KEY)["text"]
    assert pii.pseudonymise_column(frame(spark, []), KEY).count() == 0


def test_folds(spark):
    got = spark.createDataFrame([(i,) for i in [0, 5, 17, 10 ** 12]] + [(None,)], "doc_id long").select("doc_id", lang_id.fold("doc_id", 3).alias("f")).collect()
    for r in got:
        assert r["f"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3
