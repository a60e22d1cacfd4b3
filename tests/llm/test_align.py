"""Alignment against a plain pair-by-pair version on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tastemill.llm import align as L
from tests.llm.util import awkward, frame, prose

ODD = ["a <|endoftext|> b", "x▁y", "  two  spaces ", "line\nnext line\n\n  indented\tand", "naïve café ß", "中文 と 日本語", "\U0001f600 smile", " ", "\n", "nul\x00here",
       "don't can't  we'll", "a" * 300, "1234567890 12 3", "tail ", "x  y\xa0z w", "\x1c a \x85 b"]


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(L.A_PATH)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=L.B_PATH)


def brute(rows):
    """By definition: whole texts, all occurrence pairs of every group."""
    a, b = libraries()
    of_a, of_b = L.a_bytes(a), L.b_bytes(b)
    docs, count = [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(of_a[x] for x in ids_a) != whole or b"".join(of_b[x] for x in ids_b) != whole:
            docs.append((i, [], [], []))
            continue
        ends = lambda ids, of: [sum(len(of[x]) for x in ids[:k + 1]) for k in range(len(ids))] if len(ids) < 50 else list(__import__("itertools").accumulate(len(of[x]) for x in ids))
        ea, eb = ends(ids_a, of_a), ends(ids_b, of_b)
        cuts = sorted(set(ea) & set(eb))
        ga, gb = defaultdict(list), defaultdict(list)
        import bisect
        for x, e in zip(ids_a, ea):
            ga[bisect.bisect_left(cuts, e)].append(x)
        for x, e in zip(ids_b, eb):
            gb[bisect.bisect_left(cuts, e)].append(x)
        groups = [(ga[k], gb[k]) for k in range(len(cuts))]
        pairs = [(x, y) for g, h in groups for x in g for y in h]
        count.update(set(pairs))
        docs.append((i, ids_a, ids_b, groups))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, ids_a, ids_b, groups in docs:
        pairs = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(map(str, out))


def rows_of():
    rng = random.Random(3)
    alphabet = "ab c  \n\t\x1c\xa0é中.,'s1Ⅷ　́\U0001f600<"
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return awkward() + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, t) for i, t in enumerate(noise)] + [(400, prose(rng, 400)), (401, "word " * 500)]


def test_identity_map_holds_equal_bytes():
    a, b = libraries()
    of_a, of_b = L.a_bytes(a), L.b_bytes(b)
    same = L.identity_map(of_a, of_b)
    assert (same >= 0).sum() > 10_000
    assert all(of_a[i] == of_b[j] for i, j in enumerate(same) if j >= 0)
    assert {of_a[i] for i, j in enumerate(same) if j < 0}.isdisjoint(set(of_b))


@pytest.mark.parametrize("hot", [L.HOT, 3])
def test_against_brute_force(spark, hot):
    rows = rows_of()
    found = L.links(frame(spark, rows, 4))
    done = L.with_counts(found, hot=hot)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in done.select(*cols).collect()) == brute(rows)
    if hot == 3:        # nearly all pairs take the shuffle
        assert found.select(F.explode("odd").alias("p")).groupBy("p").count().count() > 100


def test_empty_table(spark):
    assert L.with_counts(L.links(frame(spark, []))).count() == 0
