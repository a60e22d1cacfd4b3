"""Exact retrieval by impact bands against all dot products."""

import math
import random
import re
from collections import Counter

from tastemill.operators import retrieval as T


def brute(queries, docs, n):
    words = lambda t: [w for w in re.findall(r"\w{2,}", (t or "").lower())]
    df = {}
    for _, t in docs:
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(docs)) / (1 + c)) + 1 for w, c in df.items()}

    def vector(t):
        v = {}
        for w in words(t):
            if w in idf:
                v[w] = v.get(w, 0) + idf[w]
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors, out = {d: vector(t) for d, t in docs}, set()
    for q, t in queries:
        v = vector(t)
        scores = [(round(sum(x * vectors[d].get(w, 0.0) for w, x in v.items()), 6), d) for d, _ in docs]
        best = sorted((-s, d) for s, d in scores if s > 0)[:n]
        out |= {(q, d, i + 1, -s) for i, (s, d) in enumerate(best)}
    return out


def tables(spark, queries, docs):
    return spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def zipf(rng, n, words):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), words)}" for _ in range(n))


def check(spark, queries, docs, n):
    got = {(r.query_id, r.doc_id, r.rank, r.score) for r in T.retrieve_topn(*tables(spark, queries, docs), n).collect()}
    want = brute(queries, docs, n)
    assert {g[:3] for g in got} == {w[:3] for w in want}
    assert all(abs(s - {w[:3]: w[3] for w in want}[g]) < 2e-6 for *g_, s in got for g in [tuple(g_)])


def test_random_texts(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, "everywhere " + zipf(rng, rng.randrange(3, 40), 300)) for i in range(400)]
    queries = [(i, zipf(rng, rng.randrange(1, 9), 300) + rng.choice(["", " everywhere"])) for i in range(40)]
    check(spark, queries, docs, 2)
    monkeypatch.setattr(T, "SEEDS", 3)
    check(spark, queries, docs, 5)


def test_awkward_texts(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (4, "same words"), (5, "same words"), (6, "Same WORDS words"), (7, "other"), (8, "same " * 5000)]
    queries = [(1, None), (2, ""), (3, "unseen terms"), (4, "same words"), (5, "words words other"), (6, "other unseen")]
    check(spark, queries, docs, 3)
    assert T.retrieve_topn(*tables(spark, [], docs)).count() == 0
    assert T.retrieve_topn(*tables(spark, queries, []), 2).count() == 0


def test_a_term_of_every_document_is_not_paired_with_all(spark, monkeypatch):
    rng = random.Random(7)
    docs = [(i, "the the " + " ".join(f"w{rng.randrange(2000)}" for _ in range(30))) for i in range(3000)]
    queries = [(i, "the " + " ".join(docs[rng.randrange(3000)][1].split()[2:14])) for i in range(30)]
    q, d = tables(spark, queries, docs)
    seen, real = [], T.candidates
    monkeypatch.setattr(T, "candidates", lambda plan, *a: seen.append((plan, real(plan, *a))) or seen[-1][1])
    got = T.retrieve_topn(q, d, 2).collect()
    plan, pairs = seen[0]
    df = Counter(w for _, t in docs for w in set(t.split()))
    assert plan.where("term = 'the'").count() == 0 and df["the"] == 3000      # read by no query
    assert pairs.count() <= sum(df[w] for _, t in queries for w in set(t.split()) - {"the"})
    assert {(r.query_id, r.doc_id) for r in got if r["rank"] == 1} == {(a, b) for a, b, k, _ in brute(queries, docs, 2) if k == 1}


def test_documents_are_scored_where_they_lie(spark, monkeypatch):
    """Common terms: no join by band, no (document, term) rows sent around."""
    rng = random.Random(9)
    docs = [(i, zipf(rng, 25, 40)) for i in range(300)]
    queries = [(i, zipf(rng, 8, 40)) for i in range(20)]

    def never(*a):
        raise AssertionError("pairs looked up by band")

    monkeypatch.setattr(T, "candidates", never)
    check(spark, queries, docs, 2)
    _, d = tables(spark, queries, docs)
    w, _ = T.tfidf_weights(d, "doc_id")
    assert w.collect() and w._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc_id") <= 2
    monkeypatch.undo()
    monkeypatch.setattr(T, "SMALL", 0)
    check(spark, queries, docs, 2)


def test_texts_and_postings_stay_in_place(spark, monkeypatch):
    """Ids that several rows share or that are null, a vocabulary beyond what
    is broadcast by name, and terms too many to be held at all."""
    rng = random.Random(11)
    docs = [(i, zipf(rng, rng.randrange(1, 60), 900)) for i in range(300)]
    queries = [(i, zipf(rng, rng.randrange(1, 12), 900)) for i in range(30)]
    monkeypatch.setattr(T, "SMALL", 100)
    plans, real = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name="t": plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name))
    check(spark, queries, docs, 2)
    assert [p for name, p in plans if name == "postings"] and not any(w in p for name, p in plans if name == "postings" for w in ("Window", "Aggregate", "Join"))
    # one document dealt over rows is the document
    pieces = [(i, w) for i, t in docs for w in ([t] if i % 3 else t.split())] + [(None, "w1 w2 w3")]
    rng.shuffle(pieces)
    q, d = tables(spark, queries, pieces)
    whole = spark.createDataFrame([*docs, (None, "w1 w2 w3")], "doc_id long, text string")
    assert sorted(T.retrieve_topn(q, d, 2).collect()) == sorted(T.retrieve_topn(q, whole, 2).collect())
    monkeypatch.setattr(T, "HELD", 0)
    check(spark, queries, docs, 2)


def test_blocks_of_queries_and_ties(spark, monkeypatch):
    rng = random.Random(12)
    docs = [(i, zipf(rng, rng.randrange(1, 6), 8)) for i in range(500)]           # many equal scores
    queries = [(i, zipf(rng, 6, 8)) for i in range(40)]
    monkeypatch.setattr(T, "CELLS", 20)
    monkeypatch.setattr(T, "AT_ONCE", 7)
    monkeypatch.setattr(T, "ROWS", 16)
    monkeypatch.setattr(T, "FEW", 10**9)                # never by band
    check(spark, queries, docs, 3)
    names = [(f"d{i:03d}", t) for i, t in docs]
    got = T.retrieve_topn(spark.createDataFrame([(f"q{i}", t) for i, t in queries], "query_id string, text string"),
                          spark.createDataFrame(names, "doc_id string, text string").repartition(3), 3).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == {(f"q{a}", f"d{b:03d}", k) for a, b, k, _ in brute(queries, docs, 3)}
