"""TF-IDF retrieval over a document table.

Weights: tf · (ln((1+N)/(1+df)) + 1), L2-normalised per document (the
smoothed idf of the common vectoriser default). Postings lie in impact
bands per term; a query reads only the bands that can lift a document over
a score that ``n`` documents are known to reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.core import r6  # noqa: F811

from tastemill.functions.core import top_n
from tastemill.session import materialize

# ---- fixed values --------------------------------------------------------
# word tokens of two or more letters, digits or underscores (Unicode-aware)
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
NO_CONTEXT = "No relevant context found."
# --------------------------------------------------------------------------

BANDS = 4           # impact bands per halving of the weight
SEEDS = 64          # best postings of a term that set a query's bar
SLACK = 2e-6        # of a score: results are ranked by six decimals
FEW = 4             # share of postings below which documents are looked up by band
SMALL = 200_000     # rows of (term, number) that may be broadcast
HELD = 1 << 23      # terms of several documents that tasks get as (hash, idf), 16 bytes each
ROWS = 2048         # documents of an Arrow batch
CELLS, QUERIES, AT_ONCE = 1 << 22, 256, 1 << 14     # of a block of query vectors: cells, queries; postings multiplied at once


def smooth_idf(n_docs: int, df: Column) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def tokenize(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term) per token occurrence, lower-cased, whole text."""
    return df.select(id_col, F.explode(F.regexp_extract_all(
        F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)).alias("term"))


def tfidf_weights(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Returns (weights(doc, term, weight), idf(term, idf)).

    Texts are dealt by document once; counts and norms of a document are then
    taken where it lies, so no row per (document, term) is shuffled. The idf
    table is written; up to ``SMALL`` terms it is sent to the documents,
    beyond that the rows meet it by term."""
    dealt = docs.select(id_col, "text").repartition(id_col)
    tf = tokenize(dealt, id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = docs.select(id_col).distinct().count()
    idf = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
                      .select("term", smooth_idf(n_docs, F.col("df")).alias("idf")), "idf")
    raw = tf.join(few(idf), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("raw") / norm).alias("weight")), idf


def few(table: DataFrame) -> DataFrame:
    """``table`` (written), broadcast if it has at most ``SMALL`` rows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def query_weights(queries: DataFrame, idf: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Query vectors with the corpus idf; unseen terms are ignored."""
    tf = tokenize(queries, id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("raw") / norm).alias("weight"))


def bands(postings: DataFrame) -> DataFrame:
    """Adds ``band``, the impact block of a posting: band 0 holds the weights
    in (2^-1/4, 1], every next one those lower by a factor of 2^-1/4."""
    return postings.withColumn("band", F.greatest(F.floor(-BANDS * F.log2("weight")), F.lit(0)).cast("int"))


def exact_scores(pairs: DataFrame, qw: DataFrame, postings: DataFrame, qid: str, did: str) -> DataFrame:
    """Whole dot products of the given (query, doc) pairs. Few pairs are sent
    to the documents, so that no other posting moves."""
    wanted = pairs.join(qw.select(qid, "term", F.col("weight").alias("qw")), qid)
    if pairs.count() <= SMALL:
        docs = postings.join(F.broadcast(pairs.select(did).distinct()), did, "left_semi")
        wanted = few(materialize(wanted, "wanted"))
    else:
        docs = postings
    return (wanted.join(single(docs, did), [did, "term"])
            .groupBy(qid, did).agg(F.sum(F.col("qw") * F.col("weight")).alias("score")))


def reading_plan(qw: DataFrame, stats: DataFrame, reached: DataFrame, qid: str) -> DataFrame:
    """(query, term, least): the postings of a term that a query has to read,
    those of at least the weight ``least``.

    ``reached`` (query, bar) is a score that ``n`` documents reach. A term
    adds at most its query weight times its greatest weight. The most common
    terms that together stay below the bar are not read at all; of the others,
    a document above the bar has one whose weight is at least the same
    share of its maximum as the rest of the bar is of their maxima."""
    t = qw.join(stats, "term").withColumn("most", F.col("weight") * F.col("top"))
    t = t.join(reached, qid, "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)) - SLACK)
    common_first = Window.partitionBy(qid).orderBy(F.col("df").desc(), "term")
    t = t.withColumn("upto", F.sum("most").over(common_first)).withColumn("read", F.col("upto") >= F.col("bar"))
    whole = Window.partitionBy(qid)
    left_out = F.sum(F.when(~F.col("read"), F.col("most")).otherwise(0.0)).over(whole)
    of_read = F.sum(F.when(F.col("read"), F.col("most")).otherwise(0.0)).over(whole)
    t = t.withColumn("share", F.greatest((F.col("bar") - left_out) / of_read, F.lit(0.0)))
    return t.where("read").select(qid, "term", (F.col("top") * F.col("share") * (1 - 1e-12)).alias("least"), "top", "low")


def bands_asked(plan: DataFrame, qid: str) -> DataFrame:
    """(query, term, band, least): the impact bands that hold what the plan reads."""
    first = F.greatest(F.floor(-BANDS * F.log2("top")) - 1, F.lit(0)).cast("int")
    last = F.floor(-BANDS * F.log2(F.greatest("least", "low"))).cast("int") + 1
    return plan.select(qid, "term", "least", F.explode(F.sequence(first, F.greatest(last, first))).alias("band"))


def candidates(plan: DataFrame, postings: DataFrame, qid: str, did: str) -> DataFrame:
    """(query, doc) of all postings that the plan reads: an equi-join on (term,
    impact band), so bands below a query's bound are not touched."""
    hit = bands_asked(plan, qid).join(postings, ["term", "band"]).where(F.col("weight") >= F.col("least"))
    return hit.select(qid, did).distinct()


def hashed(term: Column, seed: int) -> Column:
    return F.xxhash64(term, F.lit(seed))


def dealt(docs: DataFrame, did: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, terms) of the documents whose id is theirs alone, where they lie,
    and (id, term, tf) of those that share an id, gathered (None without any)."""
    words = docs.select(did, F.regexp_extract_all(F.lower(F.col("text")), F.lit(TOKEN_PATTERN), 0).alias("terms"))
    shared = materialize(docs.groupBy(F.col(did).alias("_id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_id"), "shared-ids")
    if shared.isEmpty():
        return words, None
    same = F.col(did).eqNullSafe(F.col("_id"))
    many = words.join(few(shared), same, "left_semi").select(did, F.explode("terms").alias("term"))
    return words.join(few(shared), same, "left_anti"), materialize(many.groupBy(did, "term").agg(F.count(F.lit(1)).alias("tf")), "shared-terms")


def weigh(hashes: np.ndarray, docs: np.ndarray, counts: np.ndarray, n: int, known: np.ndarray, idf: np.ndarray, once: float,
          asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's tokens (hash, document, count): document, place in ``asked``
    and weight of each posting of an asked term. A term that isn't ``known``
    is in one document and has the idf ``once``."""
    order = np.argsort(hashes, kind="stable")           # documents come in order, so a term's tokens of one lie together
    h, d = hashes[order], docs[order]
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
    h, d, tf = h[start], d[start], np.add.reduceat(counts[order], start) if len(start) else np.zeros(0)

    def find(among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(among, h)
        return at, (at < len(among)) & (among[np.minimum(at, len(among) - 1)] == h) if len(among) else np.zeros(len(h), dtype=bool)

    at, there = find(known)
    raw = np.full(len(h), once)
    raw[there] = idf[at[there]]
    raw *= tf
    norm = np.sqrt(np.bincount(d, weights=raw * raw, minlength=n))
    at, there = find(asked)
    mine = np.flatnonzero(there)
    mine = mine[np.argsort(d[mine], kind="stable")]
    return d[mine], at[mine], raw[mine] / norm[d[mine]]


def document_weights(docs: DataFrame, terms: DataFrame, did: str) -> tuple[DataFrame, DataFrame]:
    """(postings(doc, terms, weights), idf(term, idf)): a row a document with
    its terms that are among ``terms`` (written) and their weights.

    Texts stay where they lie. The terms of two or more documents go to the
    tasks as (hash, idf), all others have the idf of one document; hashes that
    clash are made anew by another seed. With over ``HELD`` terms of several
    documents the rows (document, term) meet them by shuffles."""
    spark = docs.sparkSession
    alone, many = dealt(docs, did)
    n_docs = docs.select(did).distinct().count()
    found = alone.select(F.explode(F.array_distinct("terms")).alias("term"))
    found = found if many is None else found.unionByName(many.select("term"))
    idf = materialize(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", smooth_idf(n_docs, F.col("df")).alias("idf")), "idf")
    several = idf.where("df > 1")
    if several.count() > HELD or terms.count() > HELD:
        weights, plain = tfidf_weights(docs, did)
        rows = weights.where(F.col(did).isNotNull()).join(few(terms), "term", "left_semi")
        both = F.collect_list(F.struct("term", "weight")).alias("t")
        return materialize(rows.groupBy(did).agg(both).select(did, F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "postings"), plain
    seed = 42
    while not idf.groupBy(hashed(F.col("term"), seed).alias("h")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        seed += 1
    known = several.select(hashed(F.col("term"), seed).alias("h"), "idf").toArrow()
    asked = terms.join(idf, "term", "left_semi").select(hashed(F.col("term"), seed).alias("h"), "term").toArrow()
    order, by = np.argsort(known["h"].to_numpy()), pc.sort_indices(asked["h"])
    held = spark.sparkContext.broadcast((known["h"].to_numpy()[order], known["idf"].to_numpy()[order], math.log((1 + n_docs) / 2) + 1,
                                         asked["h"].take(by).to_numpy(), asked["term"].take(by).combine_chunks()))
    bag = F.transform("terms", lambda t: hashed(t, seed)).alias("h")
    rows = alone.where(F.col(did).isNotNull()).select(did, bag, F.lit(None).cast("array<bigint>").alias("c"))
    if many is not None:
        gathered = many.where(F.col(did).isNotNull()).groupBy(did).agg(F.collect_list(F.struct(hashed(F.col("term"), seed).alias("h"), "tf")).alias("t"))
        rows = rows.unionByName(gathered.select(did, F.col("t.h").alias("h"), F.col("t.tf").alias("c")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, idfs, once, wanted, names = held.value
        for batch in batches:
            ids, h, c = batch.column(0), batch.column(1), batch.column(2)
            size = pc.fill_null(pc.list_value_length(h), 0).to_numpy(zero_copy_only=False)
            counted = c.is_valid().to_numpy(zero_copy_only=False)
            counts = np.ones(int(size.sum()))
            of = np.repeat(np.arange(len(ids)), size)
            if counted.any():
                counts[counted[of]] = c.flatten().to_numpy(zero_copy_only=False)
            d, at, w = weigh(h.flatten().to_numpy(zero_copy_only=False), of, counts, len(ids), hashes, idfs, once, wanted)
            some, first = np.unique(d, return_index=True)
            ends = pa.array(np.append(first, len(d)), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.ListArray.from_arrays(ends, names.take(pa.array(at))), pa.ListArray.from_arrays(ends, pa.array(w))],
                                             names=[did, "terms", "weights"])

    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(ROWS))            # a batch holds all tokens of its texts
    try:
        kind = rows.schema[did].dataType.simpleString()
        postings = materialize(rows.mapInArrow(run, f"{did} {kind}, terms array<string>, weights array<double>"), "postings")
    finally:
        spark.conf.set(batch, before)
    return postings, idf.select("term", "idf")


def single(postings: DataFrame, did: str) -> DataFrame:
    """(doc, term, weight), a row a posting."""
    return postings.select(did, F.explode(F.arrays_zip("terms", "weights")).alias("t")).select(did, F.col("t.terms").alias("term"), F.col("t.weights").alias("weight"))


def query_blocks(qw: pa.Table, qid: str) -> list[tuple]:
    """(query ids, terms, dense matrix terms × queries) of bounded size."""
    code = qw[qid].combine_chunks().dictionary_encode()
    of, ids = code.indices.to_numpy(), code.dictionary
    term, weight = qw["term"].combine_chunks(), qw["weight"].to_numpy()
    order = np.argsort(of, kind="stable")
    edge, out, lo = np.searchsorted(of[order], np.arange(len(ids) + 1)), [], 0
    while lo < len(ids):
        hi = lo + 1
        while hi < len(ids) and hi - lo < QUERIES and (hi + 1 - lo) * (edge[hi + 1] - edge[lo]) <= CELLS:
            hi += 1
        at = order[edge[lo]:edge[hi]]
        own = term.take(pa.array(at)).dictionary_encode()
        dense = np.zeros((len(own.dictionary), hi - lo))
        dense[own.indices.to_numpy(), of[at] - lo] = weight[at]
        out.append((ids[lo:hi], own.dictionary, dense))
        lo = hi
    return out


def best_where_they_lie(postings: DataFrame, blocks: list[tuple], n: int, qid: str, did: str, kind: str) -> DataFrame:
    """(query, doc, score) of the ``n`` best documents of each task, by the
    score's six digits, then the smaller id."""
    held = postings.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [None] * len(held.value)
        for batch in batches:
            ids, terms, weights = batch.column(0), batch.column(1), batch.column(2)
            word, weight = terms.flatten(), weights.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            for b, (queries, names, dense) in enumerate(held.value):
                at = pc.index_in(word, value_set=names)
                mine = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                code, doc = pc.drop_null(at).to_numpy(zero_copy_only=False), of[mine]
                lo = 0
                while lo < len(mine):
                    hi = min(lo + AT_ONCE, len(mine))           # whole documents
                    hi = len(mine) if hi == len(mine) else max(np.searchsorted(doc, doc[hi]), 0)
                    if hi <= lo:
                        hi = np.searchsorted(doc, doc[lo], side="right")
                    first = np.flatnonzero(np.concatenate([[True], doc[lo + 1:hi] != doc[lo:hi - 1]]))
                    score = np.add.reduceat(dense[code[lo:hi]] * weight[mine[lo:hi], None], first, axis=0)
                    shown = np.floor(score * 1e6 + 0.5)
                    floor = np.zeros(len(queries)) if best[b] is None else best[b][1]
                    r, q = np.nonzero((score > 0) & (shown >= floor))
                    if len(r):
                        got = pa.table({"q": q, "s": shown[r, q], "score": score[r, q], "id": ids.take(pa.array(doc[lo:hi][first][r]))})
                        best[b] = merged(got if best[b] is None else pa.concat_tables([best[b][0], got]), n, len(queries))
                    lo = hi
        for b, (queries, _, _) in enumerate(held.value):
            if best[b] is not None:
                t = best[b][0].combine_chunks()
                yield from pa.table({qid: queries.take(t["q"].combine_chunks()), did: t["id"], "score": t["score"]}).to_batches()

    return postings.mapInArrow(run, f"{qid} {kind}, {did} {postings.schema[did].dataType.simpleString()}, score double")


def merged(rows: pa.Table, n: int, queries: int) -> tuple[pa.Table, np.ndarray]:
    """The ``n`` best rows of each query, and each query's ``n``-th score or 0."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("s", "descending"), ("id", "ascending")]))
    q = rows["q"].to_numpy()
    place = np.arange(len(q)) - np.searchsorted(q, q)
    rows = rows.take(pa.array(np.flatnonzero(place < n)))
    floor, last = np.zeros(queries), place[place < n] == n - 1
    floor[rows["q"].to_numpy()[last]] = rows["s"].to_numpy()[last]
    return rows, floor


def retrieve_topn(queries: DataFrame, docs: DataFrame, n: int = 2,
                  qid: str = "query_id", did: str = "doc_id") -> DataFrame:
    """(query, doc, score, rank): cosine > 0, best ``n`` per query, ties by doc id.

    Exact without shuffling texts, (document, term) rows or (query, doc) pairs
    where that can be avoided: the postings of the query terms are written as
    one row a document. The best
    ``SEEDS`` postings of each query term give ``n`` documents whose whole
    scores set a bar, and ``reading_plan`` says which postings can lift a
    document over it. If those are at most ``SMALL`` and less than one in
    ``FEW`` of all that the queries could meet, only their documents are scored,
    by impact bands, and a term that is in every document is read only where it
    can decide. Otherwise the query vectors go to the documents and each task
    passes on its best ``n`` per query; over ``SMALL`` rows of query vectors
    work by band in any case. Nulls and texts without terms match nothing."""
    terms = materialize(tokenize(queries, qid).select("term").distinct(), "query-terms")
    rows, idf = document_weights(docs, terms, did)
    qw = materialize(query_weights(queries, materialize(idf.join(few(terms), "term", "left_semi"), "query-idf"), qid)
                     .where(F.col(qid).isNotNull()), "query-weights")
    postings = bands(single(rows, did))
    levels = materialize(postings.groupBy("term", "band").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("top"), F.min("weight").alias("low")), "term-bands")
    stats = levels.groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"), F.min("low").alias("low"))

    seeds = top_n(postings.select("term", did, "weight"), ["term"], [F.col("weight").desc(), F.col(did)], max(SEEDS, n))
    part = (qw.select(qid, "term", F.col("weight").alias("qw")).join(seeds, "term")
            .groupBy(qid, did).agg(F.sum(F.col("qw") * F.col("weight")).alias("part")))
    firm = materialize(top_n(part, [qid], [F.col("part").desc(), F.col(did)], 4 * n).select(qid, did), "firm")
    sure = top_n(exact_scores(firm, qw, rows, qid, did), [qid], [F.col("score").desc(), F.col(did)], n)
    reached = sure.where(F.col("rank") == n).select(qid, F.col("score").alias("bar"))
    plan = materialize(reading_plan(qw, stats, reached, qid), "reading-plan")

    reads = bands_asked(plan, qid).join(levels, ["term", "band"]).agg(F.sum("df")).first()[0] or 0
    meets = qw.join(stats, "term").agg(F.sum("df")).first()[0] or 0
    if qw.count() > SMALL or (reads <= SMALL and reads * FEW <= meets):
        dots = exact_scores(candidates(plan, postings, qid, did), qw, rows, qid, did)
    else:
        dots = best_where_they_lie(rows, query_blocks(qw.toArrow(), qid), n, qid, did, qw.schema[qid].dataType.simpleString())
    out = top_n(dots.where(F.col("score") > 0), [qid], [r6("score").desc(), F.col(did)], n)
    return materialize(out.select(qid, did, r6("score").alias("score"), F.col("rank").cast("int")), "hits")


def context_block(queries: DataFrame, hits: DataFrame, docs: DataFrame,
                  qid: str = "query_id", did: str = "doc_id") -> DataFrame:
    """'id:\\ntext' of the hits in rank order, joined by blank lines; a fixed
    message when a query has no hit. At most ``n`` hits per query, so the
    ordered collect is bounded. ``hits`` is a written table
    (``retrieve_topn``): while it is small, its size lets the join leave the
    texts where they lie."""
    h = hits.join(docs.select(did, "text"), did).select(
        qid, "rank", F.concat(F.col(did).cast("string"), F.lit(":\n"), F.col("text")).alias("block"))
    blocks = h.groupBy(qid).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "\n\n").alias("context"))
    return (queries.select(qid).join(blocks, qid, "left")
            .select(qid, F.coalesce("context", F.lit(NO_CONTEXT)).alias("context")))
