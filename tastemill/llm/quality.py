"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and byte
n-grams; a softmax over that average gives the label's probability. The
vectors and the output layer are trained together by mini-batch stochastic
gradient descent in numpy. Since the output is linear in the average, a
trained model is applied as one number per bucket, averaged per document.

Fitting takes a bounded sample of labelled rows: at most ``SAMPLE_ROWS``,
half per label, by a hash of the text, whole texts each; the priors of the
two labels are put back into the bias. Scores never see labels, lang, source
or ids.

Edge cases: a null or empty text has no features and gets the bias alone,
pulled to label 0 (score below 0.5); with one label or none learned every
score is that label's 0/1 or 0.5. Repeated rows are scored one by one;
several labels of one document count as so many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from tastemill.llm.lang_id import fold
from tastemill.llm.textbuf import (WHITESPACE, flat, gram_buckets, hash_spans, segments, spans, spread, table,
                                   text_batches)

SAMPLE_ROWS = 2000
BITS = 11
SIZES = (1, 3, 4)
DIM = 16
THRESHOLD = 0.7
REPEAT = (len(SIZES) + 1) << BITS      # a word equal to the one before it
REPEAT_WEIGHT = 16                     # about the number of n-grams that a word has
BUCKETS = REPEAT + 1                   # words and each n-gram size have their own range


def each_feature(col):
    """Yields (bucket, text) arrays of all features of a column, in bounded
    pieces; also the number of texts."""
    data, off = flat(col)
    starts, ends, per = spans(data, off, WHITESPACE)
    words, own = hash_spans(data, starts, ends), np.repeat(np.arange(len(per) - 1), np.diff(per))
    yield (words >> np.uint64(64 - BITS)).astype(np.int64), own
    again = np.flatnonzero((words[1:] == words[:-1]) & (own[1:] == own[:-1])) + 1
    yield np.full(len(again) * REPEAT_WEIGHT, REPEAT), np.repeat(own[again], REPEAT_WEIGHT)
    for lo, hi, doc in segments(off):
        for i, n in enumerate(SIZES):
            bucket, own = gram_buckets(data, off, n, BITS, lo, hi, doc)
            yield bucket + ((i + 1) << BITS), own


def averages(col, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of ``table_`` over each text's features, and their number."""
    total, count = np.zeros(len(col)), np.zeros(len(col))
    for bucket, own in each_feature(col):
        if len(bucket):
            total += np.bincount(own, weights=table_[bucket], minlength=len(col))
            count += np.bincount(own, minlength=len(col))
    return total / np.maximum(count, 1), count


def counts(col) -> list[dict]:
    """Sparse feature counts of every text (sample rows only)."""
    rows = np.zeros((len(col), BUCKETS), dtype=np.float32)
    for bucket, own in each_feature(col):
        np.add.at(rows, (own, bucket), 1)
    out = []
    for row in rows:
        at = np.flatnonzero(row)
        out.append({"bucket": at.astype(np.uint16).tobytes(), "weight": row[at].tobytes()})
    return out


def train(x: np.ndarray, y: np.ndarray, dim: int = DIM, epochs: int = 30, batch: int = 32, rate: float = 1.0, seed: int = 3):
    """Vectors, output layer and bias by mini-batch SGD on the softmax loss.
    ``x``: rows of feature shares (summing to 1), ``y``: 0/1."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / dim, 1 / dim, (x.shape[1], dim)).astype(np.float32)
    # frequent buckets carry large shares, so shares are put on one scale
    square = np.einsum("ij,ij->j", x, x) / len(x)
    scale = (1 / np.sqrt(np.sqrt(square) + 1e-4)).astype(np.float32)
    scale /= np.sqrt((square * scale * scale).sum())
    out, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    out[:, 1] = rng.uniform(-0.1, 0.1, dim)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i:i + batch]
            xb = x[rows] * scale
            hidden = xb @ vec
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = (p / len(rows)).astype(np.float32)
            grad_vec = xb.T @ (g @ out.T)
            out -= step * (hidden.T @ g)
            bias -= 0.1 * step * g.sum(axis=0)
            vec -= step * grad_vec
    lift = (vec @ (out[:, 1] - out[:, 0])) * scale
    return lift.astype(np.float64), float(bias[1] - bias[0])


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Model from a frame with ``text`` and ``label`` (0/1); nulls left out."""
    text_batches(labelled.sparkSession, 64)
    w = Window.partitionBy("label").orderBy(F.xxhash64("text"), "text")
    chosen = (labelled.select("text", F.col("label").cast("int").alias("label"))
              .where(F.col("text").isNotNull() & F.col("label").isin(0, 1)))
    prior = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    chosen = chosen.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= rows // 2)

    @arrow_udf("struct<bucket:binary,weight:binary>")
    def sparse(texts: pa.Array) -> pa.Array:
        return pa.array(counts(texts), type=pa.struct([("bucket", pa.binary()), ("weight", pa.binary())]))

    got = chosen.select("label", sparse(F.col("text")).alias("x")).collect()
    got.sort(key=lambda r: (r["label"], bytes(r["x"]["bucket"]), bytes(r["x"]["weight"])))
    if len(prior) < 2:
        only = next(iter(prior), None)
        return {"lift": np.zeros(BUCKETS), "bias": 0.0 if only is None else 20.0 * (2 * only - 1), "empty": 0.0 if only is None else 20.0 * (2 * only - 1)}
    x, y = np.zeros((len(got), BUCKETS), dtype=np.float32), np.array([r["label"] for r in got])
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["x"]["bucket"], dtype=np.uint16)] = np.frombuffer(r["x"]["weight"], dtype=np.float32)
        x[i] /= max(1.0, x[i].sum())
    lift, bias = train(x, y)
    taken = np.bincount(y, minlength=2)
    bias += float(np.log(prior[1] / taken[1]) - np.log(prior[0] / taken[0]))
    return {"lift": lift, "bias": bias, "empty": min(bias, -0.1)}


def score_texts(col, model: dict) -> np.ndarray:
    mean, n = averages(col, model["lift"])
    z = np.where(n > 0, mean + model["bias"], model["empty"])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``out`` (replaced if it
    exists already)."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)   # one number per bucket: fixed size

    @arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            yield pa.array(score_texts(col, held.value), type=pa.float64())

    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    labels = labels.where((fold("doc_id", 4) != 2) & F.col("label").isNotNull())
    # the ids of the sample are chosen from the narrow label table first, so
    # only their texts meet it
    w = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    near = labels.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= SAMPLE_ROWS)
    model = fit(docs.join(F.broadcast(near.select("doc_id", "label")), "doc_id"))
    prior = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    seen = {r["label"]: r["count"] for r in near.groupBy("label").count().collect()}
    if len(prior) == 2:   # the sample was even; the table's own shares go back in
        shift = float(np.log(prior[1] / seen[1]) - np.log(prior[0] / seen[0]))
        model |= {"bias": model["bias"] + shift, "empty": min(model["bias"] + shift, -0.1)}
    done = score(spread(docs), model)
    return done.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
