"""Language identification with error-correcting output codes.

Every learned language has a codeword of +1/-1 bits; one logistic classifier
over hashed byte n-grams predicts each bit. A text's language is the codeword
with the smallest summed logistic loss (loss-weighted decoding). The score is
the softmax of the negative losses; a small gap to the runner-up marks the
text as ambiguous. Prediction reads the text only.

Fitting takes a bounded sample of distinct labelled texts: ``SAMPLE_ROWS``
at most, dealt evenly over the languages by a hash of the text, whole texts
each. However often a text is repeated, it counts once.
Their n-gram counts are made on the executors and gathered as sparse rows.
Every label is learned; of more labels than sample rows each has one text.

Edge cases: a null text, or one without any letter, is ``und`` with score 0;
without any labelled row everything is ``und``; with one language all texts
with letters get it with score 1. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from tastemill.llm.textbuf import LOWER, flat, gram_counts, spread, table, text_batches
from tastemill.session import discard, materialize

SAMPLE_ROWS = 2000
BITS = 12
SIZES = (2, 3)
AMBIGUOUS_GAP = 0.1
GUESS = "struct<lang:string,score:double,runner_up:string,gap:double,ambiguous:boolean>"
GUESS_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("runner_up", pa.string()),
                         ("gap", pa.float64()), ("ambiguous", pa.bool_())])


def _letters_table() -> np.ndarray:
    """Bytes for the n-grams: lower case, ASCII non-letters as spaces."""
    t = LOWER.copy()
    for i in range(128):
        if not chr(i).isalpha():
            t[i] = 0x20
    return t


LETTERS = _letters_table()


def features(col) -> np.ndarray:
    """Unit-length square-root n-gram counts, one row per text."""
    data, off = flat(col)
    x = np.sqrt(gram_counts(LETTERS[data], off, SIZES, BITS))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Languages x bits of +1/-1. Up to seven languages: the exhaustive
    code; more: the best of 200 random dense codes by minimum distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        cols = [[1] + [1 if b >> i & 1 else -1 for i in range(n - 1)] for b in range(2 ** (n - 1) - 1)]
        return np.array(cols, dtype=float).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], size=(n, bits))
        if (np.abs(m.sum(axis=0)) == n).any():
            continue
        near = int(((bits - m @ m.T) / 2 + bits * np.eye(n)).min())
        if near > far:
            best, far = m, near
    return best


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 150, rate: float = 0.1, l2: float = 1e-5):
    """One logistic classifier per bit, by full-batch Adam."""
    target = code[y]
    w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) / len(x)
        gw = (x.T @ g).astype(np.float32) + l2 * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        b -= 0.5 * g.sum(axis=0).astype(np.float32)
    return w, b


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Softmax of the negative summed logistic losses, texts x languages."""
    loss = np.zeros((len(margins), len(code)))
    for c, word in enumerate(code):
        loss[:, c] = np.logaddexp(0, -margins * word).sum(axis=1)
    e = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return e / e.sum(axis=1, keepdims=True)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], DataFrame]:
    """The languages to learn and an even, hash-ordered sample of their
    distinct texts; every language has at least one."""
    key = F.xxhash64("text").alias("k")
    keys = materialize(labelled.select("lang", key).groupBy("lang", "k").agg(F.count(F.lit(1)).alias("c")), "keys")
    top = materialize(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.min("k").alias("least")), "languages")
    langs = sorted(r["lang"] for r in top.select("lang").collect())
    each = max(1, rows // max(1, len(langs)))
    if not langs:
        return [], labelled.limit(0)
    # a hash threshold thins the keys of each language to a few times its
    # share, so the exact cut below moves a bounded number of keys at any size
    share = F.least(F.lit(1.0), F.lit(4.0 * each + 64) / F.col("texts"))
    keys_of = keys.join(F.broadcast(top.select("lang", share.alias("share"), "least")), "lang")      # one row per language
    place = F.col("k").bitwiseAND((1 << 40) - 1) / F.lit(float(1 << 40))
    w = Window.partitionBy("lang").orderBy("k")
    thin = keys_of.where((place < F.col("share")) | (F.col("k") == F.col("least"))).withColumn("_at", F.row_number().over(w))
    chosen = materialize(thin.where(F.col("_at") <= each).select("lang", "k"), "chosen")      # at most ``rows`` or one per language
    discard(keys, top)
    # copies of a text meet in a partial aggregate, one per task travels
    return langs, (labelled.select("text", "lang", key).join(F.broadcast(chosen), ["lang", "k"])
                   .groupBy("lang", "k").agg(F.min("text").alias("text")).select("text", "lang"))


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Model from a frame with ``text`` and ``lang``; null rows are left out."""
    text_batches(labelled.sparkSession)
    labelled = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    langs, chosen = sample(labelled, rows)

    @arrow_udf("struct<bucket:binary,weight:binary>")
    def sparse(texts: pa.Array) -> pa.Array:
        out = []
        for row in features(texts):
            at = np.flatnonzero(row)
            out.append({"bucket": at.astype(np.uint16).tobytes(), "weight": row[at].astype(np.float32).tobytes()})
        return pa.array(out, type=pa.struct([("bucket", pa.binary()), ("weight", pa.binary())]))

    got = chosen.select("lang", sparse(F.col("text")).alias("x")).collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"]["bucket"]), bytes(r["x"]["weight"])))
    code = codewords(len(langs))
    if not got:
        return {"langs": [], "code": code, "w": None, "b": None}
    x = np.zeros((len(got), 1 << BITS), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["x"]["bucket"], dtype=np.uint16)] = np.frombuffer(r["x"]["weight"], dtype=np.float32)
    y = np.array([langs.index(r["lang"]) for r in got])
    w, b = fit_bits(x, y, code)
    return {"langs": langs, "code": code, "w": w, "b": b}


def guess(col, model: dict, gap: float = AMBIGUOUS_GAP) -> list[dict]:
    """One answer per text of an Arrow column."""
    lettered = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_pylist()
    langs = model["langs"]
    if not langs:
        return [{"lang": "und", "score": 0.0, "runner_up": None, "gap": 0.0, "ambiguous": True} for _ in lettered]
    prob = decode(features(col) @ model["w"] + model["b"], model["code"])
    order = np.argsort(-prob, axis=1, kind="stable")
    out = []
    for i, ok in enumerate(lettered):
        if not ok:
            out.append({"lang": "und", "score": 0.0, "runner_up": None, "gap": 0.0, "ambiguous": True})
            continue
        first = order[i, 0]
        second = order[i, 1] if len(langs) > 1 else None
        d = float(prob[i, first] - (prob[i, second] if second is not None else 0.0))
        out.append({"lang": langs[first], "score": min(1.0, float(prob[i, first])),
                    "runner_up": None if second is None else langs[second], "gap": d, "ambiguous": d < gap})
    return out


def identify(docs: DataFrame, model: dict, text_col: str = "text", out: str = "guess", gap: float = AMBIGUOUS_GAP) -> DataFrame:
    """``docs`` with a struct column ``out`` (lang, score, runner_up, gap,
    ambiguous); a column already named ``out`` is replaced."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)   # buckets x bits: fixed size

    @arrow_udf(GUESS)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            yield pa.array(guess(col, held.value, gap), type=GUESS_ARROW)

    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col)))


def fold(col: str, parts: int):
    """crc32 of the id's text modulo ``parts``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    model = fit(docs.where(~F.col("held_out")))
    done = identify(spread(docs.select("doc_id", "held_out", "text")), model)
    return done.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"),
                       F.col("guess.runner_up").alias("runner_up"), F.col("guess.ambiguous").alias("ambiguous"))
