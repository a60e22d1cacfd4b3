"""URL filters: host rules, and logistic regression on hashed character
n-grams of host and path for the urls that no rule decides.

Everything runs as DataFrame functions. The training table is small and
labelled: by default at most ``TRAIN_ROWS`` urls per label, by hash order,
of those that the rules decide. Gradients are DataFrame sums over that
table, one number per bucket; the driver holds the ``BUCKETS`` weights only.

Edge cases: a null url, or one without ``://``, has an empty host and path,
no rule and the verdict of the bias alone; no labelled url at all allows
everything; one label alone is everybody's verdict. Very long urls are
hashed whole (characters are split once, so the work is linear).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tastemill.llm.textbuf import table
from tastemill.session import materialize

# fixed values: the rules (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
TRAIN_ROWS = 1000
BUCKETS = 2048
SIZES = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path of a url; empty without ``://``."""
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):   # later ones override
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def ngram_buckets(host: Column, path: Column, sizes=SIZES, buckets: int = BUCKETS) -> Column:
    """Distinct hash buckets of the character n-grams of ``^host|path$``."""
    chars = F.split(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), "")
    parts = []
    for n in sizes:
        # pairing the array with shifted copies of itself gives its n-grams in order
        shifted = [F.slice(chars, i + 1, F.greatest(F.size(chars) - (n - 1), F.lit(0))) for i in range(n)]
        parts.append(F.transform(F.arrays_zip(*[s.alias(f"c{i}") for i, s in enumerate(shifted)]),
                                 lambda g, n=n: F.pmod(F.xxhash64(F.lit(n), g), F.lit(buckets)).cast("int")))
    return F.array_distinct(F.concat(*parts))


def literal(weights: list[float]) -> Column:
    """The weights as one folded array constant."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def margin(grams: Column, weights: list[float], bias: float) -> Column:
    w = literal(weights)
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(w, g))
    return total / F.sqrt(F.greatest(F.size(grams), F.lit(1))) + F.lit(bias)


def fit(train: DataFrame, rounds: int = 30, rate: float = 4.0, momentum: float = 0.8, l2: float = 1e-3, buckets: int = BUCKETS):
    """Weights and bias from a small table with ``grams`` and ``block``
    (1.0 / 0.0), by full-batch gradient descent over DataFrame sums."""
    n, blocked = train.agg(F.count(F.lit(1)), F.sum("block")).first()
    weights, speed, bias = [0.0] * buckets, [0.0] * buckets, 0.0
    if not n or blocked in (0, n):
        return weights, (-20.0 if not n or not blocked else 20.0)
    bias = math.log(blocked / (n - blocked))
    for _ in range(rounds):
        share = F.col("block") - 1 / (1 + F.exp(-margin(F.col("grams"), weights, bias)))
        pulled = train.select(share.alias("pull"), (share / F.sqrt(F.size("grams"))).alias("each"), "grams")
        sums = (pulled.select(F.explode(F.concat(F.array(F.lit(-1)), F.col("grams"))).alias("bucket"), "pull", "each")
                .groupBy("bucket").agg(F.sum(F.when(F.col("bucket") < 0, F.col("pull")).otherwise(F.col("each"))).alias("g")).collect())
        step = {r["bucket"]: r["g"] / n for r in sums}
        bias += rate * step.get(-1, 0.0)
        for b in range(buckets):
            speed[b] = momentum * speed[b] + rate * (step.get(b, 0.0) - l2 * weights[b])
            weights[b] += speed[b]
    return weights, bias


def labelled_urls(judged: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The small labelled table: urls that a rule decides, evenly by verdict
    and hash order."""
    w = Window.partitionBy("ruled").orderBy(F.xxhash64("host", "path"), "host", "path")
    picked = (judged.where(F.col("ruled").isNotNull()).select("host", "path", "ruled").distinct()
              .withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= rows))
    return picked.select(ngram_buckets(F.col("host"), F.col("path")).alias("grams"),
                         (F.col("ruled") == "block").cast("double").alias("block"))


def judge(pages: DataFrame, train: DataFrame | None = None, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and the
    model's ``block_score``; columns of these names are replaced. ``train``
    (``grams``, ``block``) defaults to the urls that the rules decide."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "ruled", "verdict", "block_score")]
    host, path = split_url(F.col(url_col))
    judged = pages.withColumns({"host": host, "path": path})
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "ruled": ruled})
    if train is None:
        train = labelled_urls(judged)
    weights, bias = fit(materialize(train, "urls"))
    score = 1 / (1 + F.exp(-margin(ngram_buckets(F.col("host"), F.col("path")), weights, bias)))
    judged = judged.withColumn("block_score", score)
    says = F.coalesce(F.col("ruled"), F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return judged.withColumn("verdict", says).select(*own, "host", "path", "rule", "verdict", "block_score")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return done.select("page_id", "host", "path", "rule", "verdict", "block_score")
