"""Energy report golden numbers, interview transcript rules and text rules."""

from pyspark.sql import functions as F

from tastemill.operators import dialogue as D
from tastemill.operators import energy as G
from tastemill.operators import rules as U

# fixed values: a published song-session energy report (component -> value in
# the reference's printed unit) and the totals and shares printed with it
SONG_REPORT = {
    "Full Ensemble Recommendations": 1.331328, "Full Ensemble Round 1": 0.952255,
    "Clustering Model": 0.775798, "Full Ensemble Round 2": 0.588040,
    "Matrix Factorization Model": 0.503723, "Pure Collaborative Filtering Model": 0.320272,
    "Content-based Model": 0.138620, "Deep Learning Model": 0.012976,
    "Pruned ML Recommendations": 0.006585, "Pruned ML Round 1": 0.006187, "Pruned ML Round 2": 0.005973,
    "Genre-Based Round 2": 0.000429, "Genre-Based Round 1": 0.000326, "Genre-Based Recommendations": 0.000263,
    "Popularity-Based Recommendations": 0.000060, "Popularity-Based Round 1": 0.000053,
    "Popularity-Based Round 2": 0.000053,
}
SONG_TOTAL = 4.642943
SONG_SHARES = {"Full Ensemble Recommendations": 28.7, "Clustering Model": 16.7, "Content-based Model": 3.0}


def test_energy_golden(spark):
    watts = {r["c"]: r["w"] for r in spark.createDataFrame([(k,) for k in SONG_REPORT], "c string")
             .select("c", G.component_power(F.col("c")).alias("w")).collect()}
    rows = []
    for k, e in SONG_REPORT.items():
        rows.append((0, k, 1, 1.0))                      # an earlier write that must lose
        rows.append((0, k, 2, e * 3600.0 / watts[k]))
    runs = spark.createDataFrame(rows, "run_id long, component string, seq long, duration_s double")
    b = G.energy_breakdown(G.component_energy(runs)).collect()
    total = b[0]["total_wh"]
    assert abs(total - SONG_TOTAL) < 2e-6 and len(b) == len(SONG_REPORT)
    shares = {r["component"]: r["share_pct"] for r in b}
    for k, v in SONG_SHARES.items():
        assert round(shares[k], 1) == v
    assert round(total / G.WH_PER_PHONE_CHARGE, 1) == 365.6 and round(total / G.WH_PER_BULB_HOUR, 1) == 464.3


def test_dialogue_stop_cap_and_validation(spark):
    t = spark.createDataFrame([
        (1, 0, "assistant", "What do you think?"), (1, 1, "user", "Good"),
        (1, 2, "assistant", "whatever you say"), (1, 3, "user", "Cold"),
        (1, 4, "assistant", "Please go on"), (1, 5, "user", "Done"),
        (1, 6, "user", "after stop"),
        (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "user", "c"), (2, 3, "user", "d"), (2, 4, "user", "e"),
    ], "conv_id long, turn long, role string, text string")
    agg = {r["conv_id"]: r["aggregate"] for r in D.aggregate_topic(t).collect()}
    assert agg == {1: "Good Cold", 2: "a b c d"}
    v = [r["v"] for r in t.filter("role = 'assistant'").orderBy("turn")
         .select(D.validate_followup(F.col("text")).alias("v")).collect()]
    assert v == ["What do you think?", "whatever you say", D.FALLBACK_QUESTION]


POEM = "\n".join([
    "Boldly bounding bees bees hum in gold?",
    "Silver silver neon sparkles, kayak glides, what?",
    "",
    "Tiny tin tin tigers like 42 frogs",
    "DEAR READER, IRON IRON FIN",
])


def test_rule_checks_fixture(spark):
    t = spark.createDataFrame([(1, "me", POEM)], "doc_id long, author string, text string")
    r = U.rule_results(t).first()
    assert r["n_stanzas"] == 2
    assert r["r2"] and r["r5"] and r["r15"] and r["r16"] and r["r20"] and r["r4"]
    assert not r["r9"]                       # line 4 does not end with '?'
    assert r["r13"] is False                 # the first stanza has no simile
    assert r["r19"] is False                 # the first stanza has no number
