"""Streaming queries: run to completion, compared with their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import r6
from tastemill.plans import inputs as I
from tastemill.plans.q_energy import _POWER_CASE
from tastemill.plans.registry import query
from tastemill.streaming import ledger as L


@query("stream_daily_timing", f"""WITH {I.RUNS}
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, component, round(sum(duration_s), 6) AS seconds,
       CAST(count(*) AS BIGINT) AS n_runs FROM runs GROUP BY 1, 2""")
def stream_daily_timing(spark, sf):
    t = L.stream_daily_timing(spark, sf)
    return t.select("day", "component", r6("seconds").alias("seconds"), "n_runs")


@query("stream_component_energy", f"""WITH {I.RUNS},
last AS (SELECT run_id, component, arg_max(duration_s, seq) AS duration_s FROM runs GROUP BY run_id, component)
SELECT run_id, component, round(duration_s, 6) AS duration_s, round({_POWER_CASE} * duration_s / 3600.0, 6) AS energy_wh
FROM last""")
def stream_component_energy(spark, sf):
    e = L.stream_component_energy(spark, sf)
    return e.select("run_id", "component", r6("duration_s").alias("duration_s"), r6("energy_wh").alias("energy_wh"))


@query("stream_feedback_weights", """
SELECT o.o_custkey AS user_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(l.l_returnflag <> 'R') AS BIGINT) AS success,
       round((count_if(l.l_returnflag <> 'R') + 1.0) / (count(*) + 2.0), 6) AS rate
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey""")
def stream_feedback_weights(spark, sf):
    w = L.stream_feedback_weights(spark, sf)
    return w.select("user_id", "total", "success", r6("rate").alias("rate"))
