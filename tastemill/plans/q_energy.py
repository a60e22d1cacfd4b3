"""Energy ledger and timing queries over ``runs`` (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions.core import r6  # noqa: F811

from tastemill.operators import energy as G
from tastemill.plans import inputs as I
from tastemill.plans.registry import query
from tastemill.sources import tables as S


def _w(shares):
    return G._watts(shares)


_POWER_CASE = "CASE " + " ".join(
    f"WHEN component = '{k}' THEN {_w(v)!r}" for k, v in G.POWER_SHARES.items()) + \
    f" WHEN contains(component, 'Recommendation') THEN {_w(G.RECOMMENDATION_SHARES)!r}" + \
    f" ELSE {_w(G.DEFAULT_SHARES)!r} END"

_ENERGY_SQL = f"""{I.RUNS},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, component ORDER BY seq DESC) AS rn
                        FROM runs) t WHERE rn = 1),
energy AS (SELECT run_id, component, duration_s, {_POWER_CASE} AS watts,
                  {_POWER_CASE} * duration_s / 3600.0 AS energy_wh FROM last)"""


@query("component_power", f"""WITH {I.RUNS}
SELECT DISTINCT component, round({_POWER_CASE}, 6) AS watts FROM runs""")
def component_power(spark, sf):
    r = S.runs(spark, sf)
    return r.select("component").distinct().select("component", F.round(G.component_power(F.col("component")), 6).alias("watts"))


@query("component_energy", f"""WITH {_ENERGY_SQL}
SELECT run_id, component, round(watts, 6) AS watts, round(energy_wh, 6) AS energy_wh,
       round(energy_wh, 6) AS compat_kwh FROM energy""")
def component_energy(spark, sf):
    e = G.component_energy(S.runs(spark, sf))
    return e.select("run_id", "component", r6("watts").alias("watts"),
                    r6("energy_wh").alias("energy_wh"), r6("energy_wh").alias("compat_kwh"))


@query("energy_breakdown", f"""WITH {_ENERGY_SQL}
SELECT run_id, component, round(energy_wh, 6) AS energy_wh,
       round(sum(energy_wh) OVER (PARTITION BY run_id), 6) AS total_wh,
       round(energy_wh * 100.0 / nullif(sum(energy_wh) OVER (PARTITION BY run_id), 0), 6) AS share_pct,
       CAST(row_number() OVER (PARTITION BY run_id ORDER BY energy_wh DESC, component) AS INTEGER) AS rank
FROM energy""")
def energy_breakdown(spark, sf):
    b = G.energy_breakdown(G.component_energy(S.runs(spark, sf)))
    return b.select("run_id", "component", r6("energy_wh").alias("energy_wh"),
                    r6("total_wh").alias("total_wh"), r6("share_pct").alias("share_pct"),
                    F.col("rank").cast("int"))


@query("emissions_equivalents", f"""WITH {_ENERGY_SQL},
sess AS (SELECT run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_s FROM runs GROUP BY run_id),
tot AS (SELECT run_id, sum(energy_wh) AS total_wh FROM energy GROUP BY run_id)
SELECT s.run_id, round(elapsed_s, 6) AS elapsed_s, round(total_wh, 6) AS total_wh,
       round({G.SESSION_W} * elapsed_s / 3600.0 * {G.KG_CO2_PER_KWH}, 6) AS co2_kg_compat,
       round({G.SESSION_W} * elapsed_s / 3600.0 * {G.KG_CO2_PER_KWH} / 1000.0, 6) AS co2_kg,
       round(total_wh / {G.WH_PER_PHONE_CHARGE}, 6) AS phone_charges_compat,
       round(total_wh / {G.WH_PER_BULB_HOUR}, 6) AS bulb_hours_compat,
       round({G.SESSION_W} * elapsed_s / 3600.0 * {G.KG_CO2_PER_KWH} * {G.MILES_PER_KG_CO2}, 6) AS car_miles_compat
FROM sess s JOIN tot t ON t.run_id = s.run_id""")
def emissions_equivalents(spark, sf):
    r = S.runs(spark, sf)
    e = G.emissions_equivalents(r, G.component_energy(r))
    return e.select("run_id", *[r6(c).alias(c) for c in e.columns if c != "run_id"])


@query("timing_report", f"""WITH {I.RUNS}
SELECT coalesce(component, 'TOTAL') AS component, round(sum(duration_s), 6) AS seconds,
       CAST(count(*) AS BIGINT) AS n_runs FROM runs GROUP BY ROLLUP (component)""")
def timing_report(spark, sf):
    t = G.timing_report(S.runs(spark, sf))
    return t.select("component", r6("seconds").alias("seconds"), "n_runs")


@query("efficiency_ranking", f"""WITH {I.RUNS},
m AS (SELECT component, avg(duration_s) AS mean_s FROM runs GROUP BY component)
SELECT component, round(mean_s, 6) AS mean_s, CAST(row_number() OVER (ORDER BY mean_s, component) AS INTEGER) AS rank,
       round(mean_s / min(mean_s) OVER (), 6) AS ratio FROM m""")
def efficiency_ranking(spark, sf):
    e = G.efficiency_ranking(S.runs(spark, sf))
    return e.select("component", r6("mean_s").alias("mean_s"), F.col("rank").cast("int"),
                    r6("ratio").alias("ratio"))
