"""Energy ledger: component power, energy per component, breakdown,
emission equivalents, timing and efficiency reports.

The reference divides watt-seconds by 3600 and prints the result as kWh;
it is Wh. Columns here are named for what they hold: ``energy_wh`` is the
correct unit and ``compat_kwh`` repeats the reference's number under its
label, so published reports can be matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.core import safe_div

# ---- fixed values --------------------------------------------------------
CPU_W = 40.0
RAM_W = 6.26
GPU_W = 30.0
# component -> (cpu, ram, gpu) load shares
POWER_SHARES = {
    "Content-based Model": (0.7, 0.2, 0.0),
    "Clustering Model": (0.8, 0.5, 0.0),
    "Matrix Factorization Model": (0.9, 0.3, 0.0),
    "Pure Collaborative Filtering Model": (0.9, 0.3, 0.0),
    "Deep Learning Model": (0.6, 0.4, 0.9),
}
RECOMMENDATION_SHARES = (0.5, 0.2, 0.3)   # any name containing "Recommendation"
DEFAULT_SHARES = (0.5, 0.2, 0.2)
SESSION_W = CPU_W + RAM_W + GPU_W          # 76.26 W for the whole-session estimate
KG_CO2_PER_KWH = 0.4
WH_PER_PHONE_CHARGE = 0.0127               # stated in kWh by the reference
WH_PER_BULB_HOUR = 0.01
MILES_PER_KG_CO2 = 2.5
# --------------------------------------------------------------------------


def _watts(s: tuple) -> float:
    return CPU_W * s[0] + RAM_W * s[1] + GPU_W * s[2]


def component_power(component: Column) -> Column:
    """Component name → watts: exact names first, then the substring
    ``Recommendation``, then the default mix."""
    e = None
    for name, s in POWER_SHARES.items():
        cond = component == F.lit(name)
        e = F.when(cond, F.lit(_watts(s))) if e is None else e.when(cond, F.lit(_watts(s)))
    return (e.when(component.contains("Recommendation"), F.lit(_watts(RECOMMENDATION_SHARES)))
            .otherwise(F.lit(_watts(DEFAULT_SHARES))))


def component_energy(runs: DataFrame) -> DataFrame:
    """runs(run_id, component, seq, duration_s) → the last write per
    (run, component) wins; energy_wh = watts · seconds / 3600."""
    # max_by is a hash aggregate (map-side combine): a hot key costs one
    # partial row per partition, not a sort of all its rows in one task
    last = runs.groupBy("run_id", "component").agg(F.max_by("duration_s", "seq").alias("duration_s"))
    return last.select("run_id", "component", "duration_s",
                       component_power(F.col("component")).alias("watts"),
                       (component_power(F.col("component")) * F.col("duration_s") / 3600.0).alias("energy_wh"))


def energy_breakdown(energy: DataFrame) -> DataFrame:
    """Per run: total, share in percent, rank by energy descending."""
    w = Window.partitionBy("run_id")
    return (energy.withColumn("total_wh", F.sum("energy_wh").over(w))
            .withColumn("share_pct", safe_div(F.col("energy_wh") * 100.0, F.col("total_wh")))
            .withColumn("rank", F.row_number().over(w.orderBy(F.col("energy_wh").desc(), F.col("component")))))


def emissions_equivalents(runs: DataFrame, energy: DataFrame) -> DataFrame:
    """Per run: session seconds (first to last event), CO2 from the whole
    session at 76.26 W, and the reference's equivalents computed on the
    component total. ``*_compat`` carry the reference's unit mix-up."""
    sess = runs.groupBy("run_id").agg(
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("_us"))
    tot = energy.groupBy("run_id").agg(F.sum("energy_wh").alias("total_wh"))
    j = sess.join(tot, "run_id")
    elapsed = F.col("_us") / 1e6
    co2_compat = F.lit(SESSION_W) * elapsed / 3600.0 * F.lit(KG_CO2_PER_KWH)
    return j.select(
        "run_id", elapsed.alias("elapsed_s"), "total_wh",
        co2_compat.alias("co2_kg_compat"), (co2_compat / 1000.0).alias("co2_kg"),
        (F.col("total_wh") / WH_PER_PHONE_CHARGE).alias("phone_charges_compat"),
        (F.col("total_wh") / WH_PER_BULB_HOUR).alias("bulb_hours_compat"),
        (co2_compat * MILES_PER_KG_CO2).alias("car_miles_compat"))


def timing_report(runs: DataFrame) -> DataFrame:
    """Seconds per component and a grand total row (ROLLUP)."""
    return (runs.rollup("component").agg(F.sum("duration_s").alias("seconds"),
                                         F.count(F.lit(1)).alias("n_runs"))
            .withColumn("component", F.coalesce("component", F.lit("TOTAL"))))


def efficiency_ranking(runs: DataFrame) -> DataFrame:
    """Strategies by mean time ascending and ratio to the fastest."""
    m = runs.groupBy("component").agg(F.avg("duration_s").alias("mean_s"))
    w = Window.orderBy("mean_s", "component")   # one row per strategy: bounded
    return (m.withColumn("rank", F.row_number().over(w))
            .withColumn("ratio", safe_div(F.col("mean_s"), F.min("mean_s").over(Window.partitionBy()))))
