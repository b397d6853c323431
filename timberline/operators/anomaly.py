"""Fixed-rule anomaly detection and its summary.

Each rule is one grouped aggregation over the window (partial aggregation on
the map side, so a unit or source holding a third of all rows still produces
one row per task before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import fill, is_error_severity, py_str
from timberline.operators.window import in_window
from timberline.params import AnomalyParams
from timberline.schema import EXPECTED_UNITS
from timberline.session import materialize

ANOMALY_COLUMNS = ["kind_order", "type", "unit", "source", "count", "severity", "description"]

# --- fixed values: anomaly descriptions ----------------------------------------
ERROR_SPIKE_TEXT = "High error rate in {unit}: {count} errors"
HIGH_VOLUME_TEXT = "High log volume from {source}: {count} logs"
MISSING_LOGS_TEXT = "Missing expected logs from {unit}"
# -----------------------------------------------------------------------------


def error_spikes(logs: DataFrame, p: AnomalyParams, as_of) -> DataFrame:
    """A2: units with more than ``error_spike_threshold`` err/crit/emerg rows."""
    counts = (in_window(logs, as_of, p.since)
              .filter(is_error_severity(F.col("severity")))
              .groupBy("unit").agg(F.count(F.lit(1)).alias("count")))
    return spikes_from_counts(counts, p)


def spikes_from_counts(unit_errors: DataFrame, p: AnomalyParams) -> DataFrame:
    """A2 from precomputed ``(unit, count)`` error counts."""
    counts = unit_errors.filter(F.col("count") > p.error_spike_threshold)
    return counts.select(
        F.lit("error_spike").alias("type"),
        F.coalesce(F.col("unit"), F.lit("")).alias("unit"),
        F.col("count"),
        F.lit("high").alias("severity"),
        fill(ERROR_SPIKE_TEXT, unit=py_str(F.col("unit")), count=F.col("count")).alias("description"))


def high_volume(logs: DataFrame, p: AnomalyParams, as_of) -> DataFrame:
    """A3: sources with more than ``high_volume_threshold`` rows."""
    counts = (in_window(logs, as_of, p.since)
              .groupBy("source").agg(F.count(F.lit(1)).alias("count")))
    return volume_from_counts(counts, p)


def volume_from_counts(source_counts: DataFrame, p: AnomalyParams) -> DataFrame:
    """A3 from precomputed ``(source, count)`` row counts."""
    counts = source_counts.filter(F.col("count") > p.high_volume_threshold)
    return counts.select(
        F.lit("high_volume").alias("type"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.col("count"),
        F.lit("medium").alias("severity"),
        fill(HIGH_VOLUME_TEXT, source=py_str(F.col("source")), count=F.col("count")).alias("description"))


def missing_logs(logs: DataFrame, p: AnomalyParams, as_of,
                 expected: list[str] | None = None) -> DataFrame:
    """Expected units with no row in the window (sorted by unit, D17).

    The set difference is computed as one global aggregate whose state is the
    set of *expected* units seen (at most ``len(expected)`` values), then
    ``array_except``; no join and no unbounded state.
    """
    expected = sorted(expected or EXPECTED_UNITS)
    exp = F.array(*[F.lit(u) for u in expected])
    seen = (in_window(logs, as_of, p.since)
            .filter(F.col("unit").isin(*expected))
            .agg(F.collect_set("unit").alias("seen")))
    missing = seen.select(F.explode(F.array_sort(F.array_except(exp, F.col("seen")))).alias("unit"))
    return missing.select(
        F.lit("missing_logs").alias("type"),
        F.col("unit"),
        F.lit("medium").alias("severity"),
        fill(MISSING_LOGS_TEXT, unit=F.col("unit")).alias("description"))


def detect_anomalies(logs: DataFrame, p: AnomalyParams, as_of,
                     expected: list[str] | None = None) -> DataFrame:
    """A5: the three rules in one scan and one shuffle. ``kind_order`` and the
    (count desc, key asc) order inside a rule give the reference's list order.

    The window is counted by unit and by source in one ``GROUPING SETS`` aggregation. Each
    expected unit (``[]`` = none; default: the fixed list) joins the scan as one row that
    counts nothing, so a unit without logs is a group of its own with count 0.
    """
    spark = logs.sparkSession
    units = EXPECTED_UNITS if expected is None else expected
    rows = in_window(logs, as_of, p.since).select(
        "unit", "source", F.lit(1).alias("_n"), is_error_severity(F.col("severity")).alias("_err"),
        F.lit(False).alias("_expected"))
    if units:
        rows = rows.unionByName(spark.range(1).select(
            F.explode(F.array(*[F.lit(u) for u in sorted(set(units))])).alias("unit"),
            F.lit(None).cast("string").alias("source"), F.lit(0).alias("_n"), F.lit(False).alias("_err"),
            F.lit(True).alias("_expected")))
    g = rows.groupingSets([["unit"], ["source"]], "unit", "source").agg(
        F.sum("_n").alias("_rows"), F.count_if("_err").alias("_errors"), F.max("_expected").alias("_exp"),
        F.grouping("source").alias("_by_unit"))
    by_unit = F.col("_by_unit") == 1
    g = g.withColumn("kind_order", F.when(by_unit & (F.col("_errors") > p.error_spike_threshold), 1)
                     .when(~by_unit & (F.col("_rows") > p.high_volume_threshold), 2)
                     .when(by_unit & F.col("_exp") & (F.col("_rows") == 0), 3)).filter("kind_order IS NOT NULL")
    kind = F.col("kind_order")

    def pick(spike: Column, volume: Column, missing: Column) -> Column:
        return F.when(kind == 1, spike).when(kind == 2, volume).otherwise(missing)

    found = g.select(
        "kind_order",
        pick(F.lit("error_spike"), F.lit("high_volume"), F.lit("missing_logs")).alias("type"),
        F.when(kind != 2, F.coalesce("unit", F.lit(""))).alias("unit"),
        F.when(kind == 2, F.coalesce("source", F.lit(""))).alias("source"),
        F.when(kind == 1, F.col("_errors")).when(kind == 2, F.col("_rows")).alias("count"),
        pick(F.lit("high"), F.lit("medium"), F.lit("medium")).alias("severity"),
        pick(fill(ERROR_SPIKE_TEXT, unit=py_str(F.col("unit")), count=F.col("_errors")),
             fill(HIGH_VOLUME_TEXT, source=py_str(F.col("source")), count=F.col("_rows")),
             fill(MISSING_LOGS_TEXT, unit=F.col("unit"))).alias("description"))
    return found.select(*ANOMALY_COLUMNS)


def anomaly_order() -> list[Column]:
    return [F.col("kind_order").asc(), F.col("count").desc_nulls_last(),
            F.coalesce(F.col("unit"), F.col("source")).asc_nulls_last()]


def anomaly_summary_parts(logs: DataFrame, p: AnomalyParams, as_of, recent: int = 5,
                          counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A8 as one row: totals over error spikes and high volume (missing_logs is
    not part of the report's summary), counts per type and the first ``recent``
    anomalies in list order as an array.

    Join-free: the totals and the top-k (TakeOrderedAndProject, so only
    ``recent`` rows reach the final step) are unioned and folded by one global
    aggregate. ``counts`` = precomputed ((unit, error count), (source, count))
    lets a caller that already grouped the window reuse that scan.
    """
    if counts:
        rows = spikes_from_counts(counts[0], p).withColumn("kind_order", F.lit(1)).unionByName(
            volume_from_counts(counts[1], p).withColumn("kind_order", F.lit(2)), allowMissingColumns=True)
    else:
        # One row per anomalous unit / source: small, read by two branches.
        rows = materialize(detect_anomalies(logs, p, as_of, expected=[]))
    totals = rows.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_if(F.col("severity") == "high").alias("high_severity"),
        F.count_if(F.col("severity") == "medium").alias("medium_severity"),
        F.count_if(F.col("type") == "error_spike").alias("error_spike_count"),
        F.count_if(F.col("type") == "high_volume").alias("high_volume_count"))
    top = rows.orderBy(*anomaly_order()).limit(recent).select(F.struct(
        F.col("kind_order").alias("_o1"), (F.lit(0) - F.col("count")).alias("_o2"),
        F.coalesce("unit", "source").alias("_o3"),
        F.col("type"), F.col("severity"), F.col("description")).alias("_a"))
    top = top.agg(F.collect_list("_a").alias("_recent"))
    parts = totals.unionByName(top, allowMissingColumns=True)
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    recent_sorted = F.sort_array(F.coalesce(F.col("_recent"), F.array()))
    return row.select(
        *[F.coalesce(c, F.lit(0)).alias(c) for c in
          ("total_anomalies", "high_severity", "medium_severity", "error_spike_count", "high_volume_count")],
        F.transform(recent_sorted, lambda a: F.struct(a["type"].alias("type"), a["severity"].alias("severity"),
                                                      a["description"].alias("description"))).alias("recent"))


def anomaly_summary(logs: DataFrame, p: AnomalyParams, as_of, recent: int = 5) -> DataFrame:
    """A8 flattened: recent anomalies rendered ``[severity] description``, one per line."""
    s = anomaly_summary_parts(logs, p, as_of, recent)
    return s.select("total_anomalies", "high_severity", "medium_severity", "error_spike_count",
                    "high_volume_count",
                    F.array_join(F.transform("recent", lambda a: F.concat(
                        F.lit("["), a["severity"], F.lit("] "), a["description"])), "\n").alias("recent_anomalies"))
