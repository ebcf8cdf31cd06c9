"""Queries on ordered rows per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.schedule import Schedule, schedule_phase, scheduled_weight, scheduled_weights
from ..operators.batches import assign_batches
from ..operators.evaluate import split_finite
from ..operators.sequence import (
    every_nth,
    first_per_group,
    prior_occurrences,
    rolling_mean,
    sequence_targets,
    step_rates,
)
from ..plans.report import metric_report
from ..session import scratch_path
from ..sources.sinks import append_quarantine
from .registry import query, table


@query("sequence_targets", """
SELECT event_id, rn - 1 AS ply, n AS total_plys, least(greatest(n - rn, 0), 40) AS ply_target
FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def targets_query(spark, folder):
    targets = sequence_targets(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], 40)
    return targets.select("event_id", "ply", "total_plys", "ply_target")


REPETITION = """
SELECT event_id, rn - 1 AS rep_count, rn >= 2 AS rep_count_ge1, rn >= 3 AS rep_count_ge2
FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)"""


@query("prior_occurrences", REPETITION)
def repetition_query(spark, folder):
    counted = prior_occurrences(table(spark, folder, "events"), ["user_id"], ["event_type"], ["ts", "event_id"])
    return counted.select("event_id", "rep_count", "rep_count_ge1", "rep_count_ge2")


@query("prior_occurrences_hot_keys", REPETITION)
def repetition_hot(spark, folder):
    """Keys above the mean group size take the range-sorted path; the result is the same."""
    events = table(spark, folder, "events")
    groups = events.select("user_id", "event_type").distinct().count()
    limit = max(1, events.count() // groups)
    counted = prior_occurrences(events, ["user_id"], ["event_type"], ["ts", "event_id"], hot_rows=limit)
    return counted.select("event_id", "rep_count", "rep_count_ge1", "rep_count_ge2")


ROLLING = """
SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING), 6) AS rolling_mean FROM events"""


@query("rolling_mean", ROLLING)
def rolling_query(spark, folder):
    means = rolling_mean(table(spark, folder, "events"), ["event_type"], ["ts", "event_id"], "value", 100)
    return means.select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"))


@query("rolling_mean_hot_keys", ROLLING)
def rolling_hot(spark, folder):
    """Every event type is hot: cut into segments with a lead-in of 99 rows."""
    means = rolling_mean(table(spark, folder, "events"), ["event_type"], ["ts", "event_id"], "value", 100, hot_rows=150)
    return means.select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"))


@query("metric_report", """
WITH s AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value FROM events),
m AS (SELECT run, step, 'value' AS name, avg(value) OVER (PARTITION BY run ORDER BY step ROWS 49 PRECEDING) AS m FROM s)
SELECT run, step, name, round(m, 6) AS rolling_mean FROM m WHERE step % 25 = 0""")
def report_query(spark, folder):
    numbered = sequence_targets(table(spark, folder, "events"), ["event_type"], ["ts", "event_id"])
    metrics = numbered.select(F.col("event_type").alias("run"), (F.col("ply") + 1).alias("step"), F.lit("value").alias("name"), "value")
    return metric_report(metrics, 50, 25).withColumn("rolling_mean", F.round("rolling_mean", 6))


@query("step_rates", """
WITH e AS (SELECT event_id, row_number() OVER w AS rn, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN gap > 0 THEN round(1.0 / gap, 6) END AS recent_rate, CASE WHEN since > 0 THEN round(rn / since, 6) END AS average_rate FROM e""")
def rates_query(spark, folder):
    rates = step_rates(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "ts")
    return rates.select("event_id", F.round("recent_rate", 6).alias("recent_rate"), F.round("average_rate", 6).alias("average_rate"))


@query("every_nth", "SELECT event_id, value FROM events WHERE (event_id + 1) % 50 = 0")
def nth_query(spark, folder):
    steps = table(spark, folder, "events").withColumn("step", F.col("event_id") + 1)
    return every_nth(steps, "step", 50).select("event_id", "value")


@query("first_per_group", """
SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 6""")
def first_query(spark, folder):
    return first_per_group(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], 6).select("event_id", "user_id")


@query("first_many_per_group", """
SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) <= 1200""")
def first_many_query(spark, folder):
    """More rows per group than Spark keeps back before an exchange."""
    return first_per_group(table(spark, folder, "events"), ["event_type"], ["value", "event_id"], 1200).select("event_id", "event_type")


def _batches(size: int, pad: bool) -> str:
    pads = f"""
UNION ALL
SELECT e.user_id, e.event_id, g.n // {size} AS batch_id, m + j AS slot, CAST(-1 AS BIGINT) AS source_index
FROM (SELECT DISTINCT user_id, n, n % {size} AS m FROM o) g, range({size}) r(j), o e
WHERE m > 0 AND j < {size} - m AND e.user_id = g.user_id
  AND e.rn = (g.n // {size}) * {size} + CASE WHEN m >= {size} - m THEN m - ({size} - m) + j ELSE j % m END"""
    return f"""
WITH o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, rn // {size} AS batch_id, rn % {size} AS slot, CAST(rn AS BIGINT) AS source_index FROM o {pads if pad else ""}"""


def _batch_query(spark, folder, size, pad, hot_rows=1_000_000):
    batched = assign_batches(table(spark, folder, "events"), "user_id", ["ts", "event_id"], size, pad, hot_rows)
    return batched.select("user_id", "event_id", "batch_id", "slot", "source_index")


@query("batches", _batches(32, True))
def batches(spark, folder):
    return _batch_query(spark, folder, 32, True)


@query("batches_larger_than_files", _batches(1000, True))
def batches_large(spark, folder):
    return _batch_query(spark, folder, 1000, True)


@query("batches_unpadded", _batches(32, False))
def batches_unpadded(spark, folder):
    return _batch_query(spark, folder, 32, False)


BROKEN = "CASE WHEN value < 1 THEN 'NaN'::DOUBLE WHEN value > 40 THEN 'Infinity'::DOUBLE ELSE value END"


@query("finite_rows", f"""
SELECT event_type, count(*) AS rows, round(sum(x), 4) AS total FROM (SELECT event_type, {BROKEN} AS x FROM events) WHERE isfinite(x) GROUP BY event_type""")
def finite_rows(spark, folder):
    good, _ = split_finite(_broken(spark, folder), ["x"])
    return good.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("x"), 4).alias("total"))


@query("quarantine_log", f"""
SELECT event_id, event_type, 'not finite' AS reason FROM (SELECT *, {BROKEN} AS x FROM events) WHERE NOT isfinite(x)""")
def quarantine_log(spark, folder):
    _, bad = split_finite(_broken(spark, folder), ["x"])
    path = scratch_path(spark, "quarantine")
    append_quarantine(bad, path, "not finite", ["event_type"], ["event_id"])
    return spark.read.parquet(path).select("event_id", "event_type", "reason")


def _broken(spark, folder):
    value = F.col("value")
    x = F.when(value < 1, F.lit(float("nan"))).when(value > 40, F.lit(float("inf"))).otherwise(value)
    return table(spark, folder, "events").withColumn("x", x)


LINEAR = Schedule(2.0, 0.5, 3000, 1000)
COSINE = Schedule(0.2, 1.5, 4000, 500, "cosine")
DECAY = Schedule(1.0, 3.0, 2500, 2000, "exponential", 0.25)


def _progress(s: Schedule) -> str:
    return f"((event_id - {s.start_step}) / {float(s.duration_steps)})"


def _between(s: Schedule, reference: bool) -> str:
    p, a, b = _progress(s), s.start_weight, s.end_weight
    if s.kind == "linear":
        return f"{a} + {p} * ({b} - {a})"
    if s.kind == "cosine":
        share = f"0.5 * (1 + cos(pi() * (1 - {p})))"
        return f"{b} + {share} * ({a} - {b})" if reference else f"{a} + {share} * ({b} - {a})"
    share = f"exp(-10 * {s.decay_rate} * {p})"
    return f"{a} + {share} * ({b} - {a})" if reference else f"{a} + (1 - {share}) / (1 - exp(-10 * {s.decay_rate})) * ({b} - {a})"


def _case(s: Schedule, reference: bool) -> str:
    return f"""round(CAST(CASE WHEN event_id <= {s.start_step} THEN {s.start_weight} WHEN event_id >= {s.start_step + s.duration_steps}
      THEN {s.end_weight} ELSE {_between(s, reference)} END AS DOUBLE), 6)"""


SCHEDULES = {"linear": LINEAR, "cosine": COSINE, "decay": DECAY}


def _schedule_sql(reference: bool) -> str:
    weights = ", ".join(f"{_case(s, reference)} AS {name}" for name, s in SCHEDULES.items())
    return f"""SELECT event_id, {weights}, CASE WHEN event_id <= 1000 THEN 'pre' WHEN event_id >= 4000 THEN 'post' ELSE 'active' END AS phase FROM events"""


def _schedule(spark, folder, variant):
    from dataclasses import replace

    events = table(spark, folder, "events")
    weights = [F.round(scheduled_weight("event_id", replace(s, variant=variant)), 6).alias(n) for n, s in SCHEDULES.items()]
    return events.select("event_id", *weights, schedule_phase("event_id", LINEAR).alias("phase"))


@query("schedule_reference", _schedule_sql(True))
def schedule_reference(spark, folder):
    return _schedule(spark, folder, "reference")


@query("schedule_monotone", _schedule_sql(False))
def schedule_monotone(spark, folder):
    return _schedule(spark, folder, "monotone")


@query("schedules_with_defaults", """
SELECT event_id, 1.0::DOUBLE AS policy, 2.0::DOUBLE AS value,
  round(CASE WHEN event_id <= 500 THEN 0.1 WHEN event_id >= 5500 THEN 0.4 ELSE 0.1 + 0.3 * (event_id - 500) / 5000.0 END, 6)::DOUBLE AS moves_left,
  round(CASE WHEN event_id <= 0 THEN 1.0 WHEN event_id >= 2000 THEN 0.25 ELSE 1.0 - 0.75 * 0.5 * (1 + cos(pi() * (1 - event_id / 2000.0))) END, 6)::DOUBLE AS material
FROM events""")
def schedules_with_defaults(spark, folder):
    """Four weights at each step: one static, one whose schedule leaves all open, and two that change."""
    weights = scheduled_weights(
        "event_id",
        {"policy": 1.0, "value": 2.0, "moves_left": 0.1, "material": 0.25},
        {
            "value": {},
            "moves_left": {"end_weight": 0.4, "start_step": 500},
            "material": {"start_weight": 1.0, "duration_steps": 2000, "kind": "cosine"},
            "unknown": {"end_weight": 9.0},
        },
        steps=5000,
    )
    return table(spark, folder, "events").select("event_id", *[F.round(w, 6).alias(n) for n, w in weights.items()])
