"""Queries over METRIC (= ``events``: series = event_type, step order =
(ts, event_id), value = value): A10, A11, A12, A14."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exact as X
from ..operators import metrics as A
from . import inputs as I
from .registry import register

R6 = lambda c: F.round(c, 6)
LOG_EVERY = 100


def _stepped(spark, sf):
    ev = I.metric_events(spark, sf)
    return A.step_index(ev, "series", ["ts", "event_id"])


STEP_SQL = ("SELECT event_type AS series, ts, event_id, value, "
            "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step FROM events")


@register("a10_meter", """
SELECT event_type AS series, round(last(value ORDER BY ts, event_id), 6) AS last, round(CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE), 6) AS sum,
       CAST(count(*) AS BIGINT) AS count, round(CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE) / count(*), 6) AS avg
FROM events GROUP BY event_type
""")
def a10_meter(spark, sf):
    ev = I.metric_events(spark, sf).withColumn("_ord", F.struct("ts", "event_id"))
    m = A.meter(ev, ["series"], "value", None, "_ord")
    return m.select("series", R6(F.col("last")).alias("last"), R6(F.col("sum")).alias("sum"),
                    F.col("count").cast("bigint"), R6(F.col("avg")).alias("avg"))


A11_SQL = f"""
WITH s AS ({STEP_SQL})
SELECT series, CAST(step // {LOG_EVERY} AS BIGINT) AS log_window, round(last(value ORDER BY step), 6) AS last,
       round(CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE), 6) AS sum, CAST(count(*) AS BIGINT) AS count, round(CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE) / count(*), 6) AS avg
FROM s GROUP BY series, step // {LOG_EVERY}
"""


def _windowed(spark, sf):
    return A.windowed_meter(_stepped(spark, sf), "series", "step", "value", LOG_EVERY)


@register("a11_windowed_meter", A11_SQL)
def a11_windowed_meter(spark, sf):
    m = _windowed(spark, sf)
    return m.select("series", F.col("window").cast("bigint").alias("log_window"), R6(F.col("last")).alias("last"),
                    R6(F.col("sum")).alias("sum"), F.col("count").cast("bigint"), R6(F.col("avg")).alias("avg"))


A12_SQL = f"""
WITH s AS ({STEP_SQL}),
w AS (SELECT series, step // {LOG_EVERY} AS log_window, CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE) AS loss_sum, count(*) AS n FROM s GROUP BY series, step // {LOG_EVERY})
SELECT CAST(log_window AS BIGINT) AS log_window,
       round(CAST(sum(CAST(loss_sum AS DECIMAL(38,12))) AS DOUBLE) / sum(n), 6) AS weighted_loss, CAST(sum(n) AS BIGINT) AS n
FROM w GROUP BY log_window
"""


@register("a12_weighted_mean", A12_SQL)
def a12_weighted_mean(spark, sf):
    """Per log window: mean of the per-series losses weighted by their
    sample counts (the gather-then-mean over processes)."""
    m = _windowed(spark, sf)
    # sum(loss * n) / sum(n) with loss * n = the window's exact loss sum
    parts = X.bins(m, ["window"], F.col("sum"), [F.sum("count").alias("_n")])
    out = (parts.groupBy("window").agg(X.total("_s"), F.sum("_n").alias("n"))
           .select("window", (F.col("_s") / F.col("n")).alias("weighted_loss"), "n"))
    return out.select(F.col("window").cast("bigint").alias("log_window"), R6(F.col("weighted_loss")).alias("weighted_loss"),
                      F.col("n").cast("bigint"))


A14_SQL = f"""
WITH RECURSIVE s AS ({STEP_SQL}),
d AS (SELECT series, step, value,
      CASE WHEN greatest(step - 1, 0) <= 0 THEN 0.0
           ELSE greatest(least((1.0 + greatest(step - 1, 0)) / (10.0 + greatest(step - 1, 0)), 0.9999), 0.0) END AS dec
      FROM s),
r AS (SELECT series, step, value AS ema FROM d WHERE step = 0
      UNION ALL
      SELECT d.series, d.step, d.dec * r.ema + (1.0 - d.dec) * d.value FROM r JOIN d ON d.series = r.series AND d.step = r.step + 1)
SELECT series, CAST(step AS BIGINT) AS step, round(ema, 6) AS ema FROM r
"""


@register("a14_ema", A14_SQL)
def a14_ema(spark, sf):
    e = A.ema_series(_stepped(spark, sf), "series", "step", "value")
    return e.select("series", F.col("step").cast("bigint"), R6(F.col("ema")).alias("ema"))
