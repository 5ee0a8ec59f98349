"""Aggregations and metrics.

Everything is a grouped aggregate (map-side partial aggregation) or a
per-row array expression; none of them collects a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, map_with
from ..session import checkpoint
from . import exact
from .ordering import dense_index

N_BUCKETS = 10


def masked_bucket(n_masked: Column, n: Column) -> Column:
    """A1: share ``m/n`` in (0,.1] -> 0, ..., (.9,1] -> 9, 0 -> 0, in exact
    integer arithmetic: ``max(0, ceil(10m/n) - 1)``."""
    return F.greatest(F.lit(0), F.floor((F.lit(10) * n_masked + n - F.lit(1)) / n).cast("int") - F.lit(1))


def average_by_buckets(values: DataFrame, bucket: str, value: str, out: str = "value") -> DataFrame:
    """A2: mean per bucket with all ``N_BUCKETS`` buckets present (empty ->
    0). The bucket dimension is 10 rows, so the final join is trivial."""
    spark = values.sparkSession
    dim = spark.range(N_BUCKETS).select(F.col("id").cast("int").alias(bucket))
    agg = values.groupBy(bucket).agg(F.avg(value).alias(out))
    return dim.join(F.broadcast(agg), bucket, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def entropy(p: Column) -> Column:
    """``-sum p ln p`` with 0 ln 0 := 0."""
    return -F.aggregate(p, F.lit(0.0), lambda acc, v: acc + F.when(v > 0, v * F.log(v)).otherwise(F.lit(0.0)))


def with_log_softmax(df: DataFrame, x: str, out: str = "lp") -> DataFrame:
    """Log-softmax of an array column (log-sum-exp materialised first)."""
    shifted = map_with(F.col(x), F.array_max(x), lambda v, m: v - m)
    lse = F.log(F.aggregate("_sh", F.lit(0.0), lambda acc, v: acc + F.exp(v)))
    return (df.withColumn("_sh", shifted)
            .withColumn(out, map_with(F.col("_sh"), lse, lambda v, s: v - s))
            .drop("_sh"))


def smoothed_ce(lp: Column, target: Column, eps: float) -> Column:
    """A5 per position from log-probs: ``(1-eps)*(-lp[target]) + eps/V *
    sum_k(-lp_k)``."""
    nll = -F.get(lp, target)
    smooth = -F.aggregate(lp, F.lit(0.0), lambda acc, v: acc + v) / F.size(lp)
    return F.lit(1.0 - eps) * nll + F.lit(eps) * smooth


def meter(df: DataFrame, group: list[str], val: str, n: str | None, step: str) -> DataFrame:
    """A10: last value (by step), sum(val*n), count(n), weighted mean (the
    reference divides blindly; an empty count gives NULL here). Sums are exact
    by exponent bin, so they are bit-equal under any partitioning (``exact``)."""
    w = F.col(n) if n else F.lit(1)
    parts = exact.bins(df, group, F.col(val) * w, [F.max(F.struct(F.col(step).alias("s"), F.col(val).alias("v"))).alias("_last"), F.sum(w).alias("_n")])
    out = parts.groupBy(*group).agg(F.max("_last")["v"].alias("last"), exact.total("sum"), F.sum("_n").alias("count"))
    return out.withColumn("avg", F.try_divide(F.col("sum"), F.col("count")))


def step_index(df: DataFrame, series: str, order_by: list[str], out: str = "step") -> DataFrame:
    """Dense 0-based step per series in event order; skew-safe (a series with
    a third of all rows is still split across partitions)."""
    return dense_index(df, order_by, group_by=[series], out=out)


def windowed_meter(df: DataFrame, series: str, step: str, val: str, log_every: int,
                   n: str | None = None) -> DataFrame:
    """Meter per log window ``floor(step / log_every)`` (reset each window)."""
    d = df.withColumn("window", F.floor(F.col(step) / F.lit(int(log_every))).cast("bigint"))
    return meter(d, [series, "window"], val, n, step)


def ema_decay(step: Column, *, update_after_step: int = 0, inv_gamma: float = 1.0, power: float = 2 / 3,
              min_value: float = 0.0, max_value: float = 0.9999, use_warmup: bool = False) -> Column:
    """A14 decay at optimisation step ``step`` (1-based count of updates)."""
    s = F.greatest(step - F.lit(update_after_step) - F.lit(1), F.lit(0)).cast("double")
    if use_warmup:
        cur = F.lit(1.0) - F.pow(F.lit(1.0) + s / F.lit(inv_gamma), F.lit(-power))
    else:
        cur = (F.lit(1.0) + s) / (F.lit(10.0) + s)
    d = F.greatest(F.least(cur, F.lit(max_value)), F.lit(min_value))
    return F.when(s <= 0, F.lit(0.0)).otherwise(d)


def ema_series(df: DataFrame, series: str, step: str, val: str, **decay_kw) -> DataFrame:
    """``ema_t = d_t*ema_{t-1} + (1-d_t)*x_t`` per series, ``d_t`` the
    warm-up decay of update ``t`` (``d_0 = d_1 = 0``: the average starts at
    the first values).

    Each step is the affine map ``x -> d_t x + (1-d_t) v_t``; the EMA is the
    prefix composition of those maps, computed by ``affine_scan`` so no
    series ever sits in one task.
    """
    d = df.select(series, F.col(step).cast("long").alias("_i"), F.col(val).cast("double").alias("_x")) \
          .withColumn("_a", ema_decay(F.col("_i"), **decay_kw))
    d = d.withColumn("_b", (F.lit(1.0) - F.col("_a")) * F.col("_x")).drop("_x")
    s = affine_scan(d, series, "_i", "_a", "_b")
    # value after step i = a_i * (value entering i) + b_i
    return s.select(series, F.col("_i").alias(step), (F.col("_a") * F.col("_in") + F.col("_b")).alias("ema"))


#: Steps that one row of the scan folds.
CHUNK = 256


def affine_scan(maps: DataFrame, series: str, idx: str, a: str, b: str, *, chunk: int | None = None) -> DataFrame:
    """Prefix composition of affine maps ``x -> a x + b`` applied in ``idx``
    order within each series, starting from 0: adds ``_in`` = the value
    entering each row.

    A blocked scan in built-in expressions: ``chunk`` consecutive steps are
    gathered in a row and folded to their local prefixes and one composed map;
    the composed maps are scanned the same way until a series has one chunk of
    them, and the values that enter the chunks are handed back down. No task
    holds a series at any level."""
    chunk = int(chunk or CHUNK)
    d = maps.select(series, F.col(idx).alias("_i"), F.col(a).alias("_a"), F.col(b).alias("_b"), F.floor(F.col(idx) / F.lit(chunk)).alias("_c"))
    line = F.array_sort(F.collect_list(F.struct("_i", "_a", "_b")))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("q"),
                     F.array().cast("array<struct<i:bigint,a:double,b:double,p:double,q:double>>").alias("out"))

    def step(s, m):
        here = F.struct(m["_i"].cast("long").alias("i"), m["_a"].alias("a"), m["_b"].alias("b"), s["p"].alias("p"), s["q"].alias("q"))
        return F.struct((m["_a"] * s["p"]).alias("p"), (m["_a"] * s["q"] + m["_b"]).alias("q"), F.concat(s["out"], F.array(here)).alias("out"))

    folded = checkpoint(d.groupBy(series, "_c").agg(line.alias("_x")).select(series, "_c", F.aggregate("_x", start, step).alias("_f")))
    composed = folded.select(series, "_c", F.col("_f.p").alias("_p"), F.col("_f.q").alias("_q"))
    if composed.groupBy(series).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        inner = affine_scan(composed, series, "_c", "_p", "_q", chunk=chunk)
        entering = folded.join(inner.select(series, "_c", F.col("_in").alias("_carry")), [series, "_c"])
    else:
        entering = folded.withColumn("_carry", F.lit(0.0))
    each = entering.select(series, "_carry", F.explode("_f.out").alias("m"))
    return each.select(series, F.col("m.i").alias(idx), F.col("m.a").alias(a), F.col("m.b").alias(b),
                       (F.col("m.p") * F.col("_carry") + F.col("m.q")).alias("_in"))


def coords_loss(atoms: DataFrame, true_xyz: list[str], pred_xyz: list[str], mask: str | None = None) -> DataFrame:
    """``sum over masked atoms of |pred - true|^2 / (n_masked + 1e-5)``."""
    m = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    sq = sum((F.col(p).cast("double") * m - F.col(t).cast("double") * m) ** 2 for t, p in zip(true_xyz, pred_xyz))
    return atoms.agg((F.sum(sq) / (F.sum(m) + F.lit(1e-5))).alias("value")).select(
        F.lit("coords_loss").alias("loss"), "value")


def class_ce_loss(rows: DataFrame, logits: str, target: str, ignore: int, name: str) -> DataFrame:
    """Mean cross-entropy over rows whose target is not ``ignore``."""
    d = with_log_softmax(rows.where(F.col(target) != ignore), logits, "_lp")
    return d.agg(F.avg(-F.get(F.col("_lp"), F.col(target))).alias("value")).select(F.lit(name).alias("loss"), "value")


def alignment_loss(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared difference over all elements of two embeddings."""
    e = explode_rows(rows, [], F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), out="_d")
    return e.agg(F.avg("_d").alias("value")).select(F.lit("alignment_loss").alias("loss"), "value")


def evaluate(losses: list[DataFrame], coeffs: dict[str, float]) -> DataFrame:
    """Long table ``(loss, value)`` of the individual losses plus
    ``total_loss = sum(coeff * loss)``; a missing coefficient counts 1.0 and
    an empty loss list is an error."""
    if not losses:
        raise ValueError("no loss calculated")
    parts = losses[0]
    for p in losses[1:]:
        parts = parts.unionByName(p)
    coeff = F.lit(1.0)
    for name, c in coeffs.items():
        coeff = F.when(F.col("loss") == name.replace("_coeff", "_loss"), F.lit(float(c))).otherwise(coeff)
    total = parts.agg(F.sum(coeff * F.col("value")).alias("value")).select(F.lit("total_loss").alias("loss"), "value")
    return parts.unionByName(total)


def norm_per_numel(df: DataFrame, group: list[str], vec: str) -> DataFrame:
    """``||v||_2 / numel`` over all values of each group: squares are
    summed within the row, then by a partial aggregate."""
    squares = F.aggregate(F.col(vec), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return df.groupBy(*group).agg((F.sqrt(F.sum(squares)) / F.sum(F.size(vec))).alias("norm"))
