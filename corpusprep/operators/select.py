"""Selection over score tables (K1-K7).

Per-row results use higher-order functions on the logits array (no
shuffle); row-shaped results use windows partitioned by the row id, which
are bounded by the vocabulary width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, map_with
from ..functions.rng import gumbel, uniform


def with_softmax(df: DataFrame, x: str, out: str = "p") -> DataFrame:
    """K7: numerically stable softmax of an ``array<double>`` column.

    The max and the normaliser reach the lambdas through ``map_with`` so
    each is evaluated once per row, not once per element."""
    e = map_with(F.col(x), F.array_max(x), lambda v, m: F.exp(v - m))
    return (df.withColumn("_e", e)
            .withColumn(out, map_with(F.col("_e"), F.aggregate("_e", F.lit(0.0), lambda acc, v: acc + v),
                                      lambda v, s: v / s))
            .drop("_e"))


def argmax(x: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def gumbel_argmax(x: Column, key: Column, temperature: float, *, mode: str = "divide",
                  seed: int = 0, rng: str = "portable") -> Column:
    """K1: ``argmax(x/max(T,1e-10) + g)`` (``divide``) or ``argmax(x + T*g)``
    (``scale``; T=0 is plain argmax); ties resolve to the lowest index."""
    if mode == "divide":
        s = F.transform(x, lambda v, k: v / F.lit(max(float(temperature), 1e-10))
                        + gumbel(uniform("gumbel", key, k, seed=seed, rng=rng)))
    elif temperature == 0:
        s = x
    else:
        s = F.transform(x, lambda v, k: v + F.lit(float(temperature))
                        * gumbel(uniform("gumbel", key, k, seed=seed, rng=rng)))
    return argmax(s)


def explode_scores(df: DataFrame, key: str, scores: str = "logits") -> DataFrame:
    """Long form ``(key, k, x)``."""
    return explode_rows(df, [key], scores, pos="k", out="x")


def top_k_rows(long: DataFrame, key: str, k: int) -> DataFrame:
    """K2: keep the k largest scores per row (ties by lower index)."""
    w = Window.partitionBy(key).orderBy(F.desc("x"), F.asc("k"))
    return long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def top_k_top_p(long: DataFrame, key: str, *, top_k: int = 0, top_p: float = 1.0,
                min_tokens_to_keep: int = 1, vocab_size: int | None = None) -> DataFrame:
    """K3: rows that survive top-k then nucleus filtering.

    top-k drops scores below the k-th largest (ties kept, ``rank``), k clamped
    to [min_keep, V]; top-p on the softmax of the survivors drops a token when
    the cumulative mass *before* it exceeds p (the first one always kept);
    with ``min_tokens_to_keep = m > 1`` the first m+1 are protected."""
    d = long
    if top_k > 0:
        kk = max(top_k, min_tokens_to_keep) if vocab_size is None else min(max(top_k, min_tokens_to_keep), vocab_size)
        # the least score among the first kk: of a narrower row, its least score
        d = (d.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("x"), F.asc("k"))))
             .withColumn("_kth", F.min(F.when(F.col("_rn") <= kk, F.col("x"))).over(Window.partitionBy(key)))
             .where(F.col("x") >= F.col("_kth")).drop("_rn", "_kth"))
    if top_p < 1.0:
        w_all = Window.partitionBy(key)
        w_ord = Window.partitionBy(key).orderBy(F.desc("x"), F.asc("k"))
        d = (d.withColumn("_mx", F.max("x").over(w_all))
             .withColumn("_e", F.exp(F.col("x") - F.col("_mx")))
             .withColumn("_p", F.col("_e") / F.sum("_e").over(w_all))
             .withColumn("_rn", F.row_number().over(w_ord))
             .withColumn("_before", F.coalesce(F.sum("_p").over(
                 w_ord.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
        # token i (0-based, sorted) is removed when the mass before it exceeds p;
        # with m > 1 the first m+1 tokens are protected
        protect = min_tokens_to_keep if min_tokens_to_keep > 1 else 0
        keep = (F.col("_rn") == 1) | ~(F.col("_before") > F.lit(float(top_p)))
        if protect:
            keep = keep | (F.col("_rn") <= F.lit(protect + 1))
        d = d.where(keep).drop("_mx", "_e", "_p", "_rn", "_before")
    return d


def ranked(x: Column) -> Column:
    """A row's scores as (n, k, x), greatest first, ties by lower index."""
    return F.sort_array(F.transform(x, lambda v, i: F.struct((-v).alias("n"), i.alias("k"), v.alias("x"))))


def top_k_entries(x: Column, k: int) -> Column:
    """K2 within the row: the k largest scores of an array."""
    return F.slice(ranked(x), 1, k)


def top_k_top_p_entries(x: Column, *, top_k: int = 0, top_p: float = 1.0, min_tokens_to_keep: int = 1) -> Column:
    """K3 within the row: the entries that ``top_k_top_p`` keeps. Both filters
    keep a prefix of the ranked scores, so two passes find where it ends."""
    def cut(r):
        if top_k <= 0:
            return r
        kth = F.get(r, F.least(F.lit(max(top_k, min_tokens_to_keep)), F.size(r)) - 1)["x"]
        return F.transform(F.array(kth), lambda least: F.filter(r, lambda e: e["x"] >= least))[0]

    def nucleus(r):
        if top_p >= 1.0:
            return r
        top = F.get(r, 0)["x"]
        protect = min_tokens_to_keep + 1 if min_tokens_to_keep > 1 else 1

        def prefix(mass):
            start = F.struct(F.lit(0.0).alias("before"), F.lit(0).alias("n"))
            return F.aggregate(r, start, lambda s, e: F.struct(
                (s["before"] + F.exp(e["x"] - mass["top"]) / mass["sum"]).alias("before"),
                (s["n"] + (s["before"] <= F.lit(float(top_p))).cast("int")).alias("n")))["n"]

        def total(t):
            return F.struct(t.alias("top"), F.aggregate(r, F.lit(0.0), lambda s, e: s + F.exp(e["x"] - t)).alias("sum"))
        mass = F.transform(F.array(top), total)
        return F.slice(r, F.lit(1), F.greatest(F.transform(mass, prefix)[0], F.lit(protect)))

    kept = F.transform(F.array(ranked(x)), cut)
    return F.transform(kept, lambda r: F.when(F.size(r) == 0, r).otherwise(nucleus(r)))[0]


def transfer_quota(n: Column, steps: int) -> Column:
    """K4: ``n`` masked tokens over ``steps`` steps: ``n div s`` each, one
    more for the first ``n mod s`` steps."""
    s = int(steps)
    return F.transform(F.sequence(F.lit(0), F.lit(s - 1)),
                       lambda i: F.floor(n / F.lit(s)).cast("int")
                       + F.when(i < F.pmod(n, F.lit(s)), F.lit(1)).otherwise(F.lit(0)))


def confidence(strategy: str, low_confidence: Column, *keys, seed: int = 0, rng: str = "fast") -> Column:
    """K5: what positions are released by: the chosen token's probability
    (``low_confidence``) or a uniform draw (``random``)."""
    strategies = {"low_confidence": lambda: low_confidence, "random": lambda: uniform("release", *keys, seed=seed, rng=rng)}
    if strategy not in strategies:
        raise ValueError(f"release strategy {strategy!r} is none of {sorted(strategies)}")
    return strategies[strategy]()


def block_steps(gen_length: int, block_length: int, steps: int) -> int:
    """K5: steps for each block; the lengths must divide evenly."""
    if block_length <= 0 or gen_length % block_length:
        raise ValueError(f"{gen_length} positions are no whole number of blocks of {block_length}")
    blocks = gen_length // block_length
    if steps % blocks:
        raise ValueError(f"{steps} steps cannot be shared by {blocks} blocks")
    return steps // blocks


def release(long: DataFrame, key: str, quota: Column, *, conf: str = "conf",
            candidate: str = "candidate", pos: str = "pos", block: tuple[int, int] | None = None) -> DataFrame:
    """K5: mark the ``min(quota, candidates)`` highest-confidence candidate
    positions of each row as released (ties by lower position). With ``block =
    (start, end)`` only positions from start up to end are candidates. Ranks
    come from the grouped dense index: a key may hold any share of the rows."""
    from .ordering import dense_index
    able = F.coalesce(F.col(candidate), F.lit(False))
    if block is not None:
        able = able & (F.col(pos) >= block[0]) & (F.col(pos) < block[1])
    d = long.withColumn("_nc", ~able)
    d = dense_index(d, ["_nc", F.desc(conf), F.asc(pos)], group_by=[key], out="_r")
    return d.withColumn("released", ~F.col("_nc") & (F.col("_r") < quota)).drop("_r", "_nc")


def guidance(cond: Column, uncond: Column, scale: float) -> Column:
    """K6: ``un + (s+1)*(cond-un)`` element-wise."""
    return F.zip_with(cond, uncond, lambda c, u: u + F.lit(float(scale) + 1.0) * (c - u))
