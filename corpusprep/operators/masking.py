"""Masking and noising (N1-N9) on long-form token tables.

Input rows are ``(key, pos, token_id)`` (one row per sequence position);
all randomness is ``uniform(tag, key[, pos])`` so results do not depend on
partitioning. Per-sequence windows are partitioned by the sequence key and
are bounded by the (already truncated) sequence length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import schedules as S
from ..functions.rng import normal, uniform


def bernoulli_mask(rows: DataFrame, key: str, ratio, *, pos: str = "pos", tok: str = "token_id",
                   mask_id: int = K.MASK_ID, seed: int = 0, rng: str = "portable",
                   tag: str = "mask") -> DataFrame:
    """Masked iff ``u(tag, key, pos) < ratio``; ``input_id`` = mask id or
    token, ``label`` = token if masked else -100 (special tokens included)."""
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    m = uniform(tag, key, pos, seed=seed, rng=rng) < r
    return (rows.withColumn("_m", m)
            .withColumn("input_id", F.when(F.col("_m"), F.lit(mask_id)).otherwise(F.col(tok)))
            .withColumn("label", F.when(F.col("_m"), F.col(tok)).otherwise(F.lit(K.IGNORE_ID)))
            .drop("_m"))


def timestep(key: str, timesteps: int, *, seed: int = 0, rng: str = "portable") -> Column:
    """Integer diffusion timestep uniform in [0, T)."""
    return F.least(F.floor(F.lit(float(timesteps)) * uniform("t", key, seed=seed, rng=rng)),
                   F.lit(timesteps - 1)).cast("int")


def schedule_table(spark, name: str, timesteps: int, start: float, end: float) -> DataFrame:
    """Dimension ``(t, mask_ratio)`` of a D1/D2 schedule (T rows)."""
    return (spark.range(timesteps).select(F.col("id").cast("int").alias("t"))
            .withColumn("mask_ratio", S.mask_schedule(name, F.col("t"), timesteps, start, end)))


def timestep_mask(rows: DataFrame, key: str, *, timesteps: int = 1000, schedule: str = "cosine",
                  start: float = 0.0, end: float = 1.0, schedule_df: DataFrame | None = None,
                  seed: int = 0, rng: str = "portable", **kw) -> DataFrame:
    """``t = floor(T*u('t', key))``, ratio looked up in the schedule
    dimension (broadcast equi-join, J2), then N1 with that ratio."""
    if callable(schedule):  # U2: a user Column -> Column schedule of the integer timestep
        schedule_df = rows.sparkSession.range(timesteps).select(F.col("id").cast("int").alias("t")) \
                          .withColumn("mask_ratio", schedule(F.col("t")))
    sched = schedule_df if schedule_df is not None else schedule_table(
        rows.sparkSession, schedule, timesteps, start, end)
    with_t = rows.withColumn("t", timestep(key, timesteps, seed=seed, rng=rng))
    joined = with_t.join(F.broadcast(sched), "t", "inner")  # T rows
    return bernoulli_mask(joined, key, F.col("mask_ratio"), seed=seed, rng=rng, **kw)


def exact_count_mask(rows: DataFrame, key: str, ratio: Column, *, pos: str = "pos",
                     tok: str = "token_id", pad_id: int = 0, mask_id: int = K.MASK_ID,
                     n_col: str | None = None, seed: int = 0, rng: str = "portable") -> DataFrame:
    """``k = int(n*ratio)`` of the n non-pad positions, chosen without
    replacement by ascending ``u('select', key, pos)``; labels -100 on every
    other position (pads included).

    One window per sequence (bounded by its length). When the rows come from
    exploding sequences that were hash-partitioned by ``key``, the window
    needs no exchange; ``n_col`` (non-pad count known per sequence) saves the
    counting window."""
    w_all = Window.partitionBy(key)
    w_ord = Window.partitionBy(key).orderBy(F.col("_nonpad").desc(), F.col("_u"), F.col(pos))
    n = F.col(n_col) if n_col else F.sum(F.col("_nonpad").cast("int")).over(w_all)
    res = (rows.withColumn("_nonpad", F.col(tok) != F.lit(pad_id))
           .withColumn("_n", n)
           .withColumn("_k", F.floor(F.col("_n").cast("double") * ratio).cast("int"))
           .withColumn("_u", uniform("select", key, pos, seed=seed, rng=rng))
           .withColumn("_r", F.row_number().over(w_ord))
           .withColumn("_m", F.col("_nonpad") & (F.col("_r") <= F.col("_k"))))
    return (res.withColumn("input_id", F.when(F.col("_m"), F.lit(mask_id)).otherwise(F.col(tok)))
            .withColumn("label", F.when(F.col("_m"), F.col(tok)).otherwise(F.lit(K.IGNORE_ID)))
            .drop("_nonpad", "_n", "_k", "_u", "_r", "_m"))


def exact_count_mask_array(seq: Column, key: str, ratio: Column, *, is_pad=None, seed: int = 0,
                           rng: str = "portable") -> Column:
    """N3 on one row's own array (no shuffle): boolean mask of the
    ``floor(n * ratio)`` non-pad positions with the smallest
    ``u('select', key, pos)`` (ties by position). ``is_pad(elem)`` marks pads.

    Sorts ``(pad, u, pos)`` structs, inverts the permutation with a second
    sort on position, and compares each rank with ``k`` — O(L log L) per row.
    """
    pad = (lambda e: F.lit(False)) if is_pad is None else is_pad
    keyed = F.transform(seq, lambda e, i: F.struct(pad(e).alias("p"),
                                                  uniform("select", key, i, seed=seed, rng=rng).alias("u"),
                                                  i.alias("i")))
    ranked = F.transform(F.array_sort(keyed), lambda s, r: F.struct(s["i"].alias("i"), r.alias("r"),
                                                                     s["p"].alias("p")))
    by_pos = F.array_sort(ranked)
    n = F.size(F.filter(seq, lambda e: ~pad(e)))
    k = F.floor(n.cast("double") * ratio).cast("int")
    from ..functions.arrays import map_with
    return map_with(by_pos, k, lambda s, kk: ~s["p"] & (s["r"] < kk))


def mask_probability(key: str, eps: float = 1e-3, *, seed: int = 0, rng: str = "portable") -> Column:
    """A sequence's probability of masking."""
    return (1.0 - eps) * uniform("t", key, seed=seed, rng=rng) + eps


def diffusion_mask(rows: DataFrame, key: str, *, pos: str = "pos", tok: str = "token_id",
                   prompt_mask: str | None = None, eps: float = 1e-3,
                   answer_len: str = "non_prompt", clamp_min: bool = True, seq_len: int | None = None,
                   n_col: str | None = None, p_col: str | None = None, mask_id: int = K.MASK_ID, seed: int = 0, rng: str = "portable") -> DataFrame:
    """Per-sequence ``p = (1-eps)*u('t', key) + eps``; a position
    is masked when ``u('mask', key, pos) < p`` and it is not a prompt
    position. ``noisy_id`` = mask id or token; ``label`` = token.

    ``answer_len``: ``"non_prompt"`` = count of non-prompt positions (N5/N6),
    or ``"attention"`` = sequence length (N4, all-ones attention mask, X7).
    ``n_col`` has that count where the sequence knew it before it was exploded:
    then no window, and no exchange of token rows, is needed. ``p_col`` has
    ``mask_probability`` where that was found once for each sequence.
    """
    p = F.col(p_col) if p_col else mask_probability(key, eps, seed=seed, rng=rng)
    masked = uniform("mask", key, pos, seed=seed, rng=rng) < F.col("p_mask")
    if prompt_mask is not None:
        masked = masked & (F.col(prompt_mask) == 0)
    w = Window.partitionBy(key)
    if n_col:
        ans = F.col(n_col)
    elif answer_len == "attention":
        ans = F.lit(int(seq_len)) if seq_len is not None else F.count(F.lit(1)).over(w)
    elif prompt_mask is not None:
        ans = F.sum(F.lit(1) - F.col(prompt_mask)).over(w)
    else:
        ans = F.count(F.lit(1)).over(w)
    if clamp_min:
        ans = F.greatest(ans, F.lit(1))
    return (rows.withColumn("p_mask", p)
            .withColumn("noisy_id", F.when(masked, F.lit(mask_id)).otherwise(F.col(tok)))
            .withColumn("label", F.col(tok))
            .withColumn("answer_len", ans.cast("int")))


def coordinate_noise(atoms: DataFrame, mol: str, t_col: str, schedule: DataFrame, *,
                     xyz=("x", "y", "z"), mask_col: str | None = None, seed: int = 0,
                     rng: str = "portable", atom: str = "atom_idx") -> DataFrame:
    """``x_t = (sqrt_ab * x + sqrt(1 - ab) * eps) * mask`` with ``eps``
    standard normal per (mol, atom, axis); ``schedule`` is a D4 table."""
    j = atoms.join(F.broadcast(schedule.select(F.col("t").alias(t_col), "sqrt_alpha_bar")), t_col, "inner")
    sa = F.col("sqrt_alpha_bar")
    one_m = F.sqrt(F.greatest(F.lit(1.0) - sa * sa, F.lit(0.0)))
    m = F.lit(1.0) if mask_col is None else F.col(mask_col).cast("double")
    for axis, c in enumerate(xyz):
        eps = normal(f"coord{axis}", mol, atom, seed=seed, rng=rng)
        j = j.withColumn(f"{c}_t", (sa * F.col(c).cast("double") + one_m * eps) * m)
    return j


def with_random_topk_mask(df: DataFrame, probs: str, mask_len: Column, temperature: float, key: str,
                          *, out: str = "mask", seed: int = 0, rng: str = "portable") -> DataFrame:
    """N8 per row: ``conf_k = ln(max(p_k,1e-20)) + T*g(u('gumbel', key, k))``;
    cut-off = ``sorted(conf)[mask_len]``; ``out`` is the boolean array
    ``conf < cut-off`` (ties at the cut-off stay unmasked)."""
    from ..functions.rng import gumbel
    conf = F.transform(probs, lambda p, k: F.log(F.greatest(p.cast("double"), F.lit(1e-20)))
                       + F.lit(float(temperature)) * gumbel(uniform("gumbel", key, k, seed=seed, rng=rng)))
    from ..functions.arrays import map_with
    return (df.withColumn("_conf", conf)
            .withColumn(out, map_with(F.col("_conf"), F.get(F.array_sort("_conf"), mask_len),
                                      lambda c, cut: c < cut))
            .drop("_conf"))


def loss_weight(t: Column, mask: Column, min_val: float = 0.3) -> Column:
    """``1 - (1-mask) * ((1-t) * (1-min_val))``."""
    return F.lit(1.0) - (F.lit(1.0) - mask.cast("double")) * ((F.lit(1.0) - t.cast("double")) * F.lit(1.0 - min_val))
