"""Shuffle, shard, repeat, batch, collate and mix.

Every "i-th sample" notion goes through ``dense_index`` (I1): a range
shuffle on the random key, never a one-partition ``row_number``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rng import uniform
from .ordering import dense_index


def shuffle(df: DataFrame, key: str, *, epoch_col: str | None = None, mode: str = "global",
            file_col: str = "source_file", buffer_size: int = 1000, seed: int = 0,
            rng: str = "portable", out: str = "idx") -> DataFrame:
    """B2: deterministic shuffle; adds the dense position ``out``.

    ``global``: order by ``u('shuffle', [epoch,] key)`` (then key).
    ``buffer``: files in random order, each file read in buffers of
    ``buffer_size`` rows shuffled inside the buffer (the reference's
    bounded-memory shuffle), i.e. order by (u(file), buffer no, u(row)).
    With ``epoch_col`` positions restart per epoch.

    The rows are range-partitioned and checkpointed: pass the key (and what
    must travel with it) only, and join payloads back by key.
    """
    keys = ([epoch_col] if epoch_col else []) + [key]
    if mode == "global":
        d = df.withColumn("_u", uniform("shuffle", *keys, seed=seed, rng=rng))
        order = ["_u", key]
    elif mode == "buffer":
        fid = F.xxhash64(F.col(file_col))
        # Row number inside each file: skew-safe even for one huge file.
        d = dense_index(df, [key], group_by=[file_col, *([epoch_col] if epoch_col else [])], out="_rif")
        d = (d.withColumn("_uf", uniform("file", *([epoch_col] if epoch_col else []), fid, seed=seed, rng=rng))
             .withColumn("_buf", F.floor(F.col("_rif") / F.lit(buffer_size)))
             .withColumn("_u", uniform("shuffle", *keys, seed=seed, rng=rng))
             .drop("_rif"))
        order = ["_uf", file_col, "_buf", "_u", key]
    else:
        raise ValueError(f"unknown shuffle mode {mode}")
    return dense_index(d, order, group_by=[epoch_col] if epoch_col else [], out=out) \
        .drop("_u", "_uf", "_buf")


def assign_shard(df: DataFrame, world_size: int, idx: str = "idx", out: str = "shard") -> DataFrame:
    """B1: ``shard = idx mod world`` (every sample in exactly one shard)."""
    return df.withColumn(out, F.pmod(F.col(idx), F.lit(int(world_size))).cast("int"))


def epochs(df: DataFrame, n_epochs: int, out: str = "epoch") -> DataFrame:
    """Each row once per epoch (a generator, no join)."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(int(n_epochs) - 1))))


def batch_id(df: DataFrame, batch_size: int, idx: str = "idx", out: str = "batch_id") -> DataFrame:
    """``floor(idx / batch_size)``."""
    return df.withColumn(out, F.floor(F.col(idx) / F.lit(int(batch_size))).cast("bigint"))


def collate(df: DataFrame, batch_col: str = "batch_id", *, ids: str = "ids", mask: str | None = None,
            labels: str | None = None, pad_id: int = K.EOS_ID, side: str = "right") -> DataFrame:
    """Pad ids (pad id), masks (0) and labels (-100) to the batch maximum
    length, all on the same side. One row per sample; the window is per
    batch, so its size is the batch size."""
    w = Window.partitionBy(batch_col)
    d = df.withColumn("padded_len", F.max(F.size(ids)).over(w))

    def pad(c: str, v: int) -> Column:
        fill = F.array_repeat(F.lit(int(v)), (F.col("padded_len") - F.size(c)).cast("int"))
        return F.concat(F.col(c), fill) if side == "right" else F.concat(fill, F.col(c))

    d = d.withColumn(ids, pad(ids, pad_id))
    if mask:
        d = d.withColumn(mask, pad(mask, 0))
    if labels:
        d = d.withColumn(labels, pad(labels, K.IGNORE_ID))
    return d


def mix_sources(steps: DataFrame, step_col: str, weights: Sequence[tuple[str, float]], *,
                seed: int = 0, rng: str = "portable", out: str = "source") -> DataFrame:
    """Weighted choice per step; weights normalised, cumulative
    intervals, last source is the ``else`` branch. A CASE over the (few)
    cumulative bounds: no join at all."""
    total = float(sum(w for _, w in weights))
    u = uniform("mix", step_col, seed=seed, rng=rng)
    acc, expr = 0.0, None
    for name, w in weights[:-1]:
        acc += w / total
        expr = (F.when(u < F.lit(acc), F.lit(name)) if expr is None
                else expr.when(u < F.lit(acc), F.lit(name)))
    last = F.lit(weights[-1][0])
    return steps.withColumn(out, last if expr is None else expr.otherwise(last))


def combine(primary: DataFrame, others: dict[str, DataFrame], *, mode: str = "max_size_cycle",
            step_col: str = "batch_id") -> DataFrame:
    """Combined loader plan ``(step, source, batch_id)``.

    ``max_size_cycle``: steps of the longest source, shorter sources wrap
    (``step mod n_source``); ``min_size``: steps below the shortest count;
    ``sequential``: sources one after another. An empty source gives no
    rows (and makes ``min_size`` empty). Inputs are batch tables with
    a dense ``step_col`` (0..n-1)."""
    sources = {"primary": primary, **others}
    counts = {k: v.agg(F.max(step_col) + 1).first()[0] or 0 for k, v in sources.items()}  # scalars
    parts = []
    if mode == "sequential":
        offset = 0
        for name, d in sources.items():
            parts.append(d.select((F.col(step_col) + offset).alias("step"), F.lit(name).alias("source"),
                                  F.col(step_col).alias("batch_id")))
            offset += counts[name]
    else:
        n_steps = max(counts.values()) if mode == "max_size_cycle" else min(counts.values())
        longest = max(counts, key=counts.get) if mode == "max_size_cycle" else min(counts, key=counts.get)
        steps = sources[longest].select(F.col(step_col).alias("step")).where(F.col("step") < n_steps)
        for name in sources:
            n = counts[name]
            if not n:  # an empty source has nothing to give
                continue
            parts.append(steps.select("step", F.lit(name).alias("source"),
                                      F.pmod(F.col("step"), F.lit(n)).alias("batch_id")))
    if not parts:  # every source is empty
        return primary.select(F.col(step_col).alias("step"), F.lit("primary").alias("source"), F.col(step_col).alias("batch_id")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def updates_per_epoch(n_batches: Column, accumulation: int) -> Column:
    return F.ceil(n_batches / F.lit(int(accumulation)))
