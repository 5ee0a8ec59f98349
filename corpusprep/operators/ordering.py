"""Skew-safe ordering primitives: dense row index (I1), per-group index and
per-group top-k.

None of them puts a whole group or the whole table into one task:

* ``dense_index`` range-partitions on the ordering key (hot groups are split
  across many partitions by the sampled bounds), numbers rows inside each
  partition, checkpoints the frame so partition ids and positions are frozen,
  then adds per-(partition, group) offsets computed from a small statistics
  table (a prefix sum over at most ``P`` rows per group).
* ``top_k_per_group`` cuts every group to k rows before its own window, in the
  input tasks or, for a large k, within (group, salt).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

# Offsets tables up to this many bytes are broadcast; beyond it they are
# joined with a shuffle (never broadcast without a known bound).
BROADCAST_BYTES = 16 << 20


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dense_index(df: DataFrame, order_by: Sequence[str | Column], *,
                group_by: Sequence[str] = (), out: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order_by`` order
    (within ``group_by`` if given). ``order_by`` must make rows unique
    (within a group), otherwise ties are numbered arbitrarily but stably
    for this run.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(group_by) + list(order_by)
    ranged = (
        df.repartitionByRange(n, *_cols(keys))
        .sortWithinPartitions(*_cols(keys))
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # Freeze partition ids and in-partition positions (reliable checkpoint in
    # the cluster's shared folder; a lost executor recomputes nothing).
    ranged = checkpoint(ranged)

    stats = ranged.groupBy("_pid", *group_by).agg(
        F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group_by).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))) \
                 .drop("_c")
    if not group_by:
        stats = F.broadcast(stats)  # exactly one row per partition: <= n rows
    else:
        stats = checkpoint(stats)  # a row for each partition and group: small next to the data, sized and used
        width = sum((F.coalesce(F.octet_length(F.col(g).cast("string")), F.lit(0)) for g in group_by), F.lit(64))
        if (stats.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
            stats = F.broadcast(stats)
    joined = ranged.join(stats, ["_pid", *group_by])
    return joined.withColumn(out, F.col("_off") + F.col("_mid") - F.col("_m0")) \
                 .drop("_pid", "_mid", "_m0", "_off")


def running_sum(df: DataFrame, order_by: Sequence[str | Column], size: Column, *, group_by: Sequence[str] = (),
                out: str = "before", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = the sum of ``size`` over the rows before each row in
    ``order_by`` order (within ``group_by`` if given). Like ``dense_index``:
    ranges of the order, a sum within each, and the ranges' totals as offsets;
    a group may lie in any number of ranges. Hand it keys and sizes, not
    payloads: its rows move twice."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_cols(group_by), *_cols(order_by)]
    ranged = checkpoint(df.withColumn("_size", size.cast("long")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                        .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    within = Window.partitionBy("_pid", *group_by).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group_by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_pid", *group_by).agg(F.sum("_size").alias("_t"))
               .withColumn("_off", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t"))
    summed = ranged.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    return (summed.join(F.broadcast(offsets) if not group_by else offsets, ["_pid", *group_by])
            .withColumn(out, F.col("_off") + F.col("_in")).drop("_pid", "_mid", "_in", "_off", "_size"))


def top_k_per_group(df: DataFrame, group_by: Sequence[str],
                    order_by: Sequence[str | Column], k: int, *,
                    salts: int | None = None, salt_key: Column | None = None,
                    rank_col: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows of every group in ``order_by`` order
    (ties broken by the order key itself, which should be unique).

    Up to the planner's limit for it (1,000 rows unless set), every input task
    cuts each group to ``k`` rows before the one exchange, so a hot group arrives
    already cut. A larger ``k`` is cut in two steps: within (group, salt), then
    within the group on what is left; there are as many salts as shuffle
    partitions. Both give the same rows."""
    order_cols = _cols(order_by)
    pre = df
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Salt only spreads rows; the result does not depend on it (every salt
        # keeps its own top k). Row position spreads even identical rows.
        salt = F.pmod(F.monotonically_increasing_id() if salt_key is None else F.xxhash64(salt_key), F.lit(salts))
        w1 = Window.partitionBy(*group_by, "_salt").orderBy(*order_cols)
        pre = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*group_by).orderBy(*order_cols)
    res = pre.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k)
    return res.withColumnRenamed("_r", rank_col) if rank_col else res.drop("_r")
