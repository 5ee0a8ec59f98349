"""Sums of doubles that do not depend on the order of the rows.

Every finite double is an integer number of units of its exponent bin (bins are
16 binary orders wide). The integers are summed exactly as decimals, bin by bin,
in partial aggregates of any shape; a group's few bins are then put together
from the largest to the smallest. NaN and infinities have a bin of their own, in
which they are added as doubles, so they show whatever stands beside them.

``bins`` are mergeable: adding two bin tables up gives the bins of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary orders of a bin, bits below a bin's least exponent, and the bits that go to the lower of the two integers.
WIDTH, FRACTION, LOW = 16, 52, 36
#: The bin of NaN and infinities, and that of zeros.
SPECIAL, ZERO = 9_999, -9_999
#: What a bin row holds beside its group: the integer in two parts, and the sum of special values.
COLUMNS = ("bin", "hi", "lo", "special")


def _two_to(n: Column) -> Column:
    return F.pow(F.lit(2.0), n.cast("double"))


def _scaled(x: Column, by: Column) -> Column:
    """``x * 2**by`` in two steps, neither of which can overflow or lose bits on its way to an integer."""
    half = F.floor(by / 2)
    return x * _two_to(half) * _two_to(by - half)


def bin_of(x: Column) -> Column:
    """The bin of a double. A power of two may be put a bin too low or high by its logarithm; the integers have room for it."""
    x = x.cast("double")
    order = F.floor(F.log2(F.abs(x)) / WIDTH).cast("int")
    return (F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(SPECIAL)).when(x == 0, F.lit(ZERO)).otherwise(order))


def bins(df: DataFrame, group: Sequence[str], value: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """(group, bin, hi, lo, special and ``extra`` aggregates): a group's rows by
    bin. Null values have a null bin and add nothing."""
    v = df.withColumn("_x", value.cast("double")).withColumn("bin", bin_of(F.col("_x")))
    finite = F.abs(F.col("bin")) < SPECIAL
    units = F.when(finite, _scaled(F.col("_x"), F.lit(FRACTION) - F.col("bin") * WIDTH))
    high = F.floor(units / float(1 << LOW))
    low = (units - high * float(1 << LOW)).cast("long")
    return v.groupBy(*group, "bin").agg(F.sum(high.cast("decimal(20,0)")).cast("decimal(38,0)").alias("hi"),
                                        F.sum(low.cast("decimal(20,0)")).cast("decimal(38,0)").alias("lo"),
                                        F.sum(F.when(F.col("bin") == SPECIAL, F.col("_x"))).alias("special"), *extra)


def merged(table: DataFrame, group: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Bin rows of several tables added up to one row for each (group, bin)."""
    return table.groupBy(*group, "bin").agg(F.sum("hi").cast("decimal(38,0)").alias("hi"), F.sum("lo").cast("decimal(38,0)").alias("lo"),
                                            F.sum("special").alias("special"), *extra)


def total(name: str = "sum") -> Column:
    """Aggregate over a group's bin rows: its sum as a double (null if it has no
    value). The lower integers' carry goes to the higher ones first; the parts
    are then added from the largest bin down, always in this order."""
    carry = F.floor(F.col("lo") / (1 << LOW)).cast("decimal(38,0)")
    entry = F.when(F.abs(F.col("bin")) < SPECIAL, F.struct((-F.col("bin")).alias("b"), (F.col("hi") + carry).cast("double").alias("hi"),
                                                           (F.col("lo") - carry * (1 << LOW)).cast("double").alias("lo")))

    def add(s, e):
        at = -e["b"] * WIDTH - FRACTION
        return s + (_scaled(e["hi"], at + LOW) + _scaled(e["lo"], at))

    finite = F.aggregate(F.array_sort(F.collect_list(entry)), F.lit(0.0), add)
    special = F.sum("special")
    return F.when(F.count("bin") > 0, F.coalesce(special, finite)).alias(name)


def exact_sums(df: DataFrame, group: Sequence[str], value: Column, name: str = "sum") -> DataFrame:
    """(group, sum): bit-equal under any partitioning."""
    return bins(df, group, value).groupBy(*group).agg(total(name))
