"""Cutting an ordered key space into even ranges without a global sort.

A range is named by an expression over the row's key and a bounded array of
splitters, so the same row gets the same range in every job, on every retry
and in any partitioning. A window over (range, key order) plus the row counts
of the earlier ranges then numbers rows globally, and no task holds more than
a range.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import least_hashes, let

#: Ranges for each shuffle partition: hashed to partitions, they even out.
RANGES_PER_PARTITION = 8
#: Sampled keys for each range.
KEYS_PER_RANGE = 8


def range_count(df: DataFrame) -> int:
    return RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _type(value) -> str:
    if isinstance(value, Row):
        return "struct<" + ", ".join(f"{k}: {_type(value[k])}" for k in value.__fields__) + ">"
    return {bool: "boolean", int: "bigint", str: "string"}[type(value)]


def _table(cuts: list[Row]) -> Column:
    """The splitters as one constant."""
    rows = json.dumps([c.asDict(recursive=True) for c in cuts])
    return F.from_json(F.lit(rows), f"array<{_type(cuts[0])}>")


def splitters(keys: DataFrame, key: Column, ranges: int) -> list[Row]:
    """At most ``ranges - 1`` ordered key values that cut the rows about evenly.

    They come from the ``ranges * KEYS_PER_RANGE`` keys with the smallest
    hashes, a uniform sample that does not depend on partitioning; a hash cut
    keeps the other keys out of the sort. The sample only steers balance: rows
    are never dropped by it."""
    sample = least_hashes(keys.select(key.alias("k")), ranges * KEYS_PER_RANGE, "k").orderBy("k").collect()
    cuts = [sample[i * len(sample) // ranges].k for i in range(1, ranges)] if sample else []
    return list(dict.fromkeys(cuts))


def range_of(cuts: list[Row], key: Column) -> Column:
    """How many splitters are at or below the key (binary search)."""
    if not cuts:
        return F.lit(0)
    table = _table(cuts)

    def step(k):
        def narrow(s, _):
            mid = F.shiftright(s["lo"] + s["hi"], 1)
            inner = F.when(F.get(table, mid) <= k, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))) \
                .otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
            return F.when(s["lo"] < s["hi"], inner).otherwise(s)
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, narrow)["lo"]

    return let(key, step)
