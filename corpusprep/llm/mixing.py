"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents then has
``target / source_size`` expected copies. The copies are prefix-summed along
the source's documents in order of size, one random offset is added, and a
document is emitted once for each integer boundary its stretch crosses. In
size order long and short documents are drawn evenly, so the words a source
gives differ from its target by about one of its longest documents at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import null_last
from .ranges import range_count, range_of, splitters

WEIGHTS = (5, 2, 1)
#: The mix takes NUMERATOR / DENOMINATOR of all words; a source gives CAP times its words at most.
NUMERATOR, DENOMINATOR, CAP = 3, 2, 2


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, numerator: int = NUMERATOR,
                   denominator: int = DENOMINATOR, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Sources in order take the weights in turn. A target that would pass
    ``cap`` times its source stops there and the excess goes to the others by
    weight: in the order of cap for each unit of weight, the sources that stop
    are a prefix, found from running sums. One row for each source."""
    by_name, by_cap = Window.orderBy("source"), Window.orderBy(F.col("_cap") / F.col("_w"), "source")
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    everywhere = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(everywhere) * numerator / denominator - F.col("_full")) / F.col("_left")
    return (sizes.withColumn("_w", F.get(F.array(*[F.lit(w) for w in weights]), nth).cast("long"))
            .withColumn("_cap", (F.col("source_size") * cap).cast("long"))
            .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
            .withColumn("_left", F.sum("_w").over(everywhere) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
            .withColumn("_level", share)
            .withColumn("_stops", F.col("_cap") <= F.col("_level") * F.col("_w"))
            .withColumn("_open", F.min(F.when(~F.col("_stops"), F.struct(F.col("_cap") / F.col("_w"), "source",
                                                                          F.col("_level").alias("level")))).over(everywhere)["level"])
            .withColumn("target", F.when(F.col("_stops"), F.col("_cap").cast("double"))
                        .otherwise(F.col("_open") * F.col("_w")))
            .select("source", "source_size", "target"))


def offset(source: Column, seed: int) -> Column:
    """One random number in [0, 1) for each source, the same on every run."""
    text = F.concat(F.lit(f"{seed}|"), F.when(source["n"], F.lit("null")).otherwise(F.concat(F.lit("="), source["v"])))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix_sources(docs: DataFrame, size: Column, *, id_col: str = "doc_id", source_col: str = "source",
                weights: Sequence[int] = WEIGHTS, seed: int = 0) -> DataFrame:
    """One row for each row of ``docs``: ``doc`` (the whole input row, so its
    names cannot clash), ``size``, ``source_size``, ``target``, ``copies`` and
    ``taken`` (words the mix takes: copies times size).

    * null source: a source of its own, after all others; null id: after all
      ids; null ``size``: 0. Sizes of 0 take part and add no words.
    * ties of size are ordered by id; rows equal in source, size and id are
      interchangeable, and each gets a place of its own.
    * an empty table gives an empty result; a source without words has
      target 0 and gives no copies.

    Documents move once, by (source, range of the source's size order): a hot
    source is spread over as many ranges as its rows need."""
    ranges = range_count(docs)
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                         null_last(source_col, "").alias("source"),
                         F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
                         null_last(id_col, 0).alias("id"))
    key = F.struct("source", "size", "id")
    keys = checkpoint(placed.select("source", "size", "id"))
    cuts = splitters(keys, key, ranges)
    counts = keys.groupBy("source", range_of(cuts, key).alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    counts = checkpoint(counts)  # at most a row for each range and source
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (counts.select("source", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
             .join(targets, "source"))
    inside = Window.partitionBy("source", "part").orderBy("size", "id")
    numbered = placed.withColumn("part", range_of(cuts, key)).withColumn("nth", F.row_number().over(inside))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(each * n + offset(F.col("source"), seed))
    n = F.col("before") + F.col("nth")
    return (numbered.join(parts, ["source", "part"])
            .withColumn("copies", (upto(n) - upto(n - 1)).cast("long"))
            .select("doc", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every input row as often as it was taken."""
    return (mixed.where("copies > 0")
            .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
            .select("doc.*"))


#: DuckDB SQL for the mix of `documents`.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (source_size * {CAP})::BIGINT AS cap,
      CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS full_, (SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0) AS left_ FROM w
      WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * {NUMERATOR} / {DENOMINATOR} - full_::DOUBLE) / left_::DOUBLE AS level FROM r),
o AS (SELECT *, cap <= level * w AS stops FROM l),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE
      (SELECT level FROM o WHERE NOT stops ORDER BY cap / w, source NULLS LAST LIMIT 1) * w END AS target,
      CAST('0x' || substr(md5('0|' || coalesce('=' || source, 'null')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS u FROM o),
n AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
      CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
      row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(each * n + u) - floor(each * (n - 1) + u))::BIGINT AS copies FROM n)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c"""
