"""Tar-shard queries (S7, S8) on member names built from ``events``: shard
= event_id div 1000, member order = event_id, key = 'k' + event_id div 4,
suffix = event type (upper-cased when value > 50, so lower-casing matters),
payload = props. Runs of one key repeat suffixes, which splits samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import tar as TR
from ..sources.files import scratch_path
from .registry import register

SHARD_ROWS = 1000


def _members(spark, sf):
    ev = table(spark, sf, "events")
    shard = F.floor(F.col("event_id") / SHARD_ROWS).cast("long")
    suffix = F.when(F.col("value") > 50, F.upper("event_type")).otherwise(F.col("event_type"))
    return ev.select(shard.alias("shard"),
                     F.concat(F.lit("shard-"), F.lpad(shard.cast("string"), 5, "0")).alias("url"),
                     F.col("event_id").alias("idx"),
                     F.concat(F.lit("k"), F.floor(F.col("event_id") / 4).cast("string"), F.lit("."), suffix)
                     .alias("fname"),
                     F.encode("props", "UTF-8").alias("data"))


S7_SQL = f"""
WITH RECURSIVE m AS (
  SELECT 'shard-' || lpad(CAST(event_id // {SHARD_ROWS} AS VARCHAR), 5, '0') AS url,
         row_number() OVER (PARTITION BY event_id // {SHARD_ROWS} ORDER BY event_id) AS rn,
         'k' || CAST(event_id // 4 AS VARCHAR) AS key, lower(event_type) AS suffix
  FROM events),
r AS (
  SELECT url, rn, key, suffix, 0 AS sample_no, [suffix] AS seen FROM m WHERE rn = 1
  UNION ALL
  SELECT m.url, m.rn, m.key, m.suffix,
         CASE WHEN m.key <> r.key OR list_contains(r.seen, m.suffix) THEN r.sample_no + 1 ELSE r.sample_no END,
         CASE WHEN m.key <> r.key OR list_contains(r.seen, m.suffix) THEN [m.suffix] ELSE list_append(r.seen, m.suffix) END
  FROM r JOIN m ON m.url = r.url AND m.rn = r.rn + 1)
SELECT url, CAST(sample_no AS BIGINT) AS sample_no, key, string_agg(suffix, ',' ORDER BY rn) AS suffixes
FROM r GROUP BY url, sample_no, key
"""


@register("s7_group_samples", S7_SQL)
def s7_group_samples(spark, sf):
    s = TR.group_samples(_members(spark, sf))
    return s.select("url", F.col("sample_no").cast("bigint"), "key", F.array_join("suffixes", ",").alias("suffixes"))


S8_SQL = f"""
WITH s AS ({S7_SQL})
SELECT url, sample_no, array_to_string(list_sort(list_filter(string_split(suffixes, ','),
       lambda x: x IN ('click', 'view'))), ',') AS kept
FROM s
"""


@register("s8_filter_keys", S8_SQL)
def s8_filter_keys(spark, sf):
    s = TR.group_samples(_members(spark, sf))
    kept = TR.filter_keys(F.col("data"), ["click", "view"])
    return s.select("url", F.col("sample_no").cast("bigint"),
                    F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


@register("s7_read_tar_shards", S7_SQL)
def s7_read_tar_shards(spark, sf):
    folder = scratch_path(spark, "tars")
    # the shard manifest (shard, path, members) is written next to the tars,
    # not collected: its size grows with the number of shards
    TR.write_tar_shards(_members(spark, sf), folder).write.parquet(folder + "/_manifest")
    s = TR.read_tar_samples(spark, folder + "/*.tar")
    return s.select(F.regexp_extract("url", r"shard-[0-9]+", 0).alias("url"), F.col("sample_no").cast("bigint"),
                    "key", F.array_join("suffixes", ",").alias("suffixes"))


@register("s7_tar_payloads", f"""
WITH s AS ({S7_SQL})
SELECT 'shard-' || lpad(CAST(event_id // {SHARD_ROWS} AS VARCHAR), 5, '0') AS url, 'k' || CAST(event_id // 4 AS VARCHAR) AS key,
       CAST(count(*) AS BIGINT) AS members, CAST(sum(strlen(props)) AS BIGINT) AS bytes, md5(string_agg(md5(props), '' ORDER BY md5(props))) AS payloads
FROM events GROUP BY 1, 2
""")
def s7_tar_payloads(spark, sf):
    """Every payload of every sample, read from its place in the shard."""
    folder = scratch_path(spark, "tar-payloads")
    TR.write_tar_shards(_members(spark, sf), folder).write.parquet(folder + "/_manifest")
    s = TR.read_tar_samples(spark, folder + "/*.tar")
    each = s.select(F.regexp_extract("url", r"shard-[0-9]+", 0).alias("url"), "key", F.explode(F.map_values("data")).alias("d"))
    digest = F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("d"))), "").cast("binary"))
    return each.groupBy("url", "key").agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("d")).cast("bigint").alias("bytes"), digest.alias("payloads"))
