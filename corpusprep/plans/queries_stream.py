"""Streaming queries (R1, R2): the driver tables are written as ordered
shards into the shared scratch folder, a stream consumes them to the end
(``availableNow``), and the result is read back. Each must equal the batch
query over the same table."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..session import table
from ..sources.files import scratch_path
from ..streaming import feeds as R
from ..streaming.sinks import CommittedBatches
from . import inputs as I
from .queries_text import LM_LEN, N4_SQL
from .registry import register

SHARDS = 5


def _shards(df, order: str, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.repartitionByRange(SHARDS, order).sortWithinPartitions(order).write.parquet(path)
    return path


@register("r1_stream_featurise", N4_SQL)
def r1_stream_featurise(spark, sf, rng="portable"):
    src = _shards(table(spark, sf, "documents"), "doc_id", "doc-shards")
    out, ckpt = scratch_path(spark, "r1-out"), scratch_path(spark, "r1-ckpt")
    q = R.start_featurise(spark, src, I.doc_vocab(spark, sf), out, ckpt, seq_len=LM_LEN, max_len=I.DOC_LEN, rng=rng)
    q.awaitTermination()
    res = spark.read.parquet(out)
    return res.select(F.col("doc_id").cast("bigint"), F.col("pos").cast("bigint"), F.col("token_id").cast("bigint"),
                      F.col("noisy_id").cast("bigint"), F.round("p_mask", 6).alias("p_mask"),
                      F.col("answer_len").cast("bigint"))


@register("r3_stream_resume", N4_SQL)
def r3_stream_resume(spark, sf, rng="portable"):
    """The featurisation stream stopped after half the shards and started
    again on its checkpoint: every row once."""
    docs, half = table(spark, sf, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(2))
    src, out, ckpt = scratch_path(spark, "r3-in"), scratch_path(spark, "r3-out"), scratch_path(spark, "r3-ckpt")
    vocab = I.doc_vocab(spark, sf)
    for part in (0, 1):
        docs.where(half == part).write.mode("append").parquet(src)
        R.start_featurise(spark, src, vocab, out, ckpt, seq_len=LM_LEN, max_len=I.DOC_LEN, rng=rng).awaitTermination()
    res = spark.read.parquet(out)
    return res.select(F.col("doc_id").cast("bigint"), F.col("pos").cast("bigint"), F.col("token_id").cast("bigint"),
                      F.col("noisy_id").cast("bigint"), F.round("p_mask", 6).alias("p_mask"),
                      F.col("answer_len").cast("bigint"))


@register("r3_batch_failure", N4_SQL)
def r3_batch_failure(spark, sf, rng="portable"):
    """R3 inside a batch: the sink fails after a batch's rows were written and
    before they were committed; started again, every row is there once. Only that
    failure is passed over: any other is raised, and so is its not coming."""
    src = _shards(table(spark, sf, "documents"), "doc_id", "doc-shards")
    out, ckpt = scratch_path(spark, "r3b-out"), scratch_path(spark, "r3b-ckpt")
    vocab, failed = I.doc_vocab(spark, sf), []
    fails = min(1, len(spark.read.parquet(src).inputFiles()) - 1)  # a shard a batch: the second, or the only one

    def hook(batch_id, step):
        if step == "rows" and batch_id == fails:
            failed.append(batch_id)
            raise RuntimeError("planned failure between rows and commit")

    def run(hook=None):
        R.start_featurise_committed(spark, src, vocab, out, ckpt, seq_len=LM_LEN, max_len=I.DOC_LEN, max_bytes_per_trigger=1, rng=rng, hook=hook).awaitTermination()

    try:
        run(hook)
    except StreamingQueryException:
        if not failed:
            raise
    if not failed:
        raise RuntimeError("the planned failure did not come")
    run()
    res = CommittedBatches(out).read(spark, "rows")
    return res.select(F.col("doc_id").cast("bigint"), F.col("pos").cast("bigint"), F.col("token_id").cast("bigint"),
                      F.col("noisy_id").cast("bigint"), F.round("p_mask", 6).alias("p_mask"),
                      F.col("answer_len").cast("bigint"))


R2_SQL = """
SELECT event_type AS series, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS window_start,
       CAST(count(*) AS BIGINT) AS n, round(CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE), 6) AS sum, round(CAST(sum(CAST(value AS DECIMAL(38,12))) AS DOUBLE) / count(*), 6) AS avg,
       round(last(value ORDER BY ts, event_id), 6) AS last
FROM events GROUP BY 1, 2
"""


def _meter_rows(res):
    return res.select("series", F.col("window_start").cast("bigint"), F.col("n").cast("bigint"),
                      F.round("sum", 6).alias("sum"), F.round("avg", 6).alias("avg"), F.round("last", 6).alias("last"))


@register("r2_stream_windowed_meters", R2_SQL)
def r2_stream_windowed_meters(spark, sf):
    """One shard a batch, shards in an order that is not that of event time; all windows."""
    src, out, ckpt = scratch_path(spark, "event-shards"), scratch_path(spark, "r2-out"), scratch_path(spark, "r2-ckpt")
    table(spark, sf, "events").repartition(SHARDS, F.pmod(F.xxhash64("event_id"), F.lit(SHARDS))).write.parquet(src)
    R.start_windowed_meters(spark, src, out, ckpt, max_bytes_per_trigger=1).awaitTermination()
    meters = R.WindowedMeters(out)
    meters.finish(spark)
    return _meter_rows(meters.closed(spark))


@register("r2_late_rows", """
SELECT event_type AS series, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS window_start, CAST(event_id AS BIGINT) AS event_id
FROM events WHERE event_id % 2 = 1
  AND time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL '2 hours'
""")
def r2_late_rows(spark, sf):
    """The side output: a second batch that holds every other event finds most windows closed."""
    ev, meters = table(spark, sf, "events"), R.WindowedMeters(scratch_path(spark, "r2-late"))
    for half in (0, 1):
        meters.add(ev.where(F.col("event_id") % 2 == half), half)
    return meters.late(spark).select("series", F.col("window_start").cast("bigint"), F.col("event_id").cast("bigint"))
