"""Structured Streaming jobs.

R1 featurises arriving text shards into masked LM rows. Everything after
the source is row-local (tokens, P6 in long form, a stream-static broadcast
join to the vocabulary, the deterministic diffusion mask), so the query is
stateless and its output equals the batch result row for row.

R2 keeps windowed meters over a metric stream as mergeable parts, one set for
each micro-batch. R3 — resume without re-emitting — is the checkpoint location
between batches and a commit record for each batch within them (``sinks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import arrays as AR
from ..functions import constants as K
from ..functions import text as T
from ..functions.rng import uniform
from ..operators import tokens as TK
from .sinks import WindowedMeters, merge_meters, partial_meters, start_committed

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


#: Bytes of shards that one micro-batch takes (at least one shard).
BATCH_BYTES = 64 << 30


def read_shard_stream(spark: SparkSession, path: str, schema: str, *, max_bytes_per_trigger: int = BATCH_BYTES) -> DataFrame:
    """Arriving Parquet shards as a stream (explicit schema, batches bounded by bytes)."""
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_trigger)
            .parquet(path))


def _dealt(docs: DataFrame) -> DataFrame:
    """Documents dealt to all tasks: a shard may be one row group, which a scan
    reads in one task, and every document becomes many rows."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lm_token_rows(docs: DataFrame, vocab: DataFrame, seq_len: int, max_len: int, keep: dict[str, Column] | None = None) -> DataFrame:
    """T1 + P6 + T5 in long form: ``(doc_id, pos, token_id)``; works on
    batch and streaming frames alike (no aggregation). ``keep``: columns found
    once for each document that its rows have too."""
    keep = keep or {}
    docs = docs.select(
        "doc_id", *[c.alias(n) for n, c in keep.items()], F.slice(T.tokens(F.col("text")), 1, max_len).alias("_toks"))  # tokenised once
    toks = F.col("_toks")
    bos, eos = F.array(F.lit(K.BOS_TOKEN)), F.array(F.lit(K.EOS_TOKEN))
    t = F.when(F.size(toks) == 0, bos).when(F.get(toks, 0) != F.lit(K.BOS_TOKEN), F.concat(bos, toks)) \
         .otherwise(toks)
    t = F.concat(t, eos)
    seq = F.slice(F.concat(t, F.array_repeat(F.lit(K.EOS_TOKEN), F.greatest(F.lit(seq_len) - F.size(t), F.lit(0)))),
                  1, seq_len)
    rows = AR.explode_rows(docs, ["doc_id", *keep], seq, out="token")
    return TK.encode_long(rows, vocab, "token", "token_id").drop("token")


def featurise(docs: DataFrame, vocab: DataFrame, *, seq_len: int = 512, max_len: int = 512,
              eps: float = 1e-3, seed: int = 0, rng: str = "fast") -> DataFrame:
    """R1 transformation: masked LM rows ``(doc_id, pos, token_id, noisy_id,
    p_mask, answer_len)`` (N4 with the all-ones attention mask, X7)."""
    p = (1.0 - eps) * uniform("t", "doc_id", seed=seed, rng=rng) + eps
    rows = lm_token_rows(docs, vocab, seq_len, max_len, {"p_mask": p})
    masked = uniform("mask", "doc_id", "pos", seed=seed, rng=rng) < F.col("p_mask")
    return (rows.select("doc_id", "pos", "token_id", "p_mask")
            .withColumn("noisy_id", F.when(masked, F.lit(K.MASK_ID)).otherwise(F.col("token_id")))
            .withColumn("answer_len", F.lit(int(seq_len))))


def start_featurise(spark: SparkSession, src: str, vocab: DataFrame, out: str, checkpoint: str, *,
                    seq_len: int = 512, max_len: int = 512, max_bytes_per_trigger: int = BATCH_BYTES,
                    rng: str = "fast", available_now: bool = True) -> StreamingQuery:
    """R1 + R3: start (or resume) the featurisation stream into Parquet."""
    stream = read_shard_stream(spark, src, DOCUMENT_SCHEMA, max_bytes_per_trigger=max_bytes_per_trigger)
    feats = featurise(_dealt(stream), vocab, seq_len=seq_len, max_len=max_len, rng=rng)
    w = feats.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.outputMode("append").start()


def windowed_meters(events: DataFrame, *, window: str = "1 hour", series: str = "event_type",
                    value: str = "value", ts: str = "ts") -> DataFrame:
    """R2 as a batch: per (series, event-time window) count, exact sum, mean and
    last value. ``ts`` without zone is read as UTC."""
    return merge_meters(partial_meters(events, window=window, series=series, value=value, ts=ts))


def start_windowed_meters(spark: SparkSession, src: str, out: str, checkpoint: str, *, window: str = "1 hour",
                          lateness: str = "2 hours", max_bytes_per_trigger: int = BATCH_BYTES) -> StreamingQuery:
    """R2 as a running job: every micro-batch commits its mergeable parts, so
    the meters are complete whatever order and size batches have
    (``sinks.WindowedMeters``)."""
    stream = read_shard_stream(spark, src, EVENT_SCHEMA, max_bytes_per_trigger=max_bytes_per_trigger)
    return WindowedMeters(out, window=window, lateness=lateness).start(stream, checkpoint)


def start_featurise_committed(spark: SparkSession, src: str, vocab: DataFrame, out: str, checkpoint: str, *, seq_len: int = 512,
                              max_len: int = 512, max_bytes_per_trigger: int = BATCH_BYTES, rng: str = "fast", hook=None) -> StreamingQuery:
    """R1 into committed batches (R3): a batch that fails half way gives each row once after a restart."""
    stream = read_shard_stream(spark, src, DOCUMENT_SCHEMA, max_bytes_per_trigger=max_bytes_per_trigger)
    return start_committed(featurise(_dealt(stream), vocab, seq_len=seq_len, max_len=max_len, rng=rng), out, checkpoint, hook=hook)
