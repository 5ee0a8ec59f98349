"""Streaming = batch (R1, R2) and resume after restart without re-emitting."""

import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusprep.plans import inputs as I
from corpusprep.plans.queries_stream import r3_batch_failure
from corpusprep.session import table
from corpusprep.streaming import feeds as R
from corpusprep.streaming.sinks import WindowedMeters


def _tmp(name):
    return tempfile.mkdtemp(prefix=f"corpusprep-{name}-", dir="/tmp")


def test_restart_resumes_without_duplicates(spark, smoke_dir):
    docs = table(spark, smoke_dir, "documents")
    vocab = I.doc_vocab(spark, smoke_dir)
    src, out, ckpt = _tmp("src"), _tmp("out") + "/o", _tmp("ckpt") + "/c"
    parts = docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    ids = sorted(r[0] for r in docs.select("doc_id").collect())
    cut = ids[len(ids) // 2]
    # first two shards arrive, the job runs and stops
    parts.where(F.col("doc_id") < cut).write.mode("append").parquet(src)
    R.start_featurise(spark, src, vocab, out, ckpt, seq_len=64, max_len=64).awaitTermination()
    first = spark.read.parquet(out).count()
    # the rest arrives; the job restarts on the same checkpoint
    parts.where(F.col("doc_id") >= cut).write.mode("append").parquet(src)
    R.start_featurise(spark, src, vocab, out, ckpt, seq_len=64, max_len=64).awaitTermination()
    got = spark.read.parquet(out)
    # restarting again with nothing new adds nothing
    R.start_featurise(spark, src, vocab, out, ckpt, seq_len=64, max_len=64).awaitTermination()
    again = spark.read.parquet(out)
    batch = R.featurise(docs, vocab, seq_len=64, max_len=64)
    assert 0 < first < got.count()
    assert got.count() == again.count() == batch.count() == docs.count() * 64
    cols = ["doc_id", "pos", "token_id", "noisy_id", "p_mask", "answer_len"]
    assert got.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(got.select(cols)).count() == 0


def test_windowed_meters_equal_batch(spark, smoke_dir):
    ev = table(spark, smoke_dir, "events")
    src, out, ckpt = _tmp("ev"), _tmp("meters") + "/o", _tmp("ckpt2") + "/c"
    ev.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(src + "/in")
    R.start_windowed_meters(spark, src + "/in", out, ckpt).awaitTermination()
    meters = WindowedMeters(out)
    batch = R.windowed_meters(ev)
    got = meters.current(spark)
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0
    # open windows are those that the watermark, two hours behind the last event, has not passed
    last = ev.agg(F.unix_timestamp(F.max("ts").cast("timestamp"))).first()[0]
    closed = batch.where(F.col("window_start") + 3600 <= last - 7200)
    assert meters.closed(spark).exceptAll(closed).count() == closed.exceptAll(meters.closed(spark)).count() == 0
    meters.finish(spark)
    assert meters.closed(spark).count() == batch.count()


def _few_docs(spark, folder, n):
    docs = spark.createDataFrame([(k, f"word{k} in a text", "en", "web", 14) for k in range(n)], R.DOCUMENT_SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _watched(monkeypatch, also=lambda start, batch_id, step: None):
    """The failures that the hook of r3_batch_failure raises; ``also`` is called after it, with the number of the start."""
    start, starts, planned = R.start_featurise_committed, [], []

    def watched(*args, hook=None, **more):
        starts.append(len(starts))

        def both(batch_id, step):
            try:
                if hook:
                    hook(batch_id, step)
            except RuntimeError:
                planned.append(batch_id)
                raise
            also(starts[-1], batch_id, step)

        return start(*args, hook=both, **more)

    monkeypatch.setattr(R, "start_featurise_committed", watched)
    return planned


def test_failure_after_the_planned_one_is_no_result(spark, tmp_path, monkeypatch):
    """A restart that fails is raised; its committed batches alone are not the table."""
    def full(start, batch_id, step):
        if start == 1 and (batch_id, step) == (2, "begin"):
            raise OSError("no space left")

    _watched(monkeypatch, full)
    with pytest.raises(StreamingQueryException, match="no space left"):
        r3_batch_failure(spark, _few_docs(spark, tmp_path, 40))


@pytest.mark.parametrize(("n", "batch"), [(0, 0), (1, 0), (40, 1)])
def test_planned_failure_comes_on_any_table(spark, tmp_path, monkeypatch, n, batch):
    """A table of one shard, or of no rows, has its only batch fail; all rows are there once."""
    planned = _watched(monkeypatch)
    rows = r3_batch_failure(spark, _few_docs(spark, tmp_path, n))
    assert planned == [batch]
    assert rows.count() == rows.select("doc_id", "pos").distinct().count() == n * 512
