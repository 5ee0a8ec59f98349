"""Sinks that survive a failure inside a micro-batch, and meters kept through them.

A micro-batch is written to a folder of its own id and counts only once its
commit record exists. A batch that failed half way is run again by Spark with the
same id and the same rows: it overwrites its own folder, so every row is there
once. A batch whose record exists is left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import exact

BATCH = "batch_id"


class CommittedBatches:
    """A table of committed micro-batches under ``path``: ``<table>/batch_id=N`` folders and a commit record for each N."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _folder(self, table: str, batch_id: int) -> str:
        return f"{self.path}/{table}/{BATCH}={batch_id}"

    def _exists(self, spark: SparkSession, path: str) -> bool:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)

    def committed(self, spark: SparkSession, batch_id: int) -> bool:
        """A record is whole when its writer's success marker is there."""
        return self._exists(spark, self._folder("commits", batch_id) + "/_SUCCESS")

    def write(self, spark: SparkSession, batch_id: int, tables: dict[str, DataFrame], record: DataFrame | None = None) -> bool:
        """Writes a batch's tables, then its record (a row of anything worth
        keeping). False if the batch had been committed before."""
        if self.committed(spark, batch_id):
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(self._folder(name, batch_id))
        if record is None:
            record = spark.range(1).select(F.lit(0).alias("at"))
        record.write.mode("overwrite").parquet(self._folder("commits", batch_id))
        return True

    def records(self, spark: SparkSession) -> DataFrame:
        """The commit records with their batch ids."""
        return spark.read.option("basePath", f"{self.path}/commits").parquet(f"{self.path}/commits/{BATCH}=*")

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The rows of all committed batches; folders without a record are not read (the ids prune the scan)."""
        rows = spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}/{BATCH}=*")
        # a row a batch: bounded by the batches of a run
        return rows.join(F.broadcast(self.records(spark).select(BATCH)), BATCH, "left_semi")


def start_committed(stream: DataFrame, out: str, checkpoint: str, table: str = "rows",
                    hook: Callable[[int, str], None] | None = None) -> StreamingQuery:
    """Writes a stream to ``CommittedBatches(out)``. ``hook(batch_id, step)``
    is called before a batch, after its rows and after its record (tests let it fail)."""
    sink = CommittedBatches(out)

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if hook:
            hook(batch_id, "begin")
        if sink.committed(spark, batch_id):
            return
        rows.write.mode("overwrite").parquet(sink._folder(table, batch_id))
        if hook:
            hook(batch_id, "rows")
        sink.write(spark, batch_id, {})
        if hook:
            hook(batch_id, "commit")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------------- meters (R2)


def _windowed(events: DataFrame, window: str, series: str, value: str, ts: str) -> DataFrame:
    """series, window_start (seconds, zone-less wall clock read as UTC), value, ts and event_id."""
    tz = events.sparkSession.conf.get("spark.sql.session.timeZone")
    at = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    return events.select(F.col(series).alias("series"), F.col(value).cast("double").alias("value"), at.alias("ts"), "event_id") \
                 .withColumn("w", F.window("ts", window)) \
                 .select("series", F.unix_timestamp("w.start").alias("window_start"), F.unix_timestamp("w.end").alias("window_end"), "value", "ts", "event_id")


_KEY = ("series", "window_start")
_KEPT = (F.sum, "n")


def _last() -> object:
    return F.max(F.struct("ts", "event_id", "value")).alias("last")


def partial_meters(events: DataFrame, *, window: str = "1 hour", series: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """(series, window_start, bin, n, hi, lo, special, last): mergeable parts of the meters."""
    rows = _windowed(events, window, series, value, ts)
    return exact.bins(rows, _KEY, F.col("value"), [F.count(F.lit(1)).alias("n"), _last()])


def merge_meters(parts: DataFrame) -> DataFrame:
    """Parts of any batches -> one row for each (series, window): n, sum, avg, last."""
    rows = exact.merged(parts, _KEY, [F.sum("n").alias("n"), F.max("last").alias("last")])
    out = rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), exact.total("sum"), F.max("last").alias("last"))
    return out.select(*_KEY, "n", "sum", (F.col("sum") / F.col("n")).alias("avg"), F.col("last.value").alias("last"))


class WindowedMeters:
    """R2 as a table that is complete after every batch, in whatever order rows arrive.

    Each micro-batch commits its mergeable parts (one row for each series,
    window and exponent bin); ``current`` merges them. ``closed`` are the windows
    that the watermark (the greatest event time less the allowed lateness, kept
    in the commit records) has passed; ``finish`` moves it past the last window.
    A row whose window was closed before its batch is counted all the same and
    is listed in ``late``."""

    def __init__(self, out: str, *, window: str = "1 hour", lateness: str = "2 hours", series: str = "event_type", value: str = "value", ts: str = "ts"):
        self.sink = CommittedBatches(out)
        self.window, self.lateness = window, lateness
        self.names = {"series": series, "value": value, "ts": ts}

    def _watermark(self, spark: SparkSession, before: int | None = None) -> int | None:
        if not self.sink._exists(spark, f"{self.sink.path}/commits"):
            return None
        records = self.sink.records(spark)
        if before is not None:
            records = records.where(F.col(BATCH) < before)
        return records.agg(F.max("watermark")).first()[0]

    def add(self, events: DataFrame, batch_id: int) -> bool:
        """Commits a batch: its parts, its late rows and how far event time has come. A batch is read twice, never kept."""
        spark = events.sparkSession
        seen = self._watermark(spark, batch_id)
        rows = _windowed(events, self.window, **self.names)
        late = rows.where(F.lit(False) if seen is None else F.col("window_end") <= F.lit(seen))
        parts = partial_meters(events, window=self.window, **self.names)
        end = F.unix_timestamp(F.max("ts") - F.expr(f"INTERVAL {self.lateness}")).alias("watermark")
        tables = {"parts": parts, "late": late.select("series", "window_start", "value", "ts", "event_id")}
        return self.sink.write(spark, batch_id, tables, rows.agg(end))

    def finish(self, spark: SparkSession) -> None:
        """The closing event: no more rows are expected, so every window is closed."""
        batch = (self.sink.records(spark).agg(F.max(BATCH)).first()[0] or 0) + (1 << 40)
        self.sink.write(spark, batch, {}, spark.range(1).select(F.lit((1 << 62)).alias("watermark")))

    def current(self, spark: SparkSession) -> DataFrame:
        """The meters of all committed rows."""
        return merge_meters(self.sink.read(spark, "parts"))

    def closed(self, spark: SparkSession) -> DataFrame:
        """The meters of the windows that the watermark has passed."""
        end = self._watermark(spark)
        length = F.unix_timestamp(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {self.window}")) \
            - F.unix_timestamp(F.lit("1970-01-01 00:00:00").cast("timestamp"))
        return self.current(spark).where(F.col("window_start") + length <= F.lit(end if end is not None else -(1 << 62)))

    def late(self, spark: SparkSession) -> DataFrame:
        return self.sink.read(spark, "late")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def compact(sink: CommittedBatches, spark: SparkSession, group: Sequence[str] = _KEY) -> DataFrame:
    """Committed parts merged to one row for each key and bin, for a fresh table that replaces many small batches."""
    return exact.merged(sink.read(spark, "parts"), group, [F.sum("n").alias("n"), F.max("last").alias("last")])
