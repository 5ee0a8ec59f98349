"""Parquet shard sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordering import running_sum
from ..session import checkpoint

_RANGE = re.compile(r"\{(\d+)\.\.(\d+)\}")


def expand_pattern(pattern: str) -> list[str]:
    """Expand numeric brace ranges ``{000..199}`` (zero padding kept), which
    Hadoop globs do not know; ``{a,b}`` lists and ``*`` are left to Spark."""
    m = _RANGE.search(pattern)
    if not m:
        return [pattern]
    lo, hi = m.group(1), m.group(2)
    width = len(lo) if lo.startswith("0") and len(lo) > 1 else 0
    out = []
    for i in range(int(lo), int(hi) + 1):
        out.extend(expand_pattern(pattern[:m.start()] + str(i).zfill(width) + pattern[m.end():]))
    return out


def shard_paths(patterns: str | Iterable[str]) -> list[str]:
    if isinstance(patterns, str):
        patterns = [patterns]
    paths: list[str] = []
    for p in patterns:
        paths.extend(expand_pattern(p))
    return sorted(dict.fromkeys(paths))


def read_shards(spark: SparkSession, patterns: str | Iterable[str], *, schema: StructType | str | None = None,
                ignore_corrupt: bool = False, with_file: bool = False) -> DataFrame:
    """One scan over every matching shard (directory, glob, brace range,
    list). A pattern that matches nothing raises; unreadable files are
    skipped only when ``ignore_corrupt``. ``with_file`` keeps the source
    file path (lineage, and the per-file order of the buffer shuffle)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if ignore_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
    df = reader.parquet(*shard_paths(patterns))
    if with_file:
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
    return df


def probe_files(spark: SparkSession, patterns: str | Iterable[str], *, pages: bool = False) -> DataFrame:
    """(file, rows, error) of every Parquet file that matches: its footer is
    read in a task, with ``pages`` all its data too. ``error`` is null where the file can be read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(shard_paths(patterns))
    # names as the driver's listing has them: a scan would leave out empty files
    files = spark.createDataFrame([(unquote(f),) for f in listing.inputFiles()], "path string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_probe(path, pages) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([n for n, _ in found], pa.int64()),
                                              pa.array([e for _, e in found], pa.string())], names=["file", "rows", "error"])

    return files.repartition(parts, "path").mapInArrow(probe, "file string, rows long, error string")


def _probe(path: str, pages: bool) -> tuple[int | None, str | None]:
    import pyarrow.parquet as pq

    from .tar import _arrow_fs
    filesystem, inner = _arrow_fs(path)
    with filesystem.open_input_file(inner) as raw:  # an error of the storage fails the task, which Spark tries again
        try:
            file = pq.ParquetFile(raw)
            for group in range(file.num_row_groups if pages else 0):
                for _ in file.iter_batches(row_groups=[group]):
                    pass
            return file.metadata.num_rows, None
        except (pa.ArrowException, OSError, EOFError) as error:
            return None, f"{type(error).__name__}: {error}".splitlines()[0]


def quarantine(spark: SparkSession, patterns: str | Iterable[str], *, schema: StructType | str | None = None,
               with_file: bool = False, pages: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """S1 with rejects: (rows of the files that can be read, (file, error) of
    those that cannot). A file gives all of its rows or none and a reject; the
    scan itself does not ignore errors, so none is lost unseen. The rows are None
    if no file can be read (and no schema is given)."""
    probed = checkpoint(probe_files(spark, patterns, pages=pages))
    good = [r.file for r in probed.where("error IS NULL").select("file").orderBy("file").toLocalIterator()]  # names only, as a scan lists them
    rejects = probed.where("error IS NOT NULL").select("file", "error")
    if good:
        return read_shards(spark, good, schema=schema, with_file=with_file), rejects
    return (spark.createDataFrame([], schema) if schema is not None else None), rejects


def limit_rows(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in a stated order (a distributed take-ordered;
    an unordered limit over many files is not repeatable)."""
    if not order_by:
        raise ValueError("limit_rows needs an order")
    return df.orderBy(*order_by).limit(int(n))


def write_records(df: DataFrame, path: str, *, mode: str = "errorifexists",
                  partition_by: Sequence[str] = (), max_records_per_file: int | None = None,
                  observation=None, metrics: Sequence[Column] = ()) -> None:
    """Parquet sink; optional ``partitionBy`` and file sizing. With an
    ``Observation``, ``metrics`` (default: the row count) are computed by the
    write itself — counters without a second pass over the data."""
    if observation is not None:
        df = df.observe(observation, *(metrics or [F.count(F.lit(1)).alias("written")]))
    w = df.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """The bytes of a row's values as text: what files are sized by."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`") if f.dataType.typeName() in ("string", "binary") else F.to_json(F.struct(f"`{f.name}`"))), F.lit(1))
            for f in df.schema.fields]
    return sum(wide[1:], wide[0])


def write_sized(df: DataFrame, path: str, order_by: Sequence[str], *, target_bytes: int = 256 << 20, mode: str = "errorifexists",
                size: Column | None = None) -> DataFrame:
    """S9 by bytes: files of about ``target_bytes`` of row bytes each, rows in
    ``order_by`` order (which must name rows uniquely) within and across files.

    A running sum over keys and sizes gives every row its file; the payload moves
    by key and then once to its file, one task a file. A file differs from the
    target by one row at most. Returns (file, rows, bytes) as planned."""
    sized = df.select(*order_by, (row_bytes(df) if size is None else size).alias("_bytes"))
    placed = running_sum(sized, list(order_by), F.col("_bytes"), out="_before")
    placed = checkpoint(placed.withColumn("_file", F.floor(F.col("_before") / int(target_bytes)).cast("int")).drop("_before"))
    files = (placed.agg(F.max("_file")).first()[0] or 0) + 1
    same = [df[c].eqNullSafe(placed[c]) for c in order_by]
    on = same[0]
    for more in same[1:]:
        on = on & more
    rows = df.join(placed, on).select(*[df[c] for c in df.columns], "_file")
    (rows.repartitionById(files, "_file").sortWithinPartitions(*order_by).drop("_file")
     .write.mode(mode).option("maxRecordsPerFile", 0).parquet(path))
    return placed.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes"))
