"""Tar shards -> samples (S7) and sample key filtering.

Only reading tar files needs Python: headers are listed, one task a shard, and
payloads read by stretches of a shard, a bounded batch at a time. Grouping
members into samples is a plan over their names. A sample is a run of neighbouring members of one key, cut again
where a suffix comes back. Names without an extension are skipped; suffixes
are lower-cased; suffixes outside an allow-list are dropped and cut nothing.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# FIXED VALUE: "dir/name.ext.more" is the key "dir/name" and the suffix "ext.more".
NAME_RE = r"^((?:.*/|)[^.]+)[.]([^/]*)$"
#: Bytes of members that a task hands on at once, bytes of a shard that go to one task, and headers handed on at once.
BATCH_BYTES, STRETCH_BYTES, INDEXED = 32 << 20, 64 << 20, 10_000
#: Shards whose headers one task lists, where there are more shards than tasks.
SHARDS_A_TASK = 64
#: Times the tasks that members of small shards are dealt to at most, so that hashing spreads them.
WAVES = 4


def split_name(fname: Column) -> tuple[Column, Column]:
    """Key and suffix of a member name (NULL key: no extension)."""
    named = fname.rlike(NAME_RE)
    return (F.when(named, F.regexp_extract(fname, NAME_RE, 1)), F.when(named, F.regexp_extract(fname, NAME_RE, 2)))


def _cut_numbers(suffixes: Column) -> Column:
    """For each member of a run, how many suffixes came back up to it, counting
    anew from every cut. A NULL suffix (not wanted) cuts nothing."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        again = F.coalesce(F.array_contains(s["seen"], x), F.lit(False))
        n = s["n"] + again.cast("int")
        here = F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x))
        return F.struct(n.alias("n"), F.when(again, here).otherwise(F.concat(s["seen"], here)).alias("seen"),
                        F.concat(s["out"], F.array(n)).alias("out"))

    return F.aggregate(suffixes, start, step)["out"]


def group_samples(members: DataFrame, *, url: str = "url", idx: str = "idx", fname: str = "fname",
                  data: str = "data", lcase: bool = True, suffixes: Iterable[str] | None = None) -> DataFrame:
    """S7 over a member table ``(url, idx, fname, data)`` -> ``(url,
    sample_no, key, suffixes, data map)``.

    Members are partitioned by shard once; runs (gaps and islands over the
    key), cuts within a run and sample numbers all use that partitioning. A
    run is gathered into one row, so a row holds the members of one key run."""
    key, suffix = split_name(F.col(fname))
    if lcase:
        suffix = F.lower(suffix)
    if suffixes is not None:
        suffix = F.when(suffix.isin(*suffixes), suffix)
    named = members.select(F.col(url).alias("url"), F.col(idx).alias("_i"), key.alias("key"), suffix.alias("_s"),
                           F.col(data).alias("_d")).where(F.col("key").isNotNull())
    along = Window.partitionBy("url").orderBy("_i")
    opens = F.coalesce(F.lag("key").over(along) != F.col("key"), F.lit(True))
    runs = (named.withColumn("_new", opens.cast("long"))
            .withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("url", "_run", "key").agg(F.array_sort(F.collect_list(F.struct("_i", "_s", "_d"))).alias("_m")))
    runs = runs.withColumn("_k", _cut_numbers(F.transform("_m", lambda m: m["_s"])))
    earlier = Window.partitionBy("url").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_n", F.array_max("_k") + 1).withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    each = runs.select("url", "key", "_first", F.arrays_zip("_m", "_k").alias("_z"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_c"))
    own = F.transform(F.filter("_z", lambda z: (z["_k"] == F.col("_c")) & z["_m"]["_s"].isNotNull()), lambda z: z["_m"])
    each = each.withColumn("_own", own)
    return each.select("url", (F.col("_first") + F.col("_c")).cast("long").alias("sample_no"), "key",
                       F.transform("_own", lambda m: m["_s"]).alias("suffixes"),
                       F.map_from_entries(F.transform("_own", lambda m: F.struct(m["_s"], m["_d"]))).alias("data"))


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path) of every shard, dealt to tasks; contents are not read. Tasks must
    not grow with the shards one for one: those of the exchanges after them would
    meet in pairs."""
    listing = spark.read.format("binaryFile").load(paths).select("path")
    files, _, tasks = _extent(spark, paths)
    return listing.repartition(max(1, min(files, max(tasks, -(-files // SHARDS_A_TASK)))), "path")


def _extent(spark: SparkSession, paths: str | list[str]) -> tuple[int, int, int]:
    """(shards, their bytes, tasks of an exchange); contents are not read."""
    files, size = spark.read.format("binaryFile").load(paths).agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return files, size, int(spark.conf.get("spark.sql.shuffle.partitions"))


def index_members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tar files -> ``(url, idx, fname, offset, size, damaged)``, members in file order.

    Only headers are read, payloads are skipped. Members of plain tar files have
    the offset of their payload; those of compressed ones, which cannot be read
    from the middle, have none. A damaged tail ends its shard with one row that
    has ``damaged`` set; an error of the storage fails the task, which Spark tries
    again."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                held: list[tuple] = []
                for row in _headers(path):
                    held.append(row)
                    if len(held) >= INDEXED:
                        yield pd.DataFrame(held, columns=columns).astype(kinds)
                        held = []
                yield pd.DataFrame(held, columns=columns).astype(kinds)

    columns = ["url", "idx", "fname", "offset", "size", "damaged"]
    kinds = {"idx": "int64", "offset": "Int64", "size": "Int64", "damaged": "bool"}
    return _listed(spark, paths).mapInPandas(run, "url string, idx long, fname string, offset long, size long, damaged boolean")


def _headers(path: str) -> Iterator[tuple[str, int, str, int | None, int | None, bool]]:
    """The regular files of one tar: (url, idx, name, payload offset, size, damaged)."""
    filesystem, inner = _arrow_fs(path)
    with filesystem.open_input_file(inner) as raw:
        length, n = raw.size(), 0
        try:
            tar = tarfile.open(fileobj=raw, mode="r:")
        except (tarfile.TarError, EOFError):
            tar = None
        if tar is not None:
            try:
                for info in tar:
                    if info.isfile():
                        if info.offset_data + info.size > length:
                            yield path, n, "", None, None, True
                            return
                        yield path, n, info.name, info.offset_data, info.size, False
                        n += 1
                    tar.members = []  # headers are not kept
            except (tarfile.TarError, EOFError):
                yield path, n, "", None, None, True
            return
    with filesystem.open_input_stream(inner) as raw:  # compressed, or no tar at all
        for url, idx, name, data, damaged in _members(raw, path):
            yield url, idx, name, None, None if damaged else len(data), damaged


def _dealt(rows: DataFrame, offset: Column, paths: str | list[str], waves: int = 1) -> DataFrame:
    """Rows dealt to tasks by stretches of their shard, in file order; as many
    tasks as shards at least, unless they are smaller than a stretch: then as many
    as stretches, or ``waves`` times the tasks of an exchange."""
    stretch = F.coalesce(F.floor(offset / STRETCH_BYTES), F.lit(0))
    files, size, tasks = _extent(rows.sparkSession, paths)
    parts = max(tasks, min(files, max(-(-size // STRETCH_BYTES), waves * tasks)))
    return rows.withColumn("_at", offset).withColumn("_part", stretch).repartition(parts, "url", "_part").sortWithinPartitions("url", "_part", "_at")


class _Payloads:
    """Reads payloads of members; keeps the file it read last open. Members of a
    compressed shard come from reading it on from where it stands."""

    def __init__(self):
        self.url = self.file = self.rows = None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.url = self.file = self.rows = None

    def read(self, url: str, idx: int, offset: int | None, size: int) -> bytes:
        if offset is not None:
            if url != self.url or self.rows is not None:
                self.close()
                filesystem, inner = _arrow_fs(url)
                self.url, self.file = url, filesystem.open_input_file(inner)
            self.file.seek(offset)
            return self.file.read(size)
        if url != self.url or self.rows is None or idx < self.next:
            self.close()
            filesystem, inner = _arrow_fs(url)
            self.url, self.file, self.next = url, filesystem.open_input_stream(inner), 0
            self.rows = _members(self.file, url)
        for _, n, _, data, _ in self.rows:
            self.next = n + 1
            if n == idx:
                return data
        raise EOFError(f"{url} has no member {idx}")


def read_members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tar files -> ``(url, idx, fname, data, damaged)``. Headers are listed
    first; payloads are then read by stretches of each shard, so that one large
    shard keeps all tasks busy."""
    columns = ["url", "idx", "fname", "data", "damaged"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        payloads, held, bytes_ = _Payloads(), [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                data = None if r.damaged else payloads.read(r.url, int(r.idx), _int(r.offset), int(r.size))
                held.append((r.url, int(r.idx), r.fname, data, bool(r.damaged)))
                bytes_ += len(data or b"")
                if bytes_ >= BATCH_BYTES:
                    yield pd.DataFrame(held, columns=columns)
                    held, bytes_ = [], 0
        payloads.close()
        yield pd.DataFrame(held, columns=columns)

    index = _dealt(index_members(spark, paths), F.coalesce(F.col("offset"), F.lit(0)), paths, WAVES).sortWithinPartitions("url", "idx")
    return (index.select("url", "idx", "fname", "offset", "size", "damaged")
            .mapInPandas(run, "url string, idx long, fname string, data binary, damaged boolean"))


def _int(x) -> int | None:
    return None if x is None or x != x else int(x)


def read_tar_samples(spark: SparkSession, paths: str | list[str], *, lcase: bool = True,
                     suffixes: Iterable[str] | None = None) -> DataFrame:
    """S7 end to end: ``(url, sample_no, key, suffixes, data map)``; shards that
    end early are listed by ``index_members``.

    Members are grouped to samples by their names alone. A sample's payloads are
    then read in the task that gets it, by stretches of the shard: no payload is
    ever exchanged, sorted or held in a window."""
    where = F.struct("idx", "offset", "size")
    index = index_members(spark, paths).where("NOT damaged").select("url", "idx", "fname", where.alias("data"))
    samples = group_samples(index, lcase=lcase, suffixes=suffixes)
    places = F.transform("suffixes", lambda s: F.try_element_at("data", s))
    rows = samples.select("url", "sample_no", "key", "suffixes", places.alias("places"))
    first = F.coalesce(F.array_min(F.transform("places", lambda p: p["offset"])), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads, out, held = _Payloads(), [], 0
        for batch in batches:
            for r in batch.to_pylist():
                read = [(s, payloads.read(r["url"], p["idx"], p["offset"], p["size"])) for s, p in zip(r["suffixes"], r["places"], strict=True)]
                out.append({k: r[k] for k in ("url", "sample_no", "key", "suffixes")} | {"data": read})
                held += sum(len(x) for _, x in read)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        payloads.close()
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("url", pa.string()), ("sample_no", pa.int64()), ("key", pa.string()), ("suffixes", pa.list_(pa.string())),
                        ("data", pa.map_(pa.string(), pa.binary()))])
    dealt = _dealt(rows, first, paths).sortWithinPartitions("url", "sample_no").select("url", "sample_no", "key", "suffixes", "places")
    return dealt.mapInArrow(run, "url string, sample_no long, key string, suffixes array<string>, data map<string,binary>")


def _arrow_fs(path: str):
    """(filesystem, path) of a full URI via pyarrow.fs."""
    from pyarrow import fs as pafs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI; without a scheme it lies in the cluster's default file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _members(raw, url: str) -> Iterator[tuple[str, int, str, bytes | None, bool]]:
    """The regular files of one tar stream."""
    n = 0
    try:
        with tarfile.open(fileobj=io.BufferedReader(raw), mode="r|*") as tar:
            for info in tar:
                if info.isfile():
                    yield url, n, info.name, tar.extractfile(info).read(), False
                    n += 1
    except (tarfile.TarError, EOFError):
        yield url, n, "", None, True


def filter_keys(sample_map: Column, keys: Iterable[str]) -> Column:
    """Keep only the given keys of a sample map."""
    ks = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(sample_map, lambda k, v: F.array_contains(ks, k))


def write_tar_shards(members: DataFrame, folder: str, *, shard: str = "shard", idx: str = "idx",
                     fname: str = "fname", data: str = "data") -> DataFrame:
    """Write member rows as tar files ``<folder>/shard-<n>.tar`` (one task per
    shard, members in ``idx`` order); returns ``(shard, path, members)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid
        cur, out, tf, n, path, filesystem, inner, tmp = None, None, None, 0, None, None, None, None

        def close():
            # a retried or speculative attempt writes its own temp file; the
            # rename publishes a complete shard (same content every attempt)
            tf.close()
            out.close()
            filesystem.move(tmp, inner)
            return pd.DataFrame({"shard": [int(cur)], "path": [path], "members": [n]})

        # rows arrive sorted by (shard, idx); a shard may span several batches
        for b in batches:
            for s, name, payload in zip(b[shard], b[fname], b[data]):
                if s != cur:
                    if cur is not None:
                        yield close()
                    cur, n = s, 0
                    path = f"{folder.rstrip('/')}/shard-{int(s):05d}.tar"
                    filesystem, inner = _arrow_fs(path)
                    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    tmp = f"{inner}.{uuid.uuid4().hex}.tmp"
                    out = filesystem.open_output_stream(tmp)
                    tf = tarfile.open(fileobj=out, mode="w|")
                info = tarfile.TarInfo(name)
                info.size = len(payload)
                tf.addfile(info, io.BytesIO(payload))
                n += 1
        if cur is not None:
            yield close()

    folder = _qualified(members.sparkSession, folder)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given: small members take long for their bytes
    ordered = members.select(shard, idx, fname, data).repartition(parts, shard).sortWithinPartitions(shard, idx)
    return ordered.mapInPandas(run, "shard long, path string, members long")
