"""Reading one large text file in many tasks when its records may hold line breaks.

Files are cut into byte blocks. A first pass tells for each block how it changes
the reading state (inside quotes or not; the nesting depth of JSON) without
knowing the state before it; an ordered fold over the blocks' few numbers gives
every block its true state; a second pass then finds the record starts in each
block on its own. A record belongs to the block that holds the break before it;
that block is read on past its end as far as the record goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .tar import _arrow_fs

#: Bytes of a block, bytes read at once (past the block's end: fewer), and bytes of records handed on at once.
BLOCK_BYTES, READ_BYTES, TAIL_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 64 << 10, 8 << 20
QUOTE, NEWLINE, RETURN, BACKSLASH, COMMA = b'"\n\r\\,'


def blocks(spark: SparkSession, path: str | list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, length, block, at, end) of every block; empty files have none. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    last = F.floor((F.col("length") - 1) / block_bytes)
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    dealt = cut.select("path", "length", "block", (F.col("block") * block_bytes).alias("at"),
                       F.least((F.col("block") + 1) * block_bytes, F.col("length")).alias("end"))
    return _dealt(dealt)


def _dealt(cut: DataFrame) -> DataFrame:
    """Blocks dealt to all tasks. A block's row says little of the bytes behind
    it, so the number of tasks is given: rows this small would be put into one."""
    return cut.repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "block")


def _chunks(path: str, at: int, end: int, most: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a stretch of a file, a bounded read at a time. No read
    crosses ``end``; with ``most``, short ones follow up to there, as far as they are asked for."""
    filesystem, inner = _arrow_fs(path)
    with filesystem.open_input_file(inner) as f:
        f.seek(at)
        while at < (end if most is None else most):
            got = f.read(min(READ_BYTES, end - at) if at < end else min(TAIL_BYTES, most - at))
            if not got:
                return
            yield at, got
            at += len(got)


# ------------------------------------------------------------------ CSV (S3)


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        odd = [sum(got.count(b'"') for _, got in _chunks(r["path"], r["at"], r["end"])) % 2 for r in rows]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "length", "block", "at", "end")), pa.array(odd, pa.int64())],
                                         names=["path", "length", "block", "at", "end", "odd"])


def csv_blocks(cut: DataFrame) -> DataFrame:
    """The blocks with ``inside``: whether a quoted field is open at the block's
    start. Quotes are counted in each block; the parity of all before it is a
    running sum over one small row a block."""
    counted = checkpoint(cut.mapInArrow(_quotes, "path string, length long, block long, at long, end long, odd long"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return _dealt(counted.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).drop("odd"))


def _line_ends(got: bytes, inside: int) -> tuple[np.ndarray, int]:
    """Places of line breaks outside quotes, and the parity after the bytes."""
    data = np.frombuffer(got, np.uint8)
    quoted = (np.cumsum(data == QUOTE) + inside) % 2
    return np.flatnonzero((data == NEWLINE) & (quoted == 0)), int(quoted[-1])


def csv_records_of(path: str, at: int, end: int, inside: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records of a block."""
    started = at == 0
    start, held = (0, []) if started else (None, None)
    place = at
    for offset, got in _chunks(path, at, end, length):
        breaks, inside = _line_ends(got, inside)
        low = 0
        for b in breaks.tolist():
            if started:
                held.append(got[low:b])
                yield start, b"".join(held)
            place = offset + b + 1
            # the record after a break belongs to the block that the break is in
            if place > end or place >= length:
                return
            started, start, held, low = True, place, [], b + 1
        if started:
            held.append(got[low:])
        elif offset + len(got) >= end:  # the block lies within one record
            return
    if started and held:
        yield start, b"".join(held)


def _emit(read: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held: list[tuple[int, bytes]] = []
                size = 0
                for at, record in read(r):
                    held.append((at, record))
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield _records(r["path"], held)
                        held, size = [], 0
                if held:
                    yield _records(r["path"], held)

    return run


def _records(path: str, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    texts = [x.decode("utf-8", "replace") for _, x in held]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array([at for at, _ in held], pa.int64()),
                                       pa.array(texts, pa.string())], names=["path", "at", "record"])


def csv_records(spark: SparkSession, path: str | list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, at, record): every record of CSV files as text, wherever its quoted
    line breaks are; blank lines are left out. Quotes are escaped by doubling."""
    def read(r: dict) -> Iterator[tuple[int, bytes]]:
        for at, record in csv_records_of(r["path"], r["at"], r["end"], r["inside"], r["length"]):
            record = record.removesuffix(b"\r")
            if record:
                yield at, record

    return csv_blocks(blocks(spark, path, block_bytes)).mapInArrow(_emit(read), "path string, at long, record string")


# ----------------------------------------------------------- JSON array

#: Reading states at a place: outside strings, inside one, inside one after a backslash.
OUT, IN, ESCAPED = 0, 1, 2


def _escapes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Which bytes stand after an odd run of backslashes (the byte before the data being one of them if ``escaped``)."""
    slash = data == BACKSLASH
    n = len(data)
    place = np.arange(n)
    # where the run of backslashes that ends before each byte begins
    last_other = np.maximum.accumulate(np.where(~slash, place, -1))
    before = np.concatenate([[-1], last_other[:-1]])
    run = place - 1 - before
    lead = before == -1
    if escaped:
        # the very first byte is taken by the backslash before it: it neither escapes nor ends a string
        run = np.where(lead & slash[0], run - 1, run) if n else run
        run[0] = 1
    return run % 2 == 1


def json_scan(got: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(depth change at each byte, whether the byte is outside strings, state after)."""
    data = np.frombuffer(got, np.uint8)
    taken = _escapes(data, state == ESCAPED)
    # backslashes count inside strings only; outside them valid JSON has none
    quote = (data == QUOTE) & ~taken
    inside = (np.cumsum(quote) + (state != OUT)) % 2
    outside = (inside == 0) & ~quote
    opens = outside & ((data == 0x5B) | (data == 0x7B))
    closes = outside & ((data == 0x5D) | (data == 0x7D))
    end = OUT if inside[-1] == 0 else ESCAPED if data[-1] == BACKSLASH and not taken[-1] else IN
    return opens.astype(np.int64) - closes, outside, end


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each of the states before a block: the state after it and how much deeper it is then."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            ways = [[s, 0] for s in (OUT, IN, ESCAPED)]
            for _, got in _chunks(r["path"], r["at"], r["end"]):
                told: dict[int, tuple[int, int]] = {}
                for way in ways:
                    # what a backslash takes matters only if it is a quote or a backslash
                    state = IN if way[0] == ESCAPED and got[0] not in (QUOTE, BACKSLASH) else way[0]
                    if state not in told:
                        change, _, after = json_scan(got, state)
                        told[state] = int(change.sum()), after
                    way[0], way[1] = told[state][1], way[1] + told[state][0]
            out.append([x for way in ways for x in way])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "length", "block", "at", "end")), pa.array(out, pa.list_(pa.int64()))],
                                         names=["path", "length", "block", "at", "end", "ways"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole files in order -> state and depth at the start of each; what is kept is one state."""
    path, state, depth = None, OUT, 0
    for batch in batches:
        states, depths = [], []
        for name, ways in zip(batch.column("path").to_pylist(), batch.column("ways").to_pylist(), strict=True):
            if name != path:
                path, state, depth = name, OUT, 0
            states.append(state)
            depths.append(depth)
            state, depth = ways[2 * state], depth + ways[2 * state + 1]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "length", "block", "at", "end")), pa.array(states, pa.int64()), pa.array(depths, pa.int64())],
                                         names=["path", "length", "block", "at", "end", "state", "depth"])


def json_blocks(cut: DataFrame) -> DataFrame:
    """The blocks with ``state`` and ``depth`` at their start: an ordered fold of one small row a block."""
    told = checkpoint(cut.mapInArrow(_summaries, "path string, length long, block long, at long, end long, ways array<long>"))
    ordered = told.repartition("path").sortWithinPartitions("path", "block")
    return _dealt(ordered.mapInArrow(_fold, "path string, length long, block long, at long, end long, state long, depth long"))


def json_items_of(path: str, at: int, end: int, state: int, depth: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the items of a top-level array that start in a block.

    An item starts after the array's opening bracket or a comma at depth 1."""
    started, start, held = False, None, []
    for offset, got in _chunks(path, at, end, length):
        data = np.frombuffer(got, np.uint8)
        change, outside, state = json_scan(got, state)
        after = depth + np.cumsum(change)
        comma = outside & (data == COMMA) & (after == 1)
        opened = (change == 1) & (after == 1)
        closed = (change == -1) & (after == 0)
        low = 0
        for b in np.flatnonzero(comma | opened | closed).tolist():
            if started:
                held.append(got[low:b])
                yield start, b"".join(held)
                started, held = False, []
            place = offset + b + 1
            if place > end:
                return
            if not closed[b]:
                started, start, low = True, place, b + 1
        if started:
            held.append(got[low:])
        elif offset + len(got) >= end:
            return
        depth = int(after[-1])
    if started and held:
        yield start, b"".join(held)


def json_items(spark: SparkSession, path: str | list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, at, record): every item of files that are one JSON array, as text."""
    def read(r: dict) -> Iterator[tuple[int, bytes]]:
        for at, record in json_items_of(r["path"], r["at"], r["end"], r["state"], r["depth"], r["length"]):
            if record.strip():
                yield at, record.strip()

    return json_blocks(blocks(spark, path, block_bytes)).mapInArrow(_emit(read), "path string, at long, record string")
