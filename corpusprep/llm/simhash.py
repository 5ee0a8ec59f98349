"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``distance`` bits agree closely on some
part of the bits, however the bits are dealt to parts, as long as the parts'
own thresholds sum to ``distance - parts + 1``. Correlated bits go to the same
part, and dynamic programming gives each part the threshold that costs least by
estimated candidates, so that skewed parts may be skipped. Fingerprints are
probed by part, candidates verified on all bits and linked ones joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import SPACES, let, null_last, slices, words
from .components import components

SHINGLE, DISTANCE, BITS = 3, 2, 64
#: Numbers of parts that the plan is chosen from.
PARTS = (2, 3)
#: A probe bucket with more fingerprints is linked by midpoints instead of pairs.
PAIRED = 32
#: Hashes unpacked at once.
CHUNK = 1 << 16


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every shingle of the lower-cased text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.coalesce(text, F.lit("")), upper + SPACES[1:], upper.lower() + " " * (len(SPACES) - 1))

    def hashes(w):
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)),
                           lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(size)), " ")))
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= size, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(words(lowered), hashes)


def _majority(hashes: pa.ListArray) -> np.ndarray:
    offsets = hashes.offsets.to_numpy()
    sizes = np.diff(offsets)
    counts = np.zeros((len(sizes), BITS), np.int64)
    flat = hashes.values.to_numpy()[offsets[0]:offsets[-1]].astype("<i8", copy=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(flat), CHUNK):
        bits = np.unpackbits(flat[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row = rows[at:at + CHUNK]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        counts[row[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    ones = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(ones).view("<i8").ravel()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): a bit is set if more than half of the
    shingles' hashes set it; null texts and texts without words have
    fingerprint zero. Whole texts are read; counts of 64 bits stand for any
    number of shingles."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(_majority(batch.column("h")), pa.int64())],
                                             names=["doc_id", "text_hash", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
                        shingle_hashes(F.col(text_col), shingle).alias("h"))
            .mapInArrow(rows, "doc_id long, text_hash long, fp long"))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for how many each two bits are both set."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both, n = both + x.T @ x, n + len(x)
        yield pd.DataFrame({"i": np.append(np.repeat(np.arange(BITS), BITS), -1),
                            "j": np.append(np.tile(np.arange(BITS), BITS), -1), "n": np.append(both.ravel(), n).astype(np.int64)})

    got = fps.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((BITS, BITS)), 0
    for r in got:
        if r.i < 0:
            total = r.n
        else:
            both[r.i, r.j] = r.n
    return total, both


def correlated_parts(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits dealt to ``parts`` of even width, each grown around the bits
    that correlate most with those it has."""
    n = max(total, 1)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(link, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        part = [max(sorted(left), key=lambda b: link[b, sorted(left)].sum())]
        left.remove(part[0])
        while len(part) < width:
            best = max(sorted(left), key=lambda b: link[b, part].mean())
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def _value(fp: Column, part: list[int]) -> Column:
    mask = sum(1 << b for b in part)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _flip(bits: tuple[int, ...]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def allocate(parts: list[list[int]], exact: list[int], agree: np.ndarray, total: int, distance: int) -> tuple[float, list[int]]:
    """The thresholds, -1 (skip) or more, that sum to ``distance - parts + 1``
    at least cost, and the cost: candidate pairs and probe rows.

    ``exact`` has the pairs that agree on a whole part. Of pairs that miss by
    t bits there are estimated to be so many times more by the odds with which
    two fingerprints differ in the part's single bits."""
    goal = distance - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part, pairs in zip(parts, exact, strict=True):
        odds = [(1 - agree[b]) / max(agree[b], 1e-9) for b in part]
        missing = np.zeros(distance + 1)
        missing[0] = 1
        for x in odds:  # elementary symmetric sums
            missing[1:] += missing[:-1] * x
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                added = 0.0 if t < 0 else (pairs + 1) * missing[:t + 1].sum() + total * sum(comb(len(part), k) for k in range(t + 1))
                state = spent + t
                if state not in new or cost + added < new[state][0]:
                    new[state] = (cost + added, [*chosen, t])
        best = new
    return best[goal]


def choose(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the cheapest parts, from counts over all fingerprints."""
    total, both = bit_statistics(fps)
    if distance < min(PARTS) - 1 or not total:
        return [(list(range(BITS)), distance)]
    p = np.diag(both) / total
    agree = p * p + (1 - p) * (1 - p)
    plans = [correlated_parts(total, both, k) for k in PARTS if k <= distance + 1]
    every = [part for plan in plans for part in plan]
    values = F.array(*[F.struct(F.lit(i).alias("part"), _value(F.col("fp"), part).alias("v")) for i, part in enumerate(every)])
    counts = (fps.select(F.explode(values).alias("x")).groupBy("x.part", "x.v").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect())
    pairs, options, at = {r.part: int(r.pairs) for r in counts}, [], 0
    for plan in plans:
        cost, thresholds = allocate(plan, [pairs.get(at + i, 0) for i in range(len(plan))], agree, total, distance)
        options.append((cost, [(b, t) for b, t in zip(plan, thresholds, strict=True) if t >= 0]))
        at += len(plan)
    return min(options, key=lambda x: x[0])[1]


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b) of distinct fingerprints such that those within ``distance``
    bits are connected, directly or by others within it.

    Small buckets give all their verified pairs. In a larger one pairs would
    grow with its square, so every fingerprint there names its midpoints
    instead, all values up to distance / 2 bits away: two within ``distance``
    share one, two that share one are within it, and each is linked to the
    smallest at its midpoint. (An odd distance pairs midpoints of its lower
    half with those of its upper half, see ``_midpoints``.)"""
    rows = []
    for i, (part, t) in enumerate(choose(fps, distance)):
        flips = [_flip(c) for k in range(t + 1) for c in combinations(part, k)]
        rows.append(fps.select(F.lit(i).alias("part"), "fp", _value(F.col("fp"), part).alias("own"), F.explode(F.array(*map(F.lit, flips))).alias("flip"))
                    .select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("v"), "fp", (F.col("flip") == 0).alias("exact")))
    probes = rows[0]
    for more in rows[1:]:
        probes = probes.unionByName(more)
    probes = checkpoint(probes)
    sizes = (probes.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n"), F.max("exact").alias("met"))
             .where("n > 1 AND met").select("part", "v", (F.col("n") > PAIRED).alias("large")))
    met = checkpoint(probes.join(sizes, ["part", "v"]))
    small = met.where("NOT large").select("part", "v", "fp", "exact")
    a, b = small.alias("a"), small.where("exact").alias("b")
    pairs = (a.join(b, [F.col("a.part") == F.col("b.part"), F.col("a.v") == F.col("b.v")])
             .where("a.fp <> b.fp").where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
             .select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")))
    return pairs.unionByName(_midpoints(met.where("large").select("fp").distinct(), distance)).distinct()


def _midpoints(fps: DataFrame, distance: int) -> DataFrame:
    """Links by midpoints: (member, smallest member) of each.

    For an even distance all members of a midpoint are within it of each
    other. For an odd one, members up to its lower half away are, and those one
    further are linked to the smallest of the nearer ones."""
    low, odd = distance // 2, distance % 2
    flips = [(_flip(c), k) for k in range(low + odd + 1) for c in combinations(range(BITS), k)]
    ways = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(k > low).alias("far")) for x, k in flips])
    hubs = fps.select("fp", F.explode(ways).alias("w")).select("fp", F.col("fp").bitwiseXOR(F.col("w.x")).alias("hub"), "w.far")
    least = (hubs.groupBy("hub").agg(F.min(F.when(~F.col("far"), F.col("fp"))).alias("least"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 AND least IS NOT NULL").drop("n"))
    return (hubs.join(least, "hub").where("fp <> least")
            .select(F.least("fp", "least").alias("a"), F.greatest("fp", "least").alias("b")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_hash, fp (long), component_id (the smallest id reachable
    over links of at most ``distance`` differing bits) and stays (the row, or
    one of the equal rows, that stands for its component).

    Equal fingerprints are grouped before anything is compared, so copies cost
    a count. Null ids take part but name no component (null if it has no other
    id); repeated rows repeat; an empty table gives no rows; other columns are
    ignored."""
    marked = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    fps = checkpoint(marked.groupBy("fp").agg(F.min(F.struct(null_last("doc_id", 0).alias("id"), "text_hash")).alias("first")))
    found = components(links(fps, distance))
    joined = fps.join(found, fps.fp == found.node, "left")
    grouped = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    named = joined.join(grouped, "component", "left").select("fp", F.coalesce("least", "first").alias("least"))
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", F.when(~F.col("least.id.n"), F.col("least.id.v")).alias("component_id"),
                                           (F.struct(null_last("doc_id", 0).alias("id"), "text_hash") == F.col("least")).alias("stays"))


def representatives(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id (null
    ids last), of rows that share this id that of the smallest text hash, of
    rows equal in both any one. Texts move once, by id and text hash."""
    marked = near_duplicates(docs, shingle=shingle, distance=distance)
    keep = marked.where("stays").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("_id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_hash"))
    same = rows["_id"].eqNullSafe(keep["_id"]) & (rows["_hash"] == keep["_hash"])
    return rows.join(keep, same, "left_semi").dropDuplicates(["_id", "_hash"]).select("doc.*")
