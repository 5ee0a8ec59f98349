"""Sharding by histogram sort: exact byte quantiles, then one exchange.

Documents are ordered by (hash of the text, id), so equal texts stay side by
side. Candidate boundaries are probed: one aggregation counts the exact bytes
and rows between neighbouring probes and draws a few keys of each stretch. Only
stretches that hold a wanted splitter are probed again, at the drawn keys,
until every splitter is within tolerance or no key is left between two probes.
Documents then move once, to the range that the splitters give them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import null_last
from .ranges import range_of

SHARDS = 24
#: Bytes that count for a document beside its text.
OVERHEAD = 8
#: A splitter may miss its place by this share of a shard.
TOLERANCE = 0.001
#: Keys drawn from a stretch for the next round, rounds at most (each narrows a stretch about 17 times).
DRAWN, ROUNDS = 16, 40
#: Ranges inside a shard for each shuffle partition: a shard is numbered in pieces, as even as this share of one.
PIECES, PIECE_TOLERANCE = 4, 0.25


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _order(k: Row) -> tuple:
    return k.h, k.id.n, k.id.v


def histogram_splitters(keys: DataFrame, parts: int, tolerance: float) -> list[Row]:
    """``parts - 1`` keys (fewer if keys run out) that cut the rows of (k,
    size) into parts of equal bytes, each within ``tolerance`` of a part.

    Between rounds the driver holds a row for each stretch that still matters
    and its drawn keys: at most ``parts * (DRAWN + 1)``."""
    probes: list[Row] = []
    below = {}  # exact bytes of the keys that come before a probe
    draws = [F.min_by("k", F.xxhash64("k", F.lit(j))).alias(f"d{j}") for j in range(DRAWN)]
    total = None
    for _ in range(ROUNDS):
        found = (keys.groupBy(range_of(probes, F.col("k")).alias("at"))
                 .agg(F.sum("size").alias("bytes"), F.min("k").alias("least"), *draws).collect())
        stretch = {r["at"]: r for r in found}
        before, edges = 0, []
        for at in range(len(probes) + 1):
            edges.append(before)
            if at:
                below[_order(probes[at - 1])] = before
            before += stretch[at].bytes if at in stretch else 0
        total = before
        if not total:
            return []
        wanted = [total * i / parts for i in range(1, parts)]
        slack, fresh = tolerance * total / parts, {}
        for want in wanted:
            at = max(bisect_left(edges, want) - 1, 0)
            while at not in stretch:
                at += 1
            start, end = edges[at], edges[at] + stretch[at].bytes
            if min(want - start if at else want, end - want) <= slack and (start or end):
                continue
            # the keys drawn cut the stretch; its least key would cut off nothing
            for key in (stretch[at][f"d{j}"] for j in range(DRAWN)):
                if _order(key) != _order(stretch[at].least):
                    fresh[_order(key)] = key
        fresh = {o: k for o, k in fresh.items() if o not in below}
        if not fresh:
            break
        # probes that no splitter needs any more go, so the table stays small
        near = set()
        for want in wanted:
            at = bisect_left(edges, want)
            near |= {a for a in (at - 1, at) if 0 < a <= len(probes)}
        probes = sorted([*fresh.values(), *(probes[a - 1] for a in near)], key=_order)
    ordered = [(below[_order(p)], p) for p in probes if _order(p) in below]
    cuts = {}
    for want in wanted:
        if ordered:
            _, p = min(ordered, key=lambda x: abs(x[0] - want))  # noqa: B023
            cuts[_order(p)] = p
    return [cuts[o] for o in sorted(cuts)]


def shard(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text",
          tolerance: float = TOLERANCE) -> DataFrame:
    """``doc`` (the whole input row), ``size``, ``text_crc32``, ``law``,
    ``shard``, ``slot`` and ``grown_shard`` (null under this law).

    Law `bytes`: shards hold sizes as equal as whole documents allow. Slots
    run from 0 in the order (hash of the text, id); rows equal in text and id
    are interchangeable and stay together. A null text counts as an empty one
    (8 bytes, checksum 0), null ids come last among equal texts; an empty table
    gives no shards; columns of any name pass through inside ``doc``.

    The shards follow from the rows, ``shards`` and ``tolerance`` alone. The
    number of pieces follows the session's partitions; pieces only cut a shard
    for its numbering."""
    pieces = max(1, -(-PIECES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _size(text_col).alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"),
                         F.struct(F.xxhash64(text).alias("h"), null_last(id_col, 0).alias("id")).alias("k"))
    keys = checkpoint(placed.select("k", "size"))
    of_shards = histogram_splitters(keys, shards, tolerance)
    cuts = {_order(c): c for c in [*histogram_splitters(keys, shards * pieces, PIECE_TOLERANCE), *of_shards]}
    borders, places = [_order(c) for c in of_shards], sorted(cuts)
    at = range_of([cuts[o] for o in places], F.col("k"))
    counts = {r["piece"]: r for r in keys.groupBy(at.alias("piece")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}  # one row for each piece
    # the stretch between two shard splitters lies in the shard that its middle byte falls into
    stretch = [0, *(bisect_right(borders, o) for o in places)]
    sizes = [0] * (len(borders) + 1)
    for piece, r in counts.items():
        sizes[stretch[piece]] += r.bytes
    total, before, home_of = sum(sizes), 0, []
    for size in sizes:
        home_of.append(min(shards - 1, int((before + size / 2) * shards / total)) if total else 0)
        before += size
    homes, firsts, filled = [], [], {}
    for piece, part in enumerate(stretch):
        homes.append(home_of[part])
        firsts.append(filled.get(homes[-1], 0))
        filled[homes[-1]] = firsts[-1] + (counts[piece].rows if piece in counts else 0)
    inside = Window.partitionBy("piece").orderBy("k")
    return (placed.withColumn("piece", at).withColumn("nth", F.row_number().over(inside) - 1)
            .select("doc", "size", "text_crc32", F.lit("bytes").alias("law"),
                    F.get(F.array(*map(F.lit, homes)), F.col("piece")).cast("int").alias("shard"),
                    (F.get(F.array(*map(F.lit, firsts)).cast("array<long>"), F.col("piece")) + F.col("nth")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
