"""Near-duplicates by HyperMinHash.

A document's set of word shingles is dealt to buckets by hash; a bucket keeps
the smallest hash that fell to it as a leading-zero count and the mantissa bits
behind it, 16 bits instead of 64. Bands of these compressed registers name the
candidates; pairs of them are estimated by their equal registers, corrected for
the registers that two unlike sets have equal by chance, and what may pass is
verified on the full sets.

A set with fewer shingles than registers would leave most buckets empty. Sets
are therefore put into classes of size, each with fewer buckets and as many more
hash functions, so that all have ``REGISTERS`` registers with four shingles each
or more (one bucket for each hash function in the least class).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import null_last, slices
from .components import components

SHINGLE = 2
#: Pairs with 100 * intersection >= SIMILARITY * union are linked.
SIMILARITY = 80
#: At a similarity of 0.8 a pair misses all 48 bands of 4 with a chance of 1e-11.
BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: The least set of class 1; every further class doubles it, and its buckets up to REGISTERS.
SMALLEST, BUCKETS = 12, 3
#: An estimate may lie this many standard errors under the similarity (a chance of 1e-9) and is verified.
ERRORS = 6.0
#: Bands that a pair must share: two of 48 are missed at a similarity of 0.8 with a chance of 4e-10.
VOTES = 2
#: Members that share a task with their pivot, and bytes of row names up to which they are broadcast to find their texts.
FAN, BROADCAST_BYTES = 1_024, 64 << 20
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 18


def size_class(n: np.ndarray) -> np.ndarray:
    return np.where(n < SMALLEST, 0, 1 + np.floor(np.log2(np.maximum(n, 1) / SMALLEST + 1e-12))).astype(np.int64)


def buckets(cls: int) -> int:
    """Buckets of each hash function of a class; it has REGISTERS / buckets functions."""
    return 1 if cls == 0 else min(REGISTERS, BUCKETS << (cls - 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all (shift, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """The 64-bit hash of every word; forgets all when it has too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_sets(texts: list[str | None], known: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles as ascending 64-bit hashes.

    A hash stands for its shingle: two of a pair's shingles collide with a
    chance of about product of the set sizes / 2**64."""
    words = [(t or "").encode().lower().split() for t in texts]  # ASCII case and white space only
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[x] for w in words for x in w), np.uint64, counts.sum())
    rows = np.repeat(np.arange(len(texts)), counts)
    h = np.full(len(flat), np.uint64(size))
    inside = np.ones(len(flat), bool)
    last = np.cumsum(counts)[rows] if len(flat) else rows
    place = np.arange(len(flat))
    short = (counts < size)[rows]
    for k in range(size):
        at = np.minimum(place + k, max(len(flat) - 1, 0))
        fits = place + k < last
        h = np.where(fits, mix(h + flat[at]), h)
        inside &= fits
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    keep = inside | (short & first)
    h, rows = h[keep], rows[keep]
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[fresh], rows[fresh]
    return h, np.searchsorted(rows, np.arange(len(texts) + 1))


def registers(h: np.ndarray, offsets: np.ndarray, cls: int) -> np.ndarray:
    """The compressed registers of every set, all taken as of one class: 0 for an empty bucket,
    else (leading zeros, mantissa) of the bucket's least hash, in 16 bits."""
    n, m = len(offsets) - 1, buckets(cls)
    rows = np.repeat(np.arange(n), np.diff(offsets)) * m
    out = np.empty((n, REGISTERS // m, m), np.uint16)
    for f in range(REGISTERS // m):
        x = mix(h + mix(np.uint64(f + 1) + np.zeros(1, np.uint64)))
        cell = rows + ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        least = np.full(n * m, 1 << 33, np.int64)
        np.minimum.at(least, cell, (x & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1)
        out[:, f] = compress(least).reshape(n, m)
    return out.reshape(n, REGISTERS)


def compress(least: np.ndarray) -> np.ndarray:
    """1 to 2**32 -> 1 + leading zeros in the upper six bits and the ten bits after the leading one; more: 0."""
    fraction, exponent = np.frexp(least.astype(np.float64))  # least = fraction * 2**exponent, fraction in [1/2, 1)
    mantissa = np.floor((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    return np.where(least > 1 << 32, 0, ((34 - exponent) << MANTISSA) + mantissa).astype(np.uint16)


def chance(n: np.ndarray, k: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers that unlike sets of ``n`` and ``k`` shingles in ``m`` buckets have equal
    by chance: the same leading zeros on both sides, then the same of the mantissas."""
    total = np.zeros(len(n))
    for zeros in range(33):
        low, high = 2.0 ** -(zeros + 1) if zeros < 32 else 0.0, 2.0 ** -zeros
        total += ((np.exp(-n / m * low) - np.exp(-n / m * high)) * (np.exp(-k / m * low) - np.exp(-k / m * high)))
    return total / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, k: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The similarity of sets by their registers, less what is equal by chance."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1) / np.maximum(used, 1)
    by_chance = chance(n, k, m)
    return (same - by_chance) / (1 - by_chance)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Every row's set: its size, a digest, and its registers in each class that a similar set may be in."""
    known = Words()
    for batch in slices(batches):
        h, offsets = shingle_sets(batch.column("text").to_pylist(), known, size)
        counts = np.diff(offsets)
        sets = [h[a:b] for a, b in zip(offsets, offsets[1:])]
        sketches: list[list[dict]] = [[] for _ in sets]
        # a similar set is at most 100 / SIMILARITY as large
        own, more = size_class(counts), size_class(counts * 100 // SIMILARITY)
        for cls in np.unique(np.concatenate([own, more])):
            at = np.flatnonzero(((own == cls) | (more == cls)) & (counts > 0))
            if len(at):
                regs = registers(np.concatenate([sets[i] for i in at]), np.concatenate([[0], np.cumsum(counts[at])]), int(cls))
                for i, r in zip(at, regs):
                    sketches[i].append({"cls": int(cls), "regs": r.tobytes()})
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("hash"), pa.array(counts, pa.int64()),
             pa.array([blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
             pa.array(sketches, pa.list_(pa.struct([("cls", pa.int32()), ("regs", pa.binary())])))], names=["id", "hash", "n", "key", "sketches"])


def _bands(regs: Column, cls: Column) -> Column:
    """The keys of a set's bands."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(cls, i, F.substring(regs, i * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")]


def _estimated(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b, cls) whose registers do not rule a link out."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(f"regs_{x}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in "ab"]
            n, k = (batch.column(f"n_{x}").to_numpy().astype(float) for x in "ab")
            m = np.array([buckets(c) for c in batch.column("cls").to_pylist()], float)
            s = similarity / 100
            may = estimate(*regs, n, k, m) >= s - ERRORS * np.sqrt(s * (1 - s) / REGISTERS)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    def side(x: str) -> DataFrame:
        return nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketches").alias(f"s_{x}"))

    def regs(x: str) -> Column:
        return F.filter(f"s_{x}", lambda r: r["cls"] == F.col("cls"))[0]["regs"].alias(f"regs_{x}")

    one = pairs.join(side("a"), "a").select("a", "b", "cls", "n_a", regs("a"))
    # sizes alone rule out many
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similarity
    both = one.join(side("b"), "b").where(near).select("a", "b", "cls", "n_a", "n_b", "regs_a", regs("b"))
    return both.mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: int, size: int) -> DataFrame:
    """The pairs (a, b) with the sizes n_a, n_b of their full sets, whether these
    are similar (``linked``), and the shingles that only one of them has (``apart``).

    ``a`` is the pivot: its text goes to as many tasks as its partners need,
    each partner's to one of them, where they stream past it. A task holds one
    pivot's set and a slice of partners. Only texts that take part move, once
    for each part they play, as long as their names fit a broadcast."""
    pairs = checkpoint(pairs)
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("parts"))
    member = pairs.join(fan, "a").select(F.col("b").alias("node"), F.col("a").alias("pivot"),
                                         F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(1).alias("kind"))
    head = fan.select(F.col("a").alias("node"), F.col("a").alias("pivot"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    wanted = checkpoint(member.unionByName(head).join(nodes.select("node", F.col("id").alias("_id"), F.col("hash").alias("_hash")), "node"))
    if wanted.count() * 48 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Words(), None
        for batch in slices(batches):
            h, offsets = shingle_sets(batch.column("text").to_pylist(), known, size)
            told: list[tuple[int, int, int, int, bool, np.ndarray]] = []
            for node, pivot, kind, at, end in zip(*(batch.column(c).to_pylist() for c in ("node", "pivot", "kind")), offsets, offsets[1:]):
                mine = h[at:end]
                if kind == 0:
                    held = mine
                    continue
                apart = np.setxor1d(held, mine, assume_unique=True)
                total = len(held) + len(mine)
                told.append((pivot, node, len(held), len(mine), 100 * (total - len(apart)) >= similarity * (total + len(apart)),
                             apart.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in told], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())))], names=["a", "b", "n_a", "n_b", "linked", "apart"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.join(wanted, rows["id"].eqNullSafe(wanted["_id"]) & (rows["hash"] == wanted["_hash"])).select("node", "pivot", "part", "kind", "text")
    sorted_ = met.repartition(parts, "pivot", "part").sortWithinPartitions("pivot", "part", "kind").select("node", "pivot", "kind", "text")
    return sorted_.mapInArrow(compare, "a long, b long, n_a long, n_b long, linked boolean, apart array<long>")


def _within(families: DataFrame, similarity: int) -> DataFrame:
    """(a, b): the pairs of a pivot's partners that may be similar though one of them, ``a``, is not similar to the pivot.

    Two partners differ where one of them differs from the pivot and the other
    does not. So similar ones must share a number of their differences that
    follows from the sizes (one at least, as ``a`` is unlike the pivot). Each
    lists its differences, the family's rarest first; the first one that a pair
    shares must have that many from there on in both. No pair is lost, and what
    a whole family differs in pairs nobody, as it comes last."""
    less, more = 100 - similarity, 100 + similarity
    split = families.where(~F.col("linked")).select("a").distinct()
    every = families.join(split, "a").select(F.col("a").alias("pivot"), "b", F.col("n_a").alias("p"), F.col("n_b").alias("n"), "linked",
                                             F.size("apart").cast("long").alias("d"), F.explode("apart").alias("x"))
    seen = every.groupBy("pivot", "x").agg(F.count(F.lit(1)).alias("members"))
    ordered = every.join(seen, ["pivot", "x"]).withColumn("before", F.row_number().over(Window.partitionBy("pivot", "b").orderBy("members", "x")) - 1)
    # differences from this one on; those nobody else has, and those too late for any partner, pair nobody
    some = ordered.withColumn("left", F.col("d") - F.col("before")).where("members > 1").where(
        F.when(F.col("linked"), more * F.col("d") + less * (F.col("p") - F.col("n")) < 2 * more * F.col("left"))
        .otherwise(similarity * F.col("d") - less * F.col("n") <= similarity * F.col("left")))
    some = checkpoint(some.select("pivot", "x", "b", "n", "d", "left", "linked"))
    one = some.where(~F.col("linked")).select("pivot", "x", F.col("b").alias("a"), F.col("n").alias("n_a"), F.col("d").alias("d_a"), F.col("left").alias("left_a"))
    two = some.withColumnsRenamed({"n": "n_b", "d": "d_b", "left": "left_b"})
    both = (one.join(two, ["pivot", "x"]).where("linked OR a < b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similarity)
            .where(more * F.abs(F.col("d_a") - F.col("d_b")) <= less * (F.col("n_a") + F.col("n_b")))
            .where(more * (F.col("d_a") + F.col("d_b")) - less * (F.col("n_a") + F.col("n_b")) <= 2 * more * F.least("left_a", "left_b")))
    return both.select("a", "b").distinct()


def links(nodes: DataFrame, rows: DataFrame, *, similarity: int = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(a, b): enough of the verified links between distinct sets to connect all that any of them connect.

    First every set is compared with one pivot, the set that shares most bands
    with it among those that stand for the bands it is in. A pivot's partners that
    are not similar to it find each other by what they differ in from it
    (``_within``). Then all other pairs that share a band and are not connected
    yet are compared. In a band where most sets are connected by then, only the
    others are paired with the rest. So a large group of near copies never gives
    its pairs."""
    banded = nodes.select("node", "n", F.explode("sketches").alias("s")).select("node", "n", "s.cls", F.explode(_bands(F.col("s.regs"), F.col("s.cls"))).alias("key"))
    # how many share a band, and how many a set meets in all of its bands: the text that a family was
    # copied from shares bands with most of it, so it becomes their pivot
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    crowded = checkpoint(banded.join(shared, "key"))
    standing = crowded.groupBy("node").agg(F.sum("members").alias("met"))
    ranked = crowded.join(standing, "node").groupBy("key").agg(F.max(F.struct("met", -F.col("node"), "node"))["node"].alias("pivot"))
    met = checkpoint(crowded.drop("members").join(ranked, "key"))
    votes = met.where("node <> pivot").groupBy("node", "pivot", "cls").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= VOTES)
    best = votes.groupBy("node").agg(F.max(F.struct("votes", -F.col("pivot"), "cls", "pivot")).alias("x"))
    firsts = best.select(F.col("x.pivot").alias("a"), F.col("node").alias("b"), "x.cls")
    families = checkpoint(_verified(_estimated(firsts, nodes, similarity), nodes, rows, similarity, size))
    found = families.where("linked").select("a", "b")
    grouped = components(found)
    # pairs of one family are named by what they differ in from its pivot; bands pair the others
    named = (met.join(grouped, "node", "left").join(families.select(F.col("b").alias("node"), F.col("a").alias("family")), "node", "left")
             .select("key", "cls", "node", "n", F.coalesce("component", "node").alias("comp"), "family"))
    named = checkpoint(named)
    crowd = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("members"))
    most = (crowd.groupBy("key").agg(F.max(F.struct("members", "comp")).alias("m"), F.count(F.lit(1)).alias("kinds"))
            .where("kinds > 1").select("key", F.col("m.comp").alias("main")))
    mixed = named.join(most, "key")
    few = mixed.where("comp <> main").select("key", "cls", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"), F.col("family").alias("family_a"))
    others = mixed.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"), F.col("family").alias("family_b"),
                          (F.col("comp") == F.col("main")).alias("in_main"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similarity
    rest = (few.join(others, "key").where("comp_a <> comp_b AND (in_main OR a < b) AND coalesce(family_a <> family_b, true)").where(near).groupBy("a", "b", "cls")
            .agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= VOTES).groupBy("a", "b").agg(F.min("cls").alias("cls")))
    tried = firsts.select("a", "b").unionByName(firsts.select(F.col("b").alias("a"), F.col("a").alias("b")))
    asked = _estimated(rest.join(tried, ["a", "b"], "left_anti"), nodes, similarity).unionByName(_within(families, similarity))
    more = checkpoint(_verified(asked, nodes, rows, similarity, size).where("linked").select("a", "b"))
    return found.unionByName(more)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY,
                    size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles (the size of the row's set of word
    shingles), component_id (the smallest id reachable over links) and kept
    (the row has that id).

    Rows of equal sets are one node, so copies cost a count.

    * null or empty texts, or texts without a word: an empty set, linked with
      nothing; component_id is the row's own id.
    * fewer words than a shingle has: the whole sequence is the one shingle.
    * null ids take part but name no component (null if it has no other id; such
      a row is kept if its component has no id). Rows that share an id are rows
      of their own, each with the component of its own text.
    * an empty table gives no rows; other columns are ignored."""
    rows = docs.select(*_row_key(docs, id_col, text_col))
    sketched = checkpoint(rows.mapInArrow(lambda b: _sketch(b, size), "id long, hash long, n long, key binary, "
                                                                      "sketches array<struct<cls:int,regs:binary>>"))
    # the row number that stands for a set holds, as it is read from what was written
    numbered = sketched.where("n > 0").withColumn("row", F.monotonically_increasing_id())
    firsts = numbered.groupBy("key").agg(F.min("row").alias("node"), F.min(F.struct(null_last("id", 0).alias("id"), "hash")).alias("first"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = numbered.select("row", "n", "sketches").repartition(parts, "row").join(firsts, F.col("row") == F.col("node"))
    nodes = checkpoint(sets.select("node", "key", "n", F.col("first.id").alias("first"), F.when(~F.col("first.id.n"), F.col("first.id.v")).alias("id"),
                                   F.col("first.hash").alias("hash"), "sketches"))
    marked = sketched.drop("sketches")
    found = components(links(nodes, rows, similarity=similarity, size=size))
    joined = nodes.join(found, "node", "left").select("key", "first", F.coalesce("component", "node").alias("component"))
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    named = joined.join(least, "component").select("key", F.when(~F.col("least.n"), F.col("least.v")).alias("component_id"))
    linked = marked.join(named, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return (linked.select(F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


#: DuckDB SQL for the near-duplicates of `documents`.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(31))) AS k, s FROM s),
c AS (SELECT k, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY k),
e AS (SELECT k, n, unnest(s) AS x FROM c),
pairs AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND 100 * least(a.n, b.n) >= {SIMILARITY} * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= {SIMILARITY} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
first AS (SELECT r.a AS k, min(k.doc_id) AS component_id FROM reach r JOIN k ON k.k = r.b GROUP BY r.a)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, CASE WHEN k.n > 0 THEN f.component_id ELSE k.doc_id END AS component_id,
  k.doc_id IS NOT DISTINCT FROM CASE WHEN k.n > 0 THEN f.component_id ELSE k.doc_id END AS kept
FROM k LEFT JOIN first f ON f.k = k.k"""
