"""Document fingerprints that tell versions apart: invertible Bloom lookup sketches.

A text is cut into paragraphs (lines; long ones in pieces) and each digest is
added to three cells of a table: cells hold a count, the XOR of the digests and
the XOR of their checks. Subtracting two texts' cells cancels what they share.
A cell with one digest left gives it away; taking it out of its other cells
frees more, until the cells are empty and every differing digest is known. If
peeling gets stuck, each text makes a sketch of twice the cells, with other
places, and these are subtracted. A fingerprint has a size of its own, by the
number of the text's digests, and tells it. All of it is built-in expressions
over the row; cells that nothing is in are not kept, and a table is made by
sorting entries by cell and adding up the runs, so that work follows a text's
length.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import let
from .ranges import _type, range_count, range_of, splitters

#: Characters of a paragraph's pieces.
PIECE = 128
HASHES = 3
#: Cells for each of the three hashes at least; how often a pair is tried again with twice the cells.
WIDTH, RETRIES = 4, 8
#: Rounds of peeling.
ROUNDS = 40


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs (null: none)."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([^\\n]{{1,{PIECE}}})"), F.lit(1))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def width_for(found: Column) -> Column:
    """Cells for each hash in the sketch of some digests: a power of two, at
    least half their number, so that a sketch holds 0.75 to 1.5 times as many
    differing digests as its text has."""
    half = F.greatest(F.size(found) / F.lit(2.0), F.lit(float(WIDTH)))
    return F.pow(F.lit(2.0), F.ceil(F.log2(half))).cast("int")


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(at, n, x, c) -> Column:
    return F.struct(at.cast("long").alias("at"), n.cast("long").alias("n"), x.cast("long").alias("x"), c.cast("long").alias("c"))


def _entries(found: Column, n: int, width: Column) -> Column:
    """What some digests put into cells: three entries each, one in each third of the table."""
    def of(x):
        return let(F.struct(F.xxhash64(x, width).alias("g"), _check(x).alias("c")), lambda s: F.array(*[
            _cell(F.shiftrightunsigned(s["g"], 20 * k).bitwiseAND(width.cast("long") - 1) + width * k, F.lit(n), x, s["c"])
            for k in range(HASHES)]))
    return F.flatten(F.transform(found, of))


def _added(entries: Column) -> Column:
    """Entries of one cell added up; cells in order, empty ones left out."""
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in "nxc"])

    def runs(es):
        starts = F.filter(F.transform(es, lambda e, i: F.when(F.get(es, i - 1)["at"].eqNullSafe(e["at"]), F.lit(-1)).otherwise(i)), lambda i: i >= 0)

        def total(a, b):
            one = F.get(es, a)
            many = let(F.aggregate(F.slice(es, a + 1, b - a), zero, lambda s, e: F.struct(
                (s["n"] + e["n"]).alias("n"), s["x"].bitwiseXOR(e["x"]).alias("x"), s["c"].bitwiseXOR(e["c"]).alias("c"))),
                lambda s: _cell(one["at"], s["n"], s["x"], s["c"]))
            return F.when(b - a == 1, one).otherwise(many)

        return let(starts, lambda st: F.transform(st, lambda a, k: total(a, F.coalesce(F.get(st, k + 1), F.size(es)))))

    added = let(F.sort_array(entries), runs)
    return F.filter(added, lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0))


def sketch(found: Column, width: Column) -> Column:
    """The cells of some distinct digests, ``width`` (a power of two) for each hash."""
    return _added(_entries(found, 1, width))


def subtract(a: Column, b: Column) -> Column:
    """The cells of one sketch less those of another of the same width."""
    return _added(F.concat(a, F.transform(b, lambda c: _cell(c["at"], -c["n"], c["x"], c["c"]))))


def peel(cells: Column, width: Column) -> Column:
    """(ok, plus, minus): the digests that only the first sketch had and those
    that only the second had; ok if no cell kept anything."""
    none = F.array().cast("array<bigint>")

    def turn(s, _):
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["x"])))
        side = lambda ps, n: F.array_distinct(F.transform(F.filter(ps, lambda c: c["n"] == n), lambda c: c["x"]))

        def without(got):
            left = _added(F.concat(s["cells"], _entries(got["plus"], -1, width), _entries(got["minus"], 1, width)))
            return F.struct(left.alias("cells"), F.concat(s["plus"], got["plus"]).alias("plus"), F.concat(s["minus"], got["minus"]).alias("minus"),
                            F.lit(False).alias("stuck"))

        stuck = F.struct(s["cells"].alias("cells"), s["plus"].alias("plus"), s["minus"].alias("minus"), F.lit(True).alias("stuck"))
        sides = lambda ps: let(F.struct(side(ps, 1).alias("plus"), side(ps, -1).alias("minus")), without)
        return F.when(s["stuck"] | (F.size(s["cells"]) == 0), s).otherwise(
            let(pure, lambda ps: F.when(F.size(ps) == 0, stuck).otherwise(sides(ps))))

    start = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"), F.lit(False).alias("stuck"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return let(done, lambda s: F.struct((F.size(s["cells"]) == 0).alias("ok"), s["plus"].alias("plus"), s["minus"].alias("minus")))


def difference(a: Column, b: Column, own_a: Column, own_b: Column) -> Column:
    """(tries, plus, minus): the digests in ``a`` only and in ``b`` only, out of
    two arrays of digests and their fingerprints' cells.

    Each try subtracts two sketches, each made from one text's digests alone.
    The first has the larger fingerprint's width, so that the fingerprints
    serve as they are where their widths agree; later ones have twice the cells
    each, RETRIES times. (Should the last fail too, which only a whole table of
    like places can bring about, digests are compared directly: 0 tries.)"""
    def tried(w):
        first = F.greatest(w["a"], w["b"])

        def attempt(s, k):
            def at(width):
                made = lambda found, own, mine: F.when(width == mine, own).otherwise(sketch(found, width))
                done = peel(subtract(made(a, own_a, w["a"]), made(b, own_b, w["b"])), width)
                return let(done, lambda d: F.struct(d["ok"].alias("ok"), k.alias("tries"), d["plus"].alias("plus"), d["minus"].alias("minus")))
            return F.when(s["ok"], s).otherwise(let((first * F.pow(F.lit(2.0), k - 1)).cast("int"), at))

        none = F.array().cast("array<bigint>")
        start = F.struct(F.lit(False).alias("ok"), F.lit(0).alias("tries"), none.alias("plus"), none.alias("minus"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES + 1)), start, attempt)

    direct = F.struct(F.lit(0).alias("tries"), F.array_except(a, b).alias("plus"), F.array_except(b, a).alias("minus"))
    widths = F.struct(width_for(a).alias("a"), width_for(b).alias("b"))
    return let(let(widths, tried), lambda s: F.when(s["ok"], F.struct(
        s["tries"].alias("tries"), s["plus"].alias("plus"), s["minus"].alias("minus"))).otherwise(direct))


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """The share of both texts' digests that they have in common (two empty texts: 1)."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - F.size(apart["plus"]) - F.size(apart["minus"])) / both)


def spelled(width: Column, cells: Column) -> Column:
    """A fingerprint: the width, then place, count, digests and checks of each cell, in hexadecimal digits."""
    cell = lambda c: F.concat_ws(".", *[F.lower(F.hex(c[k])) for k in ("at", "n", "x", "c")])
    return F.concat_ws(":", F.lower(F.hex(width)), F.array_join(F.transform(cells, cell), ","))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and next_text, the text of the next document
    in descending order of id, after the last that of the first.

    Null ids come last; rows of one id are ordered by text hash. Documents move
    once, to ranges of ids; a range's border row is also sent to the next."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.struct(
        F.col(id_col).isNotNull().alias("n"), F.coalesce(F.col(id_col), F.lit(0)).alias("v"), F.xxhash64(text).alias("h")).alias("k"))
    keys = checkpoint(placed.select("k"))
    cuts = splitters(keys, F.col("k"), range_count(docs))
    part = range_of(cuts, F.col("k"))
    last = {r["part"]: r["k"] for r in keys.groupBy(part.alias("part")).agg(F.max("k").alias("k")).collect()}  # a row for each range
    if not last:
        return placed.select("doc_id", "text", F.col("text").alias("next_text"))
    filled = sorted(last)
    after = {a: b for a, b in zip(filled, [*filled[1:], filled[0]], strict=True)}
    borders = F.from_json(F.lit(json.dumps([{"k": last[i].asDict(), "to": after[i]} if i in last else None for i in range(len(cuts) + 1)])),
                          f"array<struct<k: {_type(last[filled[0]])}, to: int>>")
    mine = F.struct(F.col("part"), F.lit(False).alias("lent"))

    def homes(b):
        return F.when(b["k"] == F.col("k"), F.array(mine, F.struct(b["to"].alias("part"), F.lit(True).alias("lent")))).otherwise(F.array(mine))

    dealt = placed.withColumn("part", part).withColumn("home", F.explode(let(F.get(borders, F.col("part")), homes)))
    order = Window.partitionBy("home.part").orderBy(F.col("home.lent").desc(), "k")
    return dealt.withColumn("next_text", F.lag("text").over(order)).where("NOT home.lent").select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last third of a text's characters replaced by the first as many of another."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every text and of its edited form, how like the
    text's is to the edited one's and to the next document's, and at which try
    the two sketches told all their differences (``tries_edited``, ``tries_next``).

    Null texts count as empty ones (a fingerprint without a filled cell); equal
    texts have equal fingerprints, and repeated paragraphs count once; repeated
    rows keep a row each; an only document is its own next one."""
    texts = with_next(docs, id_col=id_col, text_col=text_col)
    texts = texts.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    found = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                         digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next_text")).alias("x"))
    cells = found.select("*", *[sketch(F.col(c), width_for(F.col(c))).alias(f"cells_{c}") for c in "aex"])
    apart = lambda c: difference(F.col("a"), F.col(c), F.col("cells_a"), F.col(f"cells_{c}"))
    told = lambda c: let(apart(c), lambda d: F.struct(likeness(F.col("a"), F.col(c), d).alias("near"), d["tries"].alias("tries")))
    out = cells.select("doc_id", "n_chars", "edited_sha256", *[spelled(width_for(F.col(c)), F.col(f"cells_{c}")).alias(f"print_{c}") for c in "ae"],
                       told("e").alias("edited"), told("x").alias("next"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("print_a").alias("fingerprint"), F.col("print_e").alias("edited_fingerprint"),
                      F.col("edited.near").alias("near_edited"), F.col("next.near").alias("near_next"),
                      F.col("edited.tries").alias("tries_edited"), F.col("next.tries").alias("tries_next"))
