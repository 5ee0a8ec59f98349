"""Repairing the structure of conversations at least cost.

Every row of a conversation may be kept, given another role or deleted, and
empty turns may be inserted, so that the role initials become
``(s?(ua)+)?``. The edits are ways through a lattice of (rows consumed, role
before): Dijkstra from its start and from its end at the same time, each with a
heap of its own, until the two heaps' least costs together pass the best meeting.
Every crossing of that cost has then been finished, and of those the one with
the least audit (edit initials in order) is taken.

A conversation is cut to blocks of ``BLOCK`` rows, so that the lattice in a
task is bounded whatever its length: a block gives the cheapest way between
each two roles at its ends, and the blocks are chained from the last to the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from ..session import checkpoint
from .common import SPACES, null_last, slices

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block.
BLOCK = 256
#: Role before: none, or the initial of the last role that stays. A conversation may end before any role or after an assistant.
START, LAST = "-", "a"
STATES = (START, "s", "u", "a")
FOLLOWS = {START: "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: A row's first fault.
SOUND, BLANK, DUPLICATE, CUT = "-", "b", "d", "t"

Way = tuple[int, str]


def _edges(initials: str, faults: str, at: int, before: str) -> Iterator[tuple[int, str, int, str]]:
    """(cost, edit initial, rows consumed, role after) of every edit at a place of the lattice."""
    if at < len(initials):
        yield DELETE, "D", at + 1, before
        if faults[at] in (SOUND, CUT):
            extra = TRUNCATED if faults[at] == CUT else 0
            for role in FOLLOWS[before]:
                if role == initials[at]:
                    yield extra, "K", at + 1, role
                elif role in ROLES:
                    yield extra + REROLE, "R", at + 1, role
    for role in FOLLOWS[before]:
        if role in ROLES:
            yield INSERT, "I", at, role


def _back(initials: str, faults: str, at: int, after: str) -> Iterator[tuple[int, str, int, str]]:
    """The edits that lead to a place, as (cost, edit initial, rows consumed before, role before)."""
    for before in STATES:
        for place in {at, max(at - 1, 0)}:
            for cost, edit, to, role in _edges(initials, faults, place, before):
                if to == at and role == after:
                    yield cost, edit, place, before


class _Side:
    """One of the two searches. Labels are (cost, audit); of equal costs the least audit wins. Nodes
    are settled by cost, then in the order in which rows are consumed, so that the free edits
    towards a node come before it."""

    def __init__(self, sources: Sequence[tuple[int, str]], step, ahead: bool):
        self.labels: dict[tuple[int, str], Way] = {s: (0, "") for s in sources}
        self.done: dict[tuple[int, str], Way] = {}
        self.step, self.ahead = step, ahead
        self.heap: list = []
        for node in sources:
            self._push(node, 0)

    def _push(self, node: tuple[int, str], cost: int) -> None:
        heappush(self.heap, (cost, node[0] if self.ahead else -node[0], node[1]))

    def least(self) -> float:
        while self.heap and (abs(self.heap[0][1]), self.heap[0][2]) in self.done:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else inf

    def settle(self) -> tuple[int, str]:
        _, at, role = heappop(self.heap)
        node = abs(at), role
        cost, audit = self.done[node] = self.labels[node]
        for more, edit, to, after in self.step(*node):
            new = cost + more, audit + edit if self.ahead else edit + audit
            if (to, after) not in self.labels or new < self.labels[to, after]:
                if (to, after) not in self.labels or new[0] < self.labels[to, after][0]:
                    self._push((to, after), new[0])
                self.labels[to, after] = new
        return node


@lru_cache(4096)
def cheapest(initials: str, faults: str, start: str = START, ends: tuple[str, ...] = (START, LAST)) -> Way | None:
    """(cost, audit) of the cheapest edits that lead from ``start`` to one of ``ends``, of equal costs the least audit."""
    n = len(initials)
    ahead = _Side([(0, start)], lambda at, role: _edges(initials, faults, at, role), True)
    back = _Side([(n, e) for e in ends], lambda at, role: _back(initials, faults, at, role), False)
    best = inf
    while (f := ahead.least()) + (r := back.least()) <= best and min(f, r) < inf:
        side, other = (ahead, back) if f <= r else (back, ahead)
        node = side.settle()
        if node in other.labels:
            best = min(best, side.done[node][0] + other.labels[node][0])
    # whatever both know of is a way; where the best ones cross, both labels are final
    met = [_meet(label, back.labels[node]) for node, label in ahead.labels.items() if node in back.labels]
    for node, label in ahead.labels.items():
        for cost, edit, to, after in _edges(initials, faults, *node):
            if (to, after) in back.labels:
                met.append(_meet(label, (cost, edit), back.labels[to, after]))
    return min(met, default=None)


def _meet(*parts: Way) -> Way:
    return sum(p[0] for p in parts), "".join(p[1] for p in parts)


#: The one place after the last block.
END = "."


def chain(blocks: Sequence[dict[tuple[str, str], Way]]) -> tuple[int, list[str]]:
    """Cost, and the audit of every block, of the cheapest way through all blocks.

    From the last block to the first every role keeps its cheapest way to the
    end. Ways are compared piece by piece, never copied."""
    rest: dict[str, tuple[int, tuple | None]] = {END: (0, None)}
    for block in reversed(blocks):
        new: dict[str, tuple[int, tuple | None]] = {}
        for (start, end), (cost, audit) in block.items():
            if end in rest:
                way = cost + rest[end][0], (audit, rest[end][1])
                if start not in new or way[0] < new[start][0] or way[0] == new[start][0] and _less(way[1], new[start][1]):
                    new[start] = way
        rest = new
    cost, way = rest[START]
    audits = []
    while way:
        audits.append(way[0])
        way = way[1]
    return cost, audits


def _letters(way: tuple | None) -> Iterator[str]:
    while way:
        yield from way[0]
        way = way[1]


def _less(a: tuple, b: tuple) -> bool:
    """Whether the audit of ``a`` is before that of ``b``."""
    x, y = _letters(a), _letters(b)
    while True:
        p, q = next(x, ""), next(y, "")
        if p != q or not p:
            return p < q


def damage(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows after damage, by crc32(``conv_id:turn``) % 20: 0 drops a row, 1
    empties its text, 2 removes its ``[.!?]``, 3 repeats it (same turn), 4 sets
    role user. Null roles and texts, and nulls in the hashed key, count as one
    space; a null turn stays null. (conv_id, turn, role, text); other columns go."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        space(role_col).alias("role"), space(text_col).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(copies).alias("copy")).drop("copy")


def _conversation(name: str = "conv_id") -> list[Column]:
    key = null_last(name, 0)
    return [key["n"].alias("lost"), key["v"].alias("conv")]


#: The columns that name a conversation: whether its id is null, and the id.
KEY = ["lost", "conv"]


def _digest() -> Column:
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest")


def faults(turns: DataFrame) -> DataFrame:
    """(lost, conv, idx, turn, initial, fault): the rows numbered by turn (null
    first, rows of one turn by a digest of role and text), each with the first
    fault that holds. Texts do not move. A row repeats an earlier one if its
    digest has an earlier first place: an aggregate and a join, no window over a
    conversation."""
    words = F.rtrim(F.translate("text", SPACES[1:], " " * (len(SPACES) - 1)))
    own = F.when(words == "", BLANK).when(~F.substring(words, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    rows = turns.select(*_conversation(), "turn", _digest(), F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
                        own.alias("own"))
    rows = dense_index(rows, ["turn", "digest"], group_by=KEY)
    first = rows.groupBy(*KEY, "digest").agg(F.min("idx").alias("first"))
    fault = F.when((F.col("idx") > F.col("first")) & (F.col("own") != BLANK), DUPLICATE).otherwise(F.col("own"))
    return rows.join(first, [*KEY, "digest"]).select(*KEY, "idx", "turn", "initial", fault.alias("fault"))


def _solve(initials: str, marks: str, first: bool, last: bool) -> list[tuple[str, str, int, str]]:
    """(role before, role after, cost, audit) of a block's cheapest ways."""
    out = []
    for start in (START,) if first else STATES:
        for name, ends in [(END, (START, LAST))] if last else [(s, (s,)) for s in STATES]:
            found = cheapest(initials, marks, start, ends)
            if found is not None:
                out.append((start, name, *found))
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row for each block with its counts and cheapest ways. A block also
    sees the row before it, for the pair of roles across the cut."""
    spread = F.when(F.col("idx") % size == size - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    seen = (rows.select(*KEY, "idx", "initial", "fault", F.explode(spread).alias("next"))
            .withColumn("block", F.floor(F.col("idx") / size) + F.col("next")))
    line = F.array_sort(F.collect_list(F.struct("idx", "initial", "fault", "next")))
    lined = seen.groupBy(*KEY, "block").agg(line.alias("x")).where("exists(x, r -> r.next = 0)")
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            for initials, marks, before, block, n in zip(batch["initials"], batch["marks"], batch["before"], batch["block"], batch["n"], strict=True):
                pairs = list(zip((before + initials), (before + initials)[1:]))
                ways = _solve(initials, marks, block == 0, (block + 1) * size >= n)
                found.append((marks.count(BLANK), marks.count(DUPLICATE), marks.count(CUT), sum(a + b not in ("su", "ua", "au") for a, b in pairs),
                              [{"start": a, "end": b, "cost": c, "audit": d} for a, b, c, d in ways]))
            out = pd.DataFrame(found, columns=["blank", "duplicate", "truncated", "illegal", "ways"])
            yield pd.concat([batch[[*KEY, "block", "n"]].reset_index(drop=True), out], axis=1)

    own = F.filter("x", lambda r: r["next"] == 0)
    text = lambda rows, name: F.array_join(F.transform(rows, lambda r: r[name]), "")
    return (lined.join(sizes, KEY)
            .select(*KEY, "block", "n", text(own, "initial").alias("initials"), text(own, "fault").alias("marks"),
                    text(F.filter("x", lambda r: r["next"] == 1), "initial").alias("before"))
            .mapInPandas(solve, "lost boolean, conv long, block long, n long, blank long, duplicate long, truncated long, illegal long, "
                                "ways array<struct<start string, end string, cost long, audit string>>"))


def _chosen(blocks: DataFrame, size: int) -> DataFrame:
    """Every block with its audit and, at the first block, the cost of its conversation."""
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        cost, audits = chain([{(w["start"], w["end"]): (int(w["cost"]), w["audit"]) for w in x} for x in rows["ways"]])
        return rows[[*KEY, "block"]].assign(cost=[cost] + [0] * (len(rows) - 1), audit=audits)

    way = F.col("ways")[0]
    single = blocks.where(F.col("n") <= size).select(*KEY, "block", way["cost"].alias("cost"), way["audit"].alias("audit"))
    longer = blocks.where(F.col("n") > size).select(*KEY, "block", "ways")
    return single.unionByName(longer.groupBy(*KEY).applyInPandas(choose, "lost boolean, conv long, block long, cost long, audit string"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def repair(turns: DataFrame, conversations: DataFrame | None = None, *, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, text) -> one row for each conv_id of it and of
    ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired_sha256 (of the repaired ``role:text`` lines).

    * a null conv_id is a conversation of its own; null turns come first and
      are no gap; null roles and texts count as one space.
    * rows that share a turn are ordered by a digest of role and text, so equal
      rows stand side by side and all but the first are duplicates.
    * a conversation without rows has zeros, an empty audit and the empty
      text's hash; an empty table gives no rows; other columns are ignored.
    * a conversation of any length is solved by blocks. Its audit and its hash
      are single values: the audit is put together, and the rows stream in
      order, in one task that holds the audit and a slice of rows at a time."""
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = checkpoint(faults(turns))
    blocks = checkpoint(_blocks(rows, block))
    chosen = _chosen(blocks, block).join(blocks.drop("ways", "n"), [*KEY, "block"])
    ids = turns.select("conv_id") if conversations is None else conversations.select("conv_id").unionByName(turns.select("conv_id"))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    spans = rows.groupBy(*KEY).agg(F.coalesce(gaps, F.lit(0)).alias("gaps"))
    heads = ids.distinct().select(*_conversation()).join(spans, KEY, "left")
    columns = {"block": "long", "turn": "long", "digest": "string", "gaps": "long", **dict.fromkeys(COUNTS, "long"), "cost": "long",
               "audit": "string", "role": "string", "text": "string"}

    def part(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*KEY, F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    # a conversation's head, then its blocks, then its rows
    stream = (part(heads, 0).unionByName(part(chosen, 1))
              .unionByName(part(turns.select(*_conversation(), "turn", _digest(), "role", "text"), 2)))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = (stream.repartition(parts, *KEY).sortWithinPartitions(*KEY, "kind", "block", "turn", "digest").drop("block", "turn", "digest")
           .mapInArrow(_write, "lost boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, "
                               "cost long, audit string, repaired_sha256 string"))
    return out.select(F.when(~F.col("lost"), F.col("conv")).alias("conv_id"), "gaps", *COUNTS, "cost", "audit", "repaired_sha256")


class _Repaired:
    """One conversation as it streams by: its counts, then its rows as the audit edits them."""

    def __init__(self, head: dict):
        self.row = {k: head[k] for k in KEY} | {"gaps": head["gaps"] or 0, **dict.fromkeys(COUNTS, 0), "cost": 0}
        self.audits, self.edits, self.at = [], None, 0
        self.digest, self.before, self.first = sha256(), START, True

    def block(self, r: dict) -> None:
        for c in (*COUNTS, "cost"):
            self.row[c] += r[c]
        self.audits.append(r["audit"])

    def _line(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.before, self.first = role[0], False

    def _inserted(self) -> str:
        """Writes the insertions at this place of the audit; the edit after them."""
        while (edit := self.edits[self.at:self.at + 1]) == "I":
            self._line(ROLES[FOLLOWS[self.before][-1]], "")
            self.at += 1
        return edit

    def turn(self, role: str, text: str) -> None:
        if self.edits is None:
            self.edits = "".join(self.audits)
        edit = self._inserted()
        self.at += 1
        if edit == "K":
            self._line(role, text)
        elif edit == "R":
            self._line(ROLES[FOLLOWS[self.before][-1]], text)

    def finish(self) -> dict:
        if self.edits is None:
            self.edits = "".join(self.audits)
        self._inserted()
        return self.row | {"audit": self.edits, "repaired_sha256": self.digest.hexdigest()}


_RESULT = pa.schema([("lost", pa.bool_()), ("conv", pa.int64()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS],
                     ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation leaves when the next one's head arrives."""
    now: _Repaired | None = None
    for batch in slices(batches):
        out = []
        for r in batch.to_pylist():
            if r["kind"] == 0:
                if now:
                    out.append(now.finish())
                now = _Repaired(r)
            elif r["kind"] == 1:
                now.block(r)
            else:
                now.turn(r["role"], r["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, _RESULT)
    if now:
        yield pa.RecordBatch.from_pylist([now.finish()], _RESULT)
