"""Conversation repair against trying all edits."""

import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from corpusprep.llm import conversations

FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for i, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind:
            row = i, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [row] * (2 if kind == 3 else 1)
    return out


def digest(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_faults(rows):
    seen, marks = set(), ""
    for _, _, role, text in rows:
        last = WORD.findall(text)
        marks += "b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else "-"
        seen.add((role, text))
    return marks


sys.setrecursionlimit(20_000)


def plain_edits(initials, marks, start="", ends=("", "a")):
    """The least (cost, audit) of all ways of editing."""
    n = len(initials)

    @lru_cache(None)
    def best(at, before, inserted):
        ways = [(0, "")] if at == n and before in ends else []

        def go(cost, edit, rest):
            if rest is not None:
                ways.append((cost + rest[0], edit + rest[1]))

        if inserted < 3:
            for r in FOLLOWS[before]:
                if r in "ua":
                    go(5, "I", best(at, r, inserted + 1))
        if at < n:
            go(2, "D", best(at + 1, before, 0))
            if marks[at] not in "bd":
                extra = 5 if marks[at] == "t" else 0
                for r in FOLLOWS[before]:
                    if r == initials[at]:
                        go(extra, "K", best(at + 1, r, 0))
                    if r in "ua":
                        go(extra + 1, "R", best(at + 1, r, 0))
        return min(ways, default=None)

    return best(0, start, 0)


def plain_repair(rows):
    """One conversation's rows after damage -> the result without its id."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r[2], r[3])))
    marks = plain_faults(rows)
    initials = "".join(r[2][:1] if r[2][:1] in ("s", "u", "a") else "?" for r in rows)
    turns = {r[1] for r in rows if r[1] is not None}
    cost, audit = plain_edits(initials, marks)
    lines, before, at = [], "", 0
    for edit in audit:
        if edit != "I":
            role, text = rows[at][2:]
            at += 1
        if edit == "D":
            continue
        if edit == "K":
            lines.append(f"{role}:{text}")
            before = role[0]
        else:
            before = "a" if before == "u" else "u"
            lines.append(("user" if before == "u" else "assistant") + ":" + ("" if edit == "I" else text))
    legal = ("su", "ua", "au")
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks.count("b"), marks.count("d"), marks.count("t"),
            sum(a + b not in legal for a, b in zip(initials, initials[1:])), cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def plain_result(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    return sorted(((i, *plain_repair(x)) for i, x in groups.items()), key=repr)


def check(turns, **kw):
    got = conversations.repair(conversations.damage(turns), turns.select("conv_id"), **kw)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_result(rows)


def test_given_rows(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


SCHEMA = "conv_id long, turn long, role string, text string, idx int, audit string, block long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = []
    for i in [None, *range(60)]:
        turns = list(range(rng.randint(1, 9)))
        for t in turns:
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "useless"])
            text = rng.choice(["Yes.", "No!", "cut", "cut ", "\x0b\x0c ", "", None, f"Is it {t}? \n", "ä ö.", f"{t}."])
            rows.append((i, rng.choice([t, t, t, t + 3, None, 0]), role, text, 1, "x", 2))
    rows += [(900, None, "user", "Hi.", 1, "x", 2), (901, 5, "user", "long. " * 200_000, 1, "x", 2), (901, 6, "assistant", "Yes.", 1, "x", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_odd_rows(odd):
    check(odd)


def test_blocks(odd, spark):
    """The same results whatever the block; a long conversation over many."""
    rng = random.Random(9)
    long = [(77, t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"{t}.", "cut", "", "Same."]), 0, "", 0) for t in range(300)]
    check(odd.unionByName(spark.createDataFrame(long, SCHEMA)), block=4)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(none).collect() == []
    only = spark.createDataFrame([(3,), (None,)], "conv_id long")
    nothing = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert sorted((tuple(r) for r in conversations.repair(none, only).collect()), key=repr) == sorted([(3, *nothing), (None, *nothing)], key=repr)


def test_lattice():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(0, 9)
        initials, marks = "".join(rng.choice("suauaua?") for _ in range(n)), "".join(rng.choice("------bdt") for _ in range(n))
        start, ends = rng.choice(conversations.STATES), rng.choice([("-", "a"), ("u",), ("a",), ("s",), ("-",)])
        want = plain_edits(initials, marks, start.strip("-"), tuple(e.strip("-") for e in ends))
        assert conversations.cheapest(initials, marks, start, ends) == want
        for size in (1, 2, 3):
            blocks = [{(a, b): (c, d) for a, b, c, d in conversations._solve(initials[i:i + size], marks[i:i + size], i == 0, i + size >= n)}
                      for i in range(0, n, size)]
            if blocks:
                cost, audits = conversations.chain(blocks)
                assert (cost, "".join(audits)) == plain_edits(initials, marks)


def test_damage_kinds(spark):
    turns = spark.range(200).select((F.col("id") % 7).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("A. b! c?").alias("text"))
    got = sorted((tuple(r) for r in conversations.damage(turns).collect()), key=repr)
    assert got == sorted(plain_damage([tuple(r) for r in turns.collect()]), key=repr)
    assert len({r[2:] for r in got}) == 4 and len(got) != len(set(got))
