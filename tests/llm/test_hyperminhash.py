"""HyperMinHash near-duplicates against comparing all pairs of sets."""

import random
import re
from collections import Counter

import numpy as np

from corpusprep.llm import hyperminhash

from .conftest import LONG

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def plain_set(text):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w)


def plain_result(rows):
    """[(id, text)] -> Counter of (id, set size, component, kept)."""
    sets = sorted({plain_set(t) for _, t in rows} - {frozenset()}, key=len)
    parent = {s: s for s in sets}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[k + 1:]:
            if 100 * len(a) < 80 * len(b):
                break
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None and (s := plain_set(t)):
            least[find(s)] = min(i, least.get(find(s), i))
    out = Counter()
    for i, t in rows:
        s = plain_set(t)
        c = least.get(find(s)) if s else i
        out[i, len(s), c, i == c] += 1
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(docs).collect())
    assert got == plain_result(rows)
    return got


def test_given_rows(small):
    got = check(small)
    assert any(not kept for *_, kept in got)


def test_edges(spark, edge, empty):
    check(edge)
    assert hyperminhash.near_duplicates(empty).collect() == []


def test_border_of_similarity(spark):
    """Texts whose similarity lies just on, above and below 0.8, in every class of size."""
    rng = random.Random(2)
    rows, at = [], 0
    for length in [5, 6, 9, 14, 40, 120, 500, 2000] * 5:
        base = [f"w{rng.randrange(10**9)}" for _ in range(length)]
        rows.append((at, " ".join(base)))
        for share in (0.02, 0.05, 0.1, 0.11, 0.12, 0.15, 0.2, 0.21, 0.3):
            cut = base[:max(int(length * (1 - share)), 1)]
            rows += [(at + 1, " ".join(cut)), (at + 2, " ".join(cut + [f"x{rng.randrange(10**9)}" for _ in range(length - len(cut))]))]
            at += 2
        at += 1
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_large_groups(spark):
    """Hundreds of near copies and of copies, and a word pair that many texts share."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1:])) for i in range(400) for k in [rng.randrange(60)]]
    rows += [(1000 + i, "Same text again. " * 4) for i in range(300)]
    rows += [(2000 + i, "so far " + " ".join(f"r{rng.randrange(10**9)}" for _ in range(rng.choice([1, 2, 3, 8, 20])))) for i in range(300)]
    rows += [(3000, LONG), (3001, LONG + " end"), (3002, LONG.upper())]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


def test_family_below_the_similarity(spark, monkeypatch):
    """Copies of one text that are unlike it and each other, and some that are alike, are found without pairing all."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]

    def changed(words, k, tag):
        at = set(rng.sample(range(len(words)), k))
        return [f"{tag}{i}" if i in at else w for i, w in enumerate(words)]

    rows = [(0, " ".join(base))] + [(1 + i, " ".join(changed(base, 4, f"n{i}_"))) for i in range(120)]
    for i in range(120):  # about 0.7 like the base; every fourth has a partner
        far = changed(base, 14, f"f{i}_")
        rows += [(1000 + 2 * i, " ".join(far))] + [(1001 + 2 * i, " ".join(changed(far, 3, f"g{i}_")))] * (i % 4 == 0)
    asked, verified = [], hyperminhash._verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(hyperminhash, "_verified", counted)
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sum(i == c for i, _, c, _ in got) < 150 and sum(i != c and i >= 1000 for i, _, c, _ in got) >= 30
    assert sum(asked) < 4 * len(rows)  # all pairs: over 20,000


def test_registers_estimate():
    rng = np.random.default_rng(4)
    for n, share in ((200, 0.0), (200, 0.5), (3000, 0.8), (3000, 0.0), (90, 0.9)):
        guesses = []
        for _ in range(60):
            both = int(n * 2 * share / (1 + share))
            x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            cls = int(hyperminhash.size_class(np.array([n]))[0])
            regs = [hyperminhash.registers(s, np.array([0, len(s)]), cls) for s in (x[:n], x[n - both:])]
            size = np.array([float(n)])
            guesses.append(hyperminhash.estimate(*regs, size, size, np.array([float(hyperminhash.buckets(cls))]))[0])
        true = both / (2 * n - both)
        assert abs(np.mean(guesses) - true) < 0.02 and max(abs(np.array(guesses) - true)) < 0.2


def test_chance_of_equal_registers(monkeypatch):
    """With few mantissa bits unlike sets often agree; the correction takes that away."""
    monkeypatch.setattr(hyperminhash, "MANTISSA", 2)
    rng = np.random.default_rng(4)
    guesses, raw = [], []
    for _ in range(40):
        regs = [hyperminhash.registers(rng.integers(0, 2**63, 1000).astype(np.uint64), np.array([0, 1000]), 7) for _ in range(2)]
        size = np.array([1000.0])
        guesses.append(hyperminhash.estimate(*regs, size, size, np.array([192.0]))[0])
        raw.append((regs[0] == regs[1]).mean())
    assert np.mean(raw) > 0.03 and abs(np.mean(guesses)) < 0.015


def test_compressed():
    least = np.array([1, 2, 3, 1 << 31, (1 << 32) - 1, 1 << 32, (1 << 33)])
    got = hyperminhash.compress(least)
    assert got[-1] == 0 and len(set(got.tolist())) == 7 and (got[:-1] > 0).all()
