"""Each operator against a plain computation, and on rows that are nothing usual."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from corpusprep.llm import (bpe, components, fingerprints, language, mixing, passages, quality_rules, ranking, sharding, simhash, toxicity)
from corpusprep.llm.common import n_words, words

from .conftest import BIG, LONG, ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _order(x):
    return x is None, x


# 1 mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=_order)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= 2 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(docs):
    rows = mixing.mix_sources(docs, n_words("text")).collect()
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = r.doc.source
        assert r.size == len(WORD.findall(r.doc.text or ""))
        sizes[s] += r.size
        longest[s] = max(longest[s], r.size)
        taken[s] += r.taken
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.doc.source]
        assert r.target == pytest.approx(want[r.doc.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest[s] + 1e-6
    return rows


def test_mix(small, edge):
    rows = check_mix(small)
    again = mixing.mix_sources(small.repartition(7), n_words("text")).collect()
    assert Counter((r.doc.doc_id, r.copies) for r in rows) == Counter((r.doc.doc_id, r.copies) for r in again)
    assert len(check_mix(edge)) == edge.count()


def test_mix_empty_and_repeated(empty, edge):
    assert mixing.mix_sources(empty, n_words("text")).count() == 0
    mixed = mixing.mix_sources(edge, n_words("text"))
    out = mixing.repeated(mixed)
    assert out.columns == edge.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]


# 2 quality rules


def plain_statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(small, edge, texts, edge_rows):
    for docs, want in ((small, texts.items()), (edge, [(r[0], r[1]) for r in edge_rows])):
        got = Counter(tuple(r) for r in quality_rules.statistics(docs.select("doc_id", "text")).select("doc_id", *quality_rules.BASE).collect())
        assert got == Counter((i, *plain_statistics(t)) for i, t in want)


def test_rules_learn_thresholds(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30 + i % 9)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{i}x{j}###" for j in range(30 + i % 9)), 0) for i in range(150)]
    loud = [(2000 + i, " ".join(f"W{i}ABCDEF{j}" for j in range(30 + i % 9)), 0) for i in range(150)]
    rows = [*good, *bad, *loud]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    rules = quality_rules.learn(quality_rules.statistics(docs.join(labels, "doc_id")))
    assert 1 <= len(rules.rules) <= 4 and "reject if" in str(rules)
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels).collect()}
    assert all(kept[i] == (y == 1) for i, _, y in rows)


def test_rules_edges(edge, empty, no_labels):
    rows = quality_rules.apply_rules(edge, no_labels).collect()
    assert len(rows) == edge.count()
    for r in rows:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)
    assert quality_rules.apply_rules(empty, no_labels).count() == 0


# 3 language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixture():
    rng = np.random.default_rng(1)
    source = {"aa": "abcdefgh", "bb": "qrstuvwx", "cc": "aeioumnl"}
    text = lambda lang, n: " ".join("".join(rng.choice(list(source[lang]), 5)) for _ in range(n))
    table = np.full((language.BUCKETS, 3), language.SMOOTHING)
    for j, lang in enumerate(sorted(source)):
        table[:, j] += np.bincount(language.grams(text(lang, 4000).encode()), minlength=language.BUCKETS)
    model = language.Mixture(sorted(source), np.log(table / table.sum(axis=0)).astype(np.float32))
    told = model.predict([text("aa", 200).encode(), (text("bb", 150) + " " + text("cc", 50)).encode(), (text("cc", 40000)).encode()])
    assert [t[0] for t in told] == ["aa", "bb", "cc"]
    assert told[0][1] == 1.0 and "cc" in told[1][2] and 0.65 < told[1][1] < 0.85


def test_language_edges(edge, empty, edge_rows):
    rows = language.identify(edge).collect()
    assert ids(rows) == ids([type("R", (), {"doc_id": r[0]}) for r in edge_rows])
    for r in rows:
        if r.doc_id in (3, 4, 9, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id in (1, 2, 5):
            assert r.lang_pred == "en"
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 4 sharding


def check_shards(docs, shards=24):
    rows = sharding.shard(docs, shards).collect()
    slots, bytes_, biggest = defaultdict(list), defaultdict(int), 0
    for r in rows:
        data = (r.doc.text or "").encode()
        assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
        biggest = max(biggest, r.size)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    total = sum(bytes_.values())
    assert all(abs(b - total / shards) <= 2 * biggest + 0.01 * total / shards for b in bytes_.values())
    return rows


def test_shards_do_not_follow_the_partition_setting(spark, small):
    """Same shards with 3 and 29 shuffle partitions, and each border lies where plain byte quantiles have it:
    within the tolerance, or as near as whole documents allow."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in ("3", "29"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted((r.shard, r.slot, r.doc.doc_id, r["size"]) for r in sharding.shard(small).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    total, below, most = sum(r[3] for r in seen[0]), 0, max(r[3] for r in seen[0])
    for shard in range(24):
        assert abs(below - total * shard / 24) <= max(most / 2, sharding.TOLERANCE * total / 24) + 1
        below += sum(r[3] for r in seen[0] if r[0] == shard)


def test_shards(spark, small, edge, empty):
    assert len(check_shards(small)) == small.count()
    assert len(check_shards(edge, 3)) == edge.count()
    assert sharding.shard(empty).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(
        F.concat(F.lit("text "), "id")).alias("text"))
    rows = check_shards(hot)
    assert len({r.shard for r in rows}) == 24
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    equal = [i for i, r in enumerate(order) if r.doc.text == "the same text"]
    assert equal == list(range(equal[0], equal[0] + 1000))  # copies lie side by side


# 5 fingerprints


def plain_near(a, b):
    cut = lambda t: set(re.findall(r"[^\n]{1,128}", t))
    a, b = cut(a), cut(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def check_fingerprints(docs, rows):
    """rows: (doc_id, text) in descending order of id."""
    got = defaultdict(list)
    for r in fingerprints.fingerprints(docs).collect():
        got[r.doc_id].append(r)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        changed = text[:len(text) - third] + following[:third]
        assert any(r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
                   and r.near_edited == pytest.approx(plain_near(text, changed)) and r.near_next == pytest.approx(plain_near(text, following))
                   for r in got[doc_id]), doc_id
    return got


def test_fingerprints(small, texts):
    got = check_fingerprints(small, sorted(texts.items(), reverse=True))
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(got[i][0].fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)


def test_fingerprints_edges(spark, edge, empty):
    assert len(fingerprints.fingerprints(edge).collect()) == edge.count()
    assert fingerprints.fingerprints(empty).count() == 0
    rows = [(9, LONG), (8, None), (7, ""), (6, "short"), (5, LONG[::-1]), (BIG, "ß" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_fingerprints(docs, sorted(((i, t or "") for i, t in rows), reverse=True))
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_peeling_recovers_every_digest(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in (0, 1, 5, 40, 700):
        a = rng.integers(-2**63, 2**63 - 1, n).tolist()
        rows.append((a, a[: n // 2] + rng.integers(-2**63, 2**63 - 1, n).tolist()))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    cells = [fingerprints.sketch(F.col(c), fingerprints.width_for(F.col(c))) for c in "ab"]
    got = df.select("a", "b", fingerprints.difference(F.col("a"), F.col("b"), *cells).alias("d")).collect()
    for r in got:
        assert sorted(r.d.plus) == sorted(set(r.a) - set(r.b))
        assert sorted(r.d.minus) == sorted(set(r.b) - set(r.a))
        assert r.d.tries > 0  # told by two sketches


def test_two_stored_sketches_tell_versions_apart(spark):
    """Cells alone are enough: no digest array of either text is looked at."""
    rng = np.random.default_rng(4)
    rows = []
    for n in (20, 300, 3000):
        a = rng.integers(-2**63, 2**63 - 1, n).tolist()
        rows.append((a, a[: n - n // 8] + rng.integers(-2**63, 2**63 - 1, n // 8).tolist()))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").withColumn("w", fingerprints.width_for(F.col("a")))
    stored = spark.createDataFrame(df.select("w", *[fingerprints.sketch(F.col(c), F.col("w")).alias(c) for c in "ab"]).collect(),
                                   "w int, " + ", ".join(f"{c} array<struct<at: long, n: long, x: long, c: long>>" for c in "ab"))
    got = stored.select(fingerprints.peel(fingerprints.subtract(F.col("a"), F.col("b")), F.col("w")).alias("d")).collect()
    for (a, b), r in zip(rows, sorted(got, key=lambda r: len(r.d.plus)), strict=True):
        assert r.d.ok and set(r.d.plus) == set(a) - set(b) and set(r.d.minus) == set(b) - set(a)


def test_most_pairs_are_told_by_sketches(small):
    rows = fingerprints.fingerprints(small).select("tries_edited", "tries_next").collect()
    assert sum((r.tries_edited > 0) + (r.tries_next > 0) for r in rows) >= 0.95 * 2 * len(rows)


# 6 toxicity


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        at = rng.choice(60, rng.integers(1, 9), replace=False)
        w = rng.random(len(at)) + 0.1
        vectors.append(dict(zip(at.tolist(), (w / np.sqrt(w @ w)).tolist(), strict=True)))
    index = toxicity.Index([f"t{i}" for i in range(60)], np.ones(60), vectors, rng.integers(0, 2, 700).astype(float), np.arange(700))
    dense = np.zeros((700, 60))
    for e, i in enumerate(index.ids):
        for t, w in vectors[i].items():
            dense[e, t] = w
    for _ in range(60):
        at = np.sort(rng.choice(60, rng.integers(1, 6), replace=False))
        q = rng.random(len(at)) + 0.1
        q /= np.sqrt(q @ q)
        cos = dense[:, at] @ q
        want = np.sort(cos[cos > 0])[::-1][:toxicity.NEIGHBOURS]
        got = index.nearest(at, q)
        assert [x for x, _ in got] == pytest.approx(want.tolist())
        assert [x for x, _ in got] == pytest.approx([cos[e] for _, e in got]) and len({e for _, e in got}) == len(got)
        near = index.nearest(at, q, without=got[0][1])
        assert got[0][1] not in {e for _, e in near}


def toxic_table(spark):
    rng = np.random.default_rng(4)
    plain, rude = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)], ["vilest", "rotten", "stinker"]
    rows = []
    for i in range(1200):
        w = rng.choice(plain, 40).tolist()
        y = int(i % 8 == 0)
        if y:
            w[3::9] = rng.choice(rude, len(w[3::9])).tolist()
        rows.append((i, " ".join(w), y))
    return rows, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(
        [(r[0], r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    rows, docs, labels = toxic_table(spark)
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    one = next(got[i] for i, y in held if y)
    assert len(one.neighbours) == toxicity.NEIGHBOURS and one.cosines == sorted(one.cosines, reverse=True)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_toxicity_edges(edge, empty, no_labels, spark):
    rows = toxicity.scores(edge, no_labels).collect()
    assert len(rows) == edge.count() and all(r.predicted == 0 for r in rows) and BIG in {r.doc_id for r in rows}
    assert toxicity.scores(empty, no_labels).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (5, 0, 0), (5, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.scores(edge, labels).count() == edge.count()
    assert toxicity.without_toxic(edge, no_labels).columns == edge.columns


def test_toxicity_every_text_is_searched(spark):
    """A text without a term that tells the labels apart is compared by all its terms."""
    rows, docs, labels = toxic_table(spark)
    index = toxicity.build(docs, labels, "toxic", toxicity.EXAMPLES)
    known = {r.doc_id for r in labels.collect()}
    train = [(i, toxicity.terms(t)) for i, t, _ in rows if i in known]
    df = Counter(t for _, c in train for t in c)
    text = " ".join([w for w in sorted(df) if w[-1] != "-" and not index.vocabulary.keys() & toxicity.terms(w).keys()][:9])

    def vector(counts):
        w = {t: (1 + np.log(n)) * (np.log((1 + len(train)) / (1 + df[t])) + 1) for t, n in counts.items()}
        return {t: x / np.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}

    asked = vector(toxicity.terms(text))
    want = sorted((sum(w * asked.get(t, 0) for t, w in vector(c).items()) for _, c in train), reverse=True)[:toxicity.NEIGHBOURS]
    score, neighbours, cosines = index.score(text)
    assert score < toxicity.CUT and len(set(neighbours)) == toxicity.NEIGHBOURS and cosines == pytest.approx(want, abs=2e-6)
    assert all(len(index.score(t)[1]) == toxicity.NEIGHBOURS for _, t, _ in rows)
    assert index.score("")[1] == index.score("unheard")[1] == [] and index.score("")[0] < toxicity.CUT


def test_toxicity_learns_from_even_labels(spark):
    """Half of the labels at 1, and more than half."""
    rows, docs, labels = toxic_table(spark)
    known = {r.doc_id for r in labels.collect()}
    for step in (7, 14):
        some = labels.where((F.col("toxic") == 1) | (F.col("doc_id") % step == 0))
        index = toxicity.build(docs, some, "toxic", toxicity.EXAMPLES)
        assert index.labels.mean() > 0.4 and {"vilest", "rotten", "stinker"} <= index.vocabulary.keys()
        asked = [(t, y) for i, t, y in rows if i not in known]
        assert sum((index.score(t)[0] >= toxicity.CUT) == y for t, y in asked) >= 0.95 * len(asked)


# 7 SimHash


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return fp - 2**64 if fp >> 63 else fp


def plain_components(values, distance):
    """values: {node: fingerprint}; the smallest node of each node's component."""
    names, parent = sorted(values), {n: n for n in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(names):
        for b in names[:i]:
            if ((values[a] ^ values[b]) & (2**64 - 1)).bit_count() <= distance:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {n: root(n) for n in names}


def test_simhash(small, texts, edge, empty):
    rows = simhash.near_duplicates(small).collect()
    values = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fp for r in rows} == values
    assert {r.doc_id: r.component_id for r in rows} == plain_components(values, 2)
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 9)} == {3}  # null, empty and blank texts are alike
    assert {r.component_id for r in rows if r.doc_id == 2} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.representatives(edge)
    assert left.columns == edge.columns
    assert Counter((r.doc_id, r.text) for r in left.collect())[None, "a text without an id"] == 1
    assert {r.doc_id for r in left.collect()} >= {1, 3, 5, 10} and left.where("doc_id IN (2, 4, 9)").count() == 0


def test_simhash_joins_near_copies(spark):
    rng = np.random.default_rng(5)
    vocabulary, rows = [f"v{i}" for i in range(2000)], []
    for _ in range(8):
        base = rng.choice(vocabulary, 700).tolist()
        for _ in range(12):
            own = list(base)
            for at in rng.integers(0, 700, rng.integers(0, 6)):
                own[at] = str(rng.choice(vocabulary))
            rows.append((int(rng.integers(0, 10**6)), " ".join(own)))
    rows = list({r[0]: r for r in rows}.values())
    want = plain_components({i: plain_fingerprint(t) for i, t in rows}, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) < len(rows) / 2
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == set(want.values())


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("paired", [0, 4, 32])
def test_links_lose_nothing(spark, monkeypatch, distance, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(distance)
    values = set()
    for _ in range(12):
        base = int(rng.integers(0, 2**63))
        for _ in range(14):
            x = base
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            values.add(x - 2**64 if x >> 63 else x)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.component for r in components.components(simhash.links(fps, distance)).collect()}
    want = plain_components({v: v for v in values}, distance)
    assert {v: got.get(v, v) for v in values} == want


def test_allocation_sums_and_skips():
    parts = [list(range(0, 22)), list(range(22, 43)), list(range(43, 64))]
    _, even = simhash.allocate(parts, [10, 10, 10], np.full(64, 0.5), 1000, 2)
    assert even == [0, 0, 0]
    _, skewed = simhash.allocate(parts, [10**9, 10, 10], np.full(64, 0.5), 1000, 2)
    assert sum(skewed) == 0 and skewed[0] == -1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (99, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {99: 99, 100: 99}
    assert components.components(links.limit(0)).count() == 0


# 8 passages


def plain_passages(rows):
    """(id, text) rows: sorted (id, bytes, removed, spans, digest of the rest)."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, data in rows:
        for p in range(len(data) - 49):
            s = data[p:p + 50]
            first[s] = min(first.get(s, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, data in rows:
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p:p + 50]] < (2**63 - 1 if i is None else i):
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found_passages(docs):
    rows = passages.passages(docs).collect()
    return Counter((r.doc.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("chunk, batch", [(4 << 20, 1 << 20), (60_000, 1_000)])
def test_passages(small, texts, monkeypatch, chunk, batch):
    monkeypatch.setattr(passages, "CHUNK", chunk)
    monkeypatch.setattr(passages, "BATCH", batch)
    assert found_passages(small) == plain_passages(texts.items())


def test_passages_edges(spark, edge, empty, edge_rows, monkeypatch):
    assert found_passages(edge) == plain_passages([(r[0], r[1]) for r in edge_rows])
    assert passages.passages(empty).count() == 0
    monkeypatch.setattr(passages, "CHUNK", 700)
    rng = np.random.default_rng(6)
    base = "".join(rng.choice(list("abc "), 400))
    rows = [(int(i), ("=" * int(rng.integers(0, 120))) + base[a:a + int(rng.integers(40, 110))] + "ß€"[: i % 3] + base[b:b + 50])
            for i, a, b in zip(range(60), rng.integers(0, 300, 60), rng.integers(0, 300, 60), strict=True)]
    assert found_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain_passages(rows)
    cut = passages.without_repeats(edge)
    assert cut.columns == edge.columns and cut.count() == edge.count()
    assert [r.text for r in cut.where("doc_id = 8").collect()] == [""]
    assert [r.text for r in cut.where(F.col("doc_id") == BIG).collect()] == ["äöü\U0001F600 ß"]  # the spaces around it repeat too


# 9 ranking


def test_ranking_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = ranking.rank(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_ranking_edges(edge, empty, no_labels, spark):
    rows = ranking.rank(edge, no_labels).collect()
    assert len(rows) == edge.count() and all(r.score is not None for r in rows)
    assert ranking.rank(empty, no_labels).count() == 0
    labels = spark.createDataFrame([(1, None), (5, 1), (5, 1), (10, 0), (None, 0)], "doc_id long, quality int")
    assert ranking.rank(edge, labels).count() == edge.count()


# 10 BPE


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(bpe.RANKS_FILE)
    return bpe.Encoder(ranks), tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(both, texts):
    mine, library = both
    rng = np.random.default_rng(7)
    letters = [*map(chr, range(0x250)), *"aeinorst" * 60, *" \n\t" * 30, "՘", "₞", "　", "\U0001F600", "'s", "'LL"]
    odd = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)]
    runs = ["a" * 500, "ab" * 300, " " * 90 + "x", "\n" * 77, "=" * 333, "0" * 200, "<|endoftext|>", "", "é" * 300, LONG[:50_000]]
    for text in [*texts.values(), *odd, *runs]:
        got = mine.encode(text)
        assert got == library.encode_ordinary(text)
        assert mine.decode(got) == text.encode()


def test_bpe_every_code_point_class(both):
    mine, library = both
    for start in range(0, 0x110000, 0x800):
        text = "".join(f"a{chr(c)}'s1{chr(c)} " for c in range(start, start + 0x800) if not 0xD800 <= c < 0xE000)
        assert mine.encode(text) == library.encode_ordinary(text)


def test_bpe_edges(edge, empty, edge_rows, both):
    _, library = both
    want = Counter()
    for r in edge_rows:
        tokens = library.encode_ordinary(r[1] or "")
        want[r[0], len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(edge).collect()) == want
    assert bpe.digests(empty).count() == 0
    rows = bpe.encode(edge).collect()
    assert all(bytes(r.decoded).decode() == (t or "") for r in rows for i, t in [next((x[0], x[1]) for x in edge_rows if x[0] == r.doc_id and (x[1] or "") == bytes(r.decoded).decode())])


def test_words_rule(spark, edge_rows):
    docs = spark.createDataFrame([(r[1],) for r in edge_rows] + [("a\x0bb\x0cc\x1cd e",)], "text string")
    for r in docs.select("text", words("text").alias("w")).collect():
        assert r.w == WORD.findall(r.text or "")


@pytest.mark.parametrize("key", ["op1_mix_sources", "op8_passages"])
def test_oracles(spark, smoke_dir, key):
    from corpusprep.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{smoke_dir}/documents.parquet'")
    got = QUERIES[key](spark, smoke_dir)
    want = con.execute(ORACLES[key])
    assert got.columns == [c[0] for c in want.description]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())


# ------------------------------------------------------------- learned models against plain forms


def test_ranking_like_plain_descent(spark):
    """Weights, cut and scores equal those of plain gradient descent on the same preference pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, len(ranking.FEATURES))).round(2)
    y = (x[:, 0] - x[:, 2] + rng.normal(size=80) > -0.8).astype(int)
    table = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], ["label", *ranking.FEATURES]).coalesce(1)
    model = ranking.learn(table)
    columns = []
    for j, name in enumerate(ranking.FEATURES):
        cuts = sorted({float(np.quantile(x[:, j], i / ranking.BINS)) for i in range(1, ranking.BINS)})
        assert cuts == model.cuts[name]
        bins = [sum(c < v for c in cuts) for v in x[:, j]]
        columns += [[float(b == k) for b in bins] for k in range(len(cuts) + 1)]
    hot = np.array(columns).T
    good, bad = np.flatnonzero(y), np.flatnonzero(1 - y)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    draws = np.random.default_rng(0).integers(0, len(many), len(few) * ranking.OPPONENTS)
    pairs = [(few[n // ranking.OPPONENTS], many[d]) for n, d in enumerate(draws)]
    pairs = [(b, a) if few is bad else (a, b) for a, b in pairs]  # (better, worse)
    diff = np.array([hot[a] - hot[b] for a, b in pairs])
    w = np.zeros(hot.shape[1])
    for _ in range(20_000):
        w += 0.3 * (diff.T @ (1 / (1 + np.exp(diff @ w))) / len(diff) - ranking.RIDGE * w)
    assert np.allclose(np.concatenate([model.weights[n] for n in ranking.FEATURES]), w, atol=1e-5)
    raw = hot @ w
    assert abs(model.place - np.quantile(raw, len(bad) / len(y))) < 1e-4
    scored = table.withColumn("raw", model.raw()).withColumn("score", model.score()).toPandas()
    assert np.allclose(scored["raw"], raw, atol=1e-4)
    assert set(np.flatnonzero(scored["score"] >= ranking.CUT)) >= set(np.flatnonzero(raw > model.place + 1e-3))
    assert not set(np.flatnonzero(scored["score"] >= ranking.CUT)) & set(np.flatnonzero(raw < model.place - 1e-3))


def plain_counts(text):
    """Hashed trigrams of a text, byte by byte."""
    data = [32, *text.encode(), 32]
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in data]
    grams = [(data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32 >> 16 for i in range(len(data) - 2)]
    return Counter(grams)


def test_language_model_and_sets_by_brute_force(small):
    """The counts equal plain ones, and no single language and no pair of them, each fitted by long plain
    expectation maximisation, has a better penalised likelihood than the set that was chosen."""
    names, logs = language.fit(small)
    rows = small.collect()
    learned = [r for r in rows if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    table = np.full((language.BUCKETS, len(names)), language.SMOOTHING)
    for r in learned:
        for gram, n in plain_counts(r.text).items():
            table[gram, names.index(r.lang)] += n
    assert names == sorted({r.lang for r in learned}) and np.allclose(logs, np.log(table / table.sum(axis=0)), atol=1e-4)

    def penalised(counts, among, iterations=300):
        p = np.exp(logs[list(counts)][:, among].astype(float))
        n, part = np.array(list(counts.values()), float), np.full(len(among), 1 / len(among))
        for _ in range(iterations):
            part = part * ((n / (p @ part)) @ p) / n.sum()
        penalty = language.PENALTY + 0.5 * np.log(max(n.sum() * language.INDEPENDENT, 1))
        return float(n @ np.log(p @ part)) * language.INDEPENDENT - (len(among) - 1) * penalty

    texts = [r.text for r in rows if r.text][:60]
    texts += [a + " " + b for a, b in zip(texts[:20], texts[20:40])]
    told = language.Mixture(names, logs).predict([t.encode() for t in texts])
    sizes = Counter()
    for text, (top, share, spelled) in zip(texts, told):
        parts = {x.rpartition(":")[0]: float(x.rpartition(":")[2]) for x in spelled.split()}
        assert top == max(parts, key=parts.get) and abs(parts[top] - share) < 1e-3
        counts, chosen = plain_counts(text), [names.index(x) for x in parts]
        every = range(len(names))
        best = max(penalised(counts, s) for s in [[i] for i in every] + [[i, j] for i in every for j in every if i < j])
        assert penalised(counts, chosen) >= best - 0.5, (spelled, text[:80])
        sizes[len(chosen)] += 1
    assert sizes[1] and len(sizes) > 1


def test_ranking_repeated_ids(spark):
    """The sample is that of the join of all rows, whatever repeats; a frequent id does not empty it."""
    docs = spark.createDataFrame([(k % 5, "word " * (k % 7 + 1) + "## " * (k % 3)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 5, k % 2) for k in range(40)], "doc_id long, quality int")
    known = labels.select("doc_id", labels.quality.alias("label"))
    got = ranking._examples(docs, known, 300).toPandas()
    whole = ranking._features(docs.join(known, "doc_id")).orderBy(F.xxhash64("doc_id"), *ranking.FEATURES, "label").limit(300).toPandas()
    flat = got.loc[np.repeat(got.index, got["times"])].head(300)
    assert flat[["label", *ranking.FEATURES]].values.tolist() == whole[["label", *ranking.FEATURES]].values.tolist()
    ids = spark.range(200).where(F.xxhash64("id") > 0).where(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2).limit(2).collect()
    hot = spark.createDataFrame([(ids[0].id, 1)] * 50 + [(ids[1].id, 0)] * 3, "doc_id long, quality int")
    two = spark.createDataFrame([(ids[0].id, "Good words in a line"), (ids[1].id, "## ## ##")], "doc_id long, text string")
    scores = {r.score for r in ranking.rank(two, hot, labelled_rows=53).collect()} | {r.score for r in ranking.rank(two, hot, labelled_rows=10).collect()}
    assert sum(r.times for r in ranking._examples(two, hot.select("doc_id", hot.quality.alias("label")), 10).collect()) >= 10
    assert len(scores) > 1


def test_ranking_labels_without_documents(spark):
    """Labels whose document is missing do not use up the rows that are learned from."""
    ids = [r.id for r in spark.range(400).where(~ranking.held_out("id")).orderBy(F.xxhash64("id")).collect()]
    docs = spark.createDataFrame([(i, "Good words in a line" if i % 2 else "## ## ##") for i in ids[-100:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    assert sum(r.times for r in ranking._examples(docs, labels.select("doc_id", labels.quality.alias("label")), 40).collect()) == 40
    assert all(r.predicted == r.doc_id % 2 for r in ranking.rank(docs, labels, labelled_rows=40).collect())


def test_ranking_repeated_words(spark):
    """Texts that differ in repeated words only are told apart."""
    words = "one two three four five six seven eight nine ten".split()
    plain, repeats = " ".join([*words, *words[::-1]]), " ".join(words * 2)
    docs = spark.createDataFrame([(i, plain if i % 2 else repeats) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    assert all(r.predicted == r.doc_id % 2 for r in ranking.rank(docs, labels).collect())


def test_texts_without_words_under_ansi(spark):
    """Shares of nothing are 0 where a division by zero is an error."""
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "Some words in a line")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, quality int")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        assert ranking.rank(docs, labels).count() == len(ranking.rank(docs, labels).collect()) == 4
        assert [r.kept for r in quality_rules.apply_rules(docs, labels).orderBy("doc_id").collect()] == [False] * 4
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
