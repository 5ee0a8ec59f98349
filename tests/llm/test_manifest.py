"""The Merkle manifest against hashing from the leaves up, and against a full rebuild with one leaf changed."""

import json
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from corpusprep.llm import manifest

FIELDS = manifest.FIELDS


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i:i + 3]) for i in range(0, len(below), 3)])
    return levels


def plain_proof(levels, at):
    out = []
    for below in levels[:-1]:
        first = at - at % 3
        out.append(["".join(below[first:at]), "".join(below[at + 1:first + 3])])
        at //= 3
    return out


def plain_fold(value, proof):
    for left, right in proof:
        value = H(left, value, right)
    return value


def plain_manifest(rows):
    """rows of FIELDS -> (doc_id, leaf, subroot, root, proof, folded, verified), sorted."""
    groups = defaultdict(list)
    for row in rows:
        i, text = row[0], row[4]
        changed = text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        groups[row[1]].append((i is not None, i, plain_leaf(row), plain_leaf((*row[:4], text.replace("\n", "") if changed else text))))
    trees, found = {}, []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        groups[source].sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        trees[source] = plain_levels([x[2] for x in groups[source]])
    top = plain_levels([t[-1][0] for t in trees.values()])
    for nth, (source, tree) in enumerate(trees.items()):
        for at, (_, i, leaf, other) in enumerate(groups[source]):
            proof = plain_proof(tree, at) + plain_proof(top, nth)
            folded = plain_fold(other, proof)
            found.append((i, leaf, tree[-1][0], top[-1][0], H(*[x for step in proof for x in step]), folded, folded == top[-1][0], proof))
    return sorted(found, key=repr)


def check(docs, plain, **kw):
    got = manifest.manifest(docs, changed=manifest.tampered_text(), **kw).collect()
    want = plain_manifest(plain)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified, json.loads(r.siblings)) for r in got), key=repr) == want
    return got


def test_manifest(spark, small):
    got = check(small, [tuple(r) for r in small.select(*FIELDS).collect()])
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("depth", [1, 2])
def test_blocks_and_stages(spark, depth):
    """Sources of 1 to 40 leaves over blocks of 3 and 9: several stages, last runs of one node."""
    rows = [(100 * n + k, f"s{n}", "en", 3, f"a\nb{k}") for n in (1, 3, 4, 9, 10, 28, 40) for k in range(n)]
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3), rows, depth=depth)


def test_edges(spark, edge, empty):
    docs = edge.withColumn("n_chars", F.length("text")).withColumn("leaf", F.lit("x")).withColumn("idx", F.lit(1))
    check(docs, [tuple(r) for r in docs.select(*FIELDS).collect()])
    assert manifest.manifest(empty.withColumn("n_chars", F.lit(1)), changed=manifest.tampered_text()).collect() == []


def test_single_leaf(spark):
    row = (7, None, None, None, "")
    got = check(spark.createDataFrame([row], "doc_id long, source string, lang string, n_chars long, text string"), [row])
    assert got[0].root == got[0].leaf and got[0].proof_sha256 == H("") and got[0].verified


def test_states_are_resumed_not_rebuilt():
    digests = [H(str(i)).encode() for i in range(20)]
    tree = manifest.Subtree(digests)
    for at in range(20):
        other = H("other").encode()
        want = manifest.Subtree([*digests[:at], other, *digests[at + 1:]]).top
        way = [(state, b"not needed", right) for state, _, right in tree.way(at)]
        assert manifest.resume(other, way) == want and manifest.resume(digests[at], way) == tree.top
