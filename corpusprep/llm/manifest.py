"""Merkle dataset manifest as a tree of SHA midstates.

Every row is a leaf; leaves of a source hash upwards in runs of three to the
source's subroot, subroots in runs of three to the root. A parent keeps a copy
of its hash state before each of its children's slots. To fold a changed leaf
upwards the matching copy is resumed with the replacement and the siblings to
its right only; what stands to the left is never hashed again.

Leaves are numbered and dealt to blocks of ``FAN ** depth``. A block is a whole
subtree, so it becomes one node of the next stage, and a task holds one block
whatever a source's size. Going down again, the blocks of the next stage hand
every block its way to the root.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import BROADCAST_BYTES, dense_index
from ..session import checkpoint
from .common import null_last

#: Children of a node, and levels of a block.
FAN, DEPTH = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Subtree:
    """The nodes over some digests, with the copied states of every parent.

    ``depth`` levels are built, or as many as leave one node (None)."""

    def __init__(self, digests: Sequence[bytes], depth: int | None = None):
        self.levels, self.states = [list(digests)], []
        while depth is None and len(self.levels[-1]) > 1 or depth is not None and len(self.states) < depth:
            below, parents, slots = self.levels[-1], [], []
            for at in range(0, len(below), FAN):
                state = sha256()
                for child in below[at:at + FAN]:
                    slots.append(state.copy())
                    state.update(child)
                parents.append(state.hexdigest().encode())
            self.levels.append(parents)
            self.states.append(slots)

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def way(self, at: int) -> list[tuple]:
        """(state before the slot, siblings to the left, siblings to the right) of every level up from ``at``."""
        steps = []
        for below, slots in zip(self.levels, self.states):
            first = at - at % FAN
            steps.append((slots[at], b"".join(below[first:at]), b"".join(below[at + 1:first + FAN])))
            at //= FAN
        return steps


def resume(value: bytes, way: Sequence[tuple]) -> bytes:
    """The node at the end of the way if ``value`` stands at its start."""
    for state, _, right in way:
        state = state.copy()
        state.update(value + right)
        value = state.hexdigest().encode()
    return value


def _way(siblings: str) -> list[tuple]:
    """A way as it travels, its states made again from the left siblings: once a block, then copied for each leaf."""
    return [(sha256(left.encode()), left.encode(), right.encode()) for left, right in json.loads(siblings)]


def _field(name: str, text: Column | None = None) -> Column:
    value = F.col(f"`{name}`").cast("string") if text is None else text
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """The digest of a row's fields: ``-`` for null, else byte count, ``:`` and value. ``changed`` replaces fields."""
    return F.sha2(F.concat(*[_field(c, changed.get(c)) for c in fields]), 256)


def tampered_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text without its line breaks where 2 divides the crc32 of the id (null id: as it is)."""
    text = F.col(f"`{text_col}`")
    return F.when(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


#: The columns that name a group: whether it has a source, and the source.
GROUP = ["flag", "name"]


def _grouped(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / FAN ** depth))


def _tree(rows: pd.DataFrame, depth: int) -> tuple[pd.DataFrame, Subtree]:
    """Blocks of a group with other blocks have all levels, a lone one as many as it needs."""
    rows = rows.sort_values("idx")
    return rows, Subtree([x.encode() for x in rows["digest"]], depth if rows["n"].iloc[0] > FAN ** depth else None)


def _stage_up(nodes: DataFrame, depth: int) -> DataFrame:
    """(flag, name, idx, n, digest) -> the same of the blocks' tops."""
    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows, tree = _tree(rows, depth)
        first = rows.iloc[0]
        return pd.DataFrame({"flag": [first["flag"]], "name": [first["name"]], "idx": [first["block"]],
                             "n": [-(-first["n"] // FAN ** depth)], "digest": [tree.top.decode()]})

    return (_grouped(nodes, depth).groupBy(*GROUP, "block")
            .applyInPandas(top, "flag boolean, name string, idx long, n long, digest string"))


def _stages(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes of every stage, the last of one node a group. A stage has a block's leaves times fewer than the one before."""
    stages = [nodes]
    while (stages[-1].agg(F.max("n")).first()[0] or 0) > 1:
        stages.append(checkpoint(_stage_up(stages[-1], depth)))
    return stages


def _by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what is known of their source; a hot source's rows stay where they are if the sources fit a broadcast."""
    width = sources.agg(F.sum(F.octet_length("name") + 128)).first()[0] or 0
    return rows.join(F.broadcast(sources) if width <= BROADCAST_BYTES else sources, GROUP)


def _with_ways(nodes: DataFrame, ways: DataFrame, depth: int) -> DataFrame:
    return _grouped(nodes, depth).join(ways.withColumnRenamed("idx", "block"), [*GROUP, "block"])


def _stage_down(nodes: DataFrame, ways: DataFrame, depth: int) -> DataFrame:
    """Every node's way to the root, from its block's: (flag, name, idx, way)."""
    def lengthen(rows: pd.DataFrame) -> pd.DataFrame:
        rows, tree = _tree(rows, depth)
        above = json.loads(rows["way"].iloc[0])
        own = [[[left.decode(), right.decode()] for _, left, right in tree.way(at)] + above for at in range(len(rows))]
        return rows[["flag", "name", "idx"]].assign(way=[json.dumps(x) for x in own])

    return (_with_ways(nodes, ways, depth).groupBy(*GROUP, "block")
            .applyInPandas(lengthen, "flag boolean, name string, idx long, way string"))


def _fold(leaves: DataFrame, ways: DataFrame, root: str, proofs: bool, depth: int) -> DataFrame:
    """Folds every leaf's replacement up its own block and on along the block's way."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, tree = _tree(rows, depth)
        above = _way(rows["way"].iloc[0])
        ways = [tree.way(at) + above for at in range(len(rows))]
        out = pd.DataFrame({"id": rows["id"], "leaf": rows["digest"], "subroot": rows["subroot"]})
        out["proof_sha256"] = [sha256(b"".join(left + right for _, left, right in way)).hexdigest() for way in ways]
        out["folded_root"] = [resume(other.encode(), way).decode() for other, way in zip(rows["other"], ways, strict=True)]
        if proofs:
            out["siblings"] = [json.dumps([[left.decode(), right.decode()] for _, left, right in way]) for way in ways]
        return out

    columns = "id string, leaf string, subroot string, proof_sha256 string, folded_root string" + (", siblings string" if proofs else "")
    flat = _with_ways(leaves, ways, depth).withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    out = flat.groupBy(*GROUP, "block").applyInPandas(fold, columns)
    return out.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256",
                      *(["siblings"] if proofs else []), "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def manifest(docs: DataFrame, *, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             changed: Column | None = None, changed_col: str = "text", proofs: bool = True,
             depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the leaf
    with ``changed`` in place of ``changed_col`` and the siblings as they are),
    verified and, with ``proofs``, siblings: for every level up to the root the
    digests left and right of the way, as JSON.

    * Sources ascend bytewise, null first; a source's leaves ascend by id, null
      first, then by digest, so rows that share an id have a fixed order and
      equal rows are interchangeable.
    * null fields are ``-``; empty and very long texts are hashed whole; other
      columns are ignored; an empty table has no root and gives no rows.
    * a single leaf of a source is its subroot, a single subroot the root.

    Texts never move: digests are numbered by ranges of (source, id), in any
    size of source, and worked on in blocks."""
    found = leaf(fields)
    other = found if changed is None else F.when(changed.eqNullSafe(F.col(f"`{changed_col}`")), found).otherwise(leaf(fields, **{changed_col: changed}))
    source = null_last(source_col, "")
    rows = docs.select((~source["n"]).alias("flag"), source["v"].cast("string").alias("name"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       found.alias("digest"), other.alias("other"))
    leaves = checkpoint(dense_index(rows, ["doc_id", "digest", "other"], group_by=GROUP))
    leaves = _by_source(leaves, checkpoint(leaves.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))))
    stages = _stages(leaves.select(*GROUP, "idx", "n", "digest"), depth)
    # the tree over subroots is one group of its own
    subroots = checkpoint(dense_index(stages[-1].select(*GROUP, F.col("digest").alias("subroot")), GROUP, out="nth"))
    nodes = subroots.select(F.lit(True).alias("flag"), F.lit("").alias("name"), F.col("nth").alias("idx"),
                            F.lit(subroots.count()).cast("long").alias("n"), F.col("subroot").alias("digest"))
    upper = _stages(nodes, depth)
    top = upper[-1].first()  # the one digest that stands for the dataset
    ways = upper[-1].select(*GROUP, "idx", F.lit("[]").alias("way"))
    for stage in reversed(upper[:-1]):
        ways = _stage_down(stage, ways, depth)
    ways = subroots.join(ways.select(F.col("idx").alias("nth"), "way"), "nth").select(*GROUP, F.lit(0).cast("long").alias("idx"), "way")
    for stage in reversed(stages[1:-1]):
        ways = _stage_down(stage, ways, depth)
    return _fold(_by_source(leaves, subroots.drop("nth")), ways, top.digest if top else "", proofs, depth)


_CRC = ("list_reduce(list_prepend(4294967295::BIGINT, [unicode(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]), "
        "lambda s, b: xor(s >> 8, list_reduce(list_prepend(xor(s, b) & 255, [0::BIGINT for i in range(8)]), "
        "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))")


def _sql_leaf(text: str) -> str:
    values = [f"{c}::VARCHAR" for c in FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: DuckDB SQL for the manifest of `documents`.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
  {_sql_leaf(f"CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS idx, count(*) OVER (PARTITION BY source) AS many FROM d),
up AS (SELECT 0 AS lvl, source, idx, leaf AS h, many FROM n UNION ALL
  SELECT lvl + 1, source, idx // {FAN}, sha256(string_agg(h, '' ORDER BY idx)), any_value((many + {FAN - 1}) // {FAN}) FROM up WHERE many > 1
  GROUP BY lvl, source, idx // {FAN}),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS many FROM up WHERE many = 1),
top AS (SELECT 0 AS lvl, idx, subroot AS h, many FROM subs UNION ALL
  SELECT lvl + 1, idx // {FAN}, sha256(string_agg(h, '' ORDER BY idx)), any_value((many + {FAN - 1}) // {FAN}) FROM top WHERE many > 1 GROUP BY lvl, idx // {FAN}),
nodes AS (SELECT true AS low, source, lvl, idx, h, many FROM up UNION ALL SELECT false, NULL, lvl, idx, h, many FROM top),
heights AS (SELECT source, max(lvl) AS height FROM up GROUP BY source),
way AS (SELECT n.doc_id, n.source, n.idx AS leaf_idx, n.leaf, n.other, s.subroot, s.idx AS nth, h.height,
    unnest(range(h.height + (SELECT max(lvl) FROM top))) AS step
  FROM n JOIN subs s ON n.source IS NOT DISTINCT FROM s.source JOIN heights h ON n.source IS NOT DISTINCT FROM h.source),
steps AS (SELECT *, step < height AS low, CASE WHEN step < height THEN step ELSE step - height END AS lvl,
    CASE WHEN step < height THEN leaf_idx ELSE nth END // ({FAN} ** CASE WHEN step < height THEN step ELSE step - height END)::BIGINT AS at FROM way),
sib AS (SELECT s.source, s.leaf_idx, s.step, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx < s.at), '') AS l,
    coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx > s.at), '') AS r
  FROM steps s JOIN nodes o ON o.low = s.low AND o.lvl = s.lvl AND o.idx // {FAN} = s.at // {FAN}
   AND (NOT s.low OR o.source IS NOT DISTINCT FROM s.source) GROUP BY s.source, s.leaf_idx, s.step),
proof AS (SELECT source, leaf_idx, string_agg(l || r, '' ORDER BY step) AS p, max(step) AS last FROM sib GROUP BY source, leaf_idx),
fold AS (SELECT source, idx AS leaf_idx, 0 AS step, other AS h FROM n UNION ALL
  SELECT f.source, f.leaf_idx, f.step + 1, sha256(s.l || f.h || s.r) FROM fold f
  JOIN sib s ON s.source IS NOT DISTINCT FROM f.source AND s.leaf_idx = f.leaf_idx AND s.step = f.step),
done AS (SELECT source, leaf_idx, max_by(h, step) AS h FROM fold GROUP BY source, leaf_idx)
SELECT n.doc_id, n.leaf, s.subroot, t.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, d.h AS folded_root, d.h = t.h AS verified
FROM n JOIN subs s ON n.source IS NOT DISTINCT FROM s.source CROSS JOIN (SELECT h FROM top WHERE many = 1) t
JOIN done d ON d.source IS NOT DISTINCT FROM n.source AND d.leaf_idx = n.idx
LEFT JOIN proof p ON p.source IS NOT DISTINCT FROM n.source AND p.leaf_idx = n.idx"""
