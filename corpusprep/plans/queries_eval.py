"""Evaluation losses (A8), the molecule convert job (M9) and the
buffer-mode shuffle (B2)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..functions import schedules as S
from ..operators import batching as B
from ..operators import masking as N
from ..operators import metrics as A
from ..session import checkpoint, table
from ..sources.shards import read_shards
from . import inputs as I
from . import sqlkit as Q
from .jobs import convert_molecules, molecule_training_feed
from .registry import register

from ..functions import constants as K  # noqa: E402
from ..operators.molecules import ELEMENTS as M_ELEMENTS  # noqa: E402

T_NOISE = 1000
COEFFS = {"coords_coeff": 1.0, "atom_type_coeff": 0.5, "selfies_coeff": 1.0, "alignment_coeff": 0.1}


def _noised_atoms(spark, sf, rng="portable"):
    sched = S.noise_schedule(spark, "linear", 0.0001, 0.02, T_NOISE)
    a = I.mol_atoms_all(spark, sf).withColumn("t", N.timestep("mol", T_NOISE, rng=rng))
    return N.coordinate_noise(a, "mol", "t", sched, rng=rng)


def _noise_sql() -> str:
    box = lambda i: (f"sqrt(-2.0 * ln(greatest({Q.u(f'coord{i}:bm1', 'mol', 'atom_idx')}, 1e-20))) * "  # noqa: E731
                     f"cos(2.0 * {math.pi!r} * {Q.u(f'coord{i}:bm2', 'mol', 'atom_idx')})")
    cols = ", ".join(f"(sa * CAST({c} AS DOUBLE) + sqrt(greatest(1.0 - sa * sa, 0.0)) * {box(i)}) AS {c}_t"
                     for i, c in enumerate("xyz"))
    return f"""{I.MOL_ALL_SQL},
s AS (SELECT CAST(range AS INTEGER) AS t FROM range({T_NOISE})),
b AS (SELECT t, 0.0001 + CAST(t AS DOUBLE) * {(0.02 - 0.0001) / (T_NOISE - 1)!r} AS beta FROM s),
sab AS (SELECT t, sqrt(exp(sum(ln(1.0 - beta)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS sa FROM b),
a AS (SELECT *, CAST(least(floor({float(T_NOISE)} * {Q.u('t', 'mol')}), {T_NOISE - 1}) AS INTEGER) AS t FROM atoms),
noised AS (SELECT a.*, {cols} FROM a JOIN sab ON a.t = sab.t)"""


A8_SQL = f"""
WITH {_noise_sql()}, {I.LOGITS_SQL},
lsm AS (SELECT *, ln(list_sum(list_transform(logits, lambda w: exp(w - list_max(logits))))) + list_max(logits) AS lse FROM logits),
parts AS (
  SELECT 'coords_loss' AS loss, sum((x_t - x) * (x_t - x) + (y_t - y) * (y_t - y) + (z_t - z) * (z_t - z)) / (count(*) + 1e-5) AS value FROM noised
  UNION ALL
  SELECT 'atom_type_loss', avg(-(logits[label + 1] - lse)) FROM lsm WHERE label <> 0
  UNION ALL
  SELECT 'selfies_loss', avg(-(logits[label + 1] - lse)) FROM lsm WHERE {Q.u('mask', 'vec_id')} < 0.5
  UNION ALL
  SELECT 'alignment_loss', avg(d) FROM (SELECT unnest(list_transform(range(len(logits)),
         lambda i: (logits[i + 1] - list_reverse(logits)[i + 1]) * (logits[i + 1] - list_reverse(logits)[i + 1]))) AS d FROM logits) q)
SELECT loss, round(value, 6) AS value FROM parts
UNION ALL
SELECT 'total_loss', round(sum(CASE loss WHEN 'coords_loss' THEN 1.0 WHEN 'atom_type_loss' THEN 0.5
       WHEN 'selfies_loss' THEN 1.0 WHEN 'alignment_loss' THEN 0.1 ELSE 1.0 END * value), 6) FROM parts
"""


@register("a8_evaluation_losses", A8_SQL)
def a8_evaluation_losses(spark, sf, rng="portable"):
    atoms = _noised_atoms(spark, sf, rng)
    lg = I.logits(spark, sf)
    losses = [A.coords_loss(atoms, ["x", "y", "z"], ["x_t", "y_t", "z_t"])]
    losses.append(A.class_ce_loss(lg, "logits", "label", 0, "atom_type_loss"))
    if COEFFS.get("selfies_coeff", 1.0) > 0:
        tok = lg.withColumn("target", F.when(uniform("mask", "vec_id", rng=rng) < 0.5, F.col("label"))
                            .otherwise(F.lit(-100)))
        losses.append(A.class_ce_loss(tok, "logits", "target", -100, "selfies_loss"))
    if COEFFS.get("alignment_coeff", 1.0) > 0:
        losses.append(A.alignment_loss(lg.withColumn("rev", F.reverse("logits")), "logits", "rev"))
    out = A.evaluate(losses, COEFFS)
    return out.select("loss", F.round("value", 6).alias("value"))


def _bond_sql(i: str, j: str) -> str:
    code = lambda a: f"(CASE {a} % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END)"
    return f"(CASE WHEN {j} = {i} + 1 THEN {code(i)} WHEN {i} = {j} + 1 THEN {code(j)} ELSE 0 END)"


# Gate of the convert job: some molecules of every scale are over it.
CONVERT_GATE = 6

M9_SQL = f"""
WITH {I.MOL_SQL_UP_TO(CONVERT_GATE)},
z AS (SELECT a.*, coalesce(CASE WHEN regexp_full_match(a.symbol, '[0-9]+') THEN CAST(a.symbol AS INTEGER) END, e.z, 0) AS zn
      FROM atoms a LEFT JOIN (SELECT * FROM (VALUES {", ".join(f"('{s}', {k + 1})" for k, s in enumerate(M_ELEMENTS))})
      AS el(symbol, z)) e ON a.symbol = e.symbol),
pair AS (SELECT a.mol, a.atom_idx AS i, b.atom_idx AS j,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d,
         CASE WHEN abs(a.atom_idx - b.atom_idx) = 1 THEN 1 ELSE 0 END AS edge, {_bond_sql('a.atom_idx', 'b.atom_idx')} AS bond
         FROM atoms a JOIN atoms b ON a.mol = b.mol),
prow AS (SELECT mol, i, list(d ORDER BY j) AS d, list(edge ORDER BY j) AS e, list(bond ORDER BY j) AS b
         FROM pair GROUP BY mol, i),
mats AS (SELECT mol, list(d ORDER BY i) AS dist, list(e ORDER BY i) AS edge, list(b ORDER BY i) AS bond
         FROM prow GROUP BY mol),
av AS (SELECT mol, list(zn ORDER BY atom_idx) AS v, list([x, y, z] ORDER BY atom_idx) AS c,
       string_agg('[' || symbol || ']', '' ORDER BY atom_idx) AS selfies FROM z GROUP BY mol)
SELECT CAST(av.mol AS VARCHAR) AS id, selfies AS selfies_string, coalesce(o.o_orderpriority, '') AS text_description,
       CAST(to_json(v) AS VARCHAR) AS atom_vec_str, CAST(to_json(c) AS VARCHAR) AS coordinates_str,
       CAST(to_json(edge) AS VARCHAR) AS edge_type_str, CAST(to_json(bond) AS VARCHAR) AS bond_type_str,
       CAST(to_json(dist) AS VARCHAR) AS dist_str, '[]' AS rdmol2selfies_str
FROM av JOIN mats ON av.mol = mats.mol LEFT JOIN orders o ON av.mol = o.o_orderkey
UNION ALL BY NAME
SELECT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem GROUP BY l_orderkey HAVING count(*) > {CONVERT_GATE}
"""


def _convert(spark, sf, max_atoms):
    """The convert job over all molecules; a molecule's description stands in its order."""
    text = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mol"), F.col("o_orderpriority").alias("text_description"))
    atoms = I.mol_lines(spark, sf).withColumn("atom_idx", F.struct(*I._ATOM_ORDER))  # any type that orders the atoms
    return convert_molecules(atoms, descriptions=text, max_atoms=max_atoms)


@register("m9_convert_job", M9_SQL)
def m9_convert_job(spark, sf):
    """Molecules over the gate stay in the result as rejects: their id alone."""
    rejects = I.mol_rejects(spark, sf, CONVERT_GATE).select(F.col("mol").cast("string").alias("id"))
    return _convert(spark, sf, CONVERT_GATE)[0].unionByName(rejects, allowMissingColumns=True)


@register("m9_convert_counts", f"""
SELECT CASE WHEN n > {CONVERT_GATE} THEN 'too_many_atoms' ELSE 'ok' END AS reason, CAST(count(*) AS BIGINT) AS n
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) m GROUP BY 1
""")
def m9_convert_counts(spark, sf):
    return _convert(spark, sf, CONVERT_GATE)[1].select("reason", F.col("n").cast("bigint"))


B2_BUFFER = 100
B2_SQL = f"""
WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rif FROM documents),
o AS (SELECT doc_id, rif // {B2_BUFFER} AS buf, {Q.u('shuffle', 'doc_id')} AS uu FROM f)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(row_number() OVER (ORDER BY buf, uu, doc_id) - 1 AS BIGINT) AS idx FROM o
"""


@register("b2_buffer_shuffle", B2_SQL)
def b2_buffer_shuffle(spark, sf, rng="portable"):
    d = read_shards(spark, f"{sf}/documents.parquet", with_file=True).select("doc_id", "source_file")
    s = B.shuffle(d, "doc_id", mode="buffer", buffer_size=B2_BUFFER, rng=rng)
    return s.select(F.col("doc_id").cast("bigint"), F.col("idx").cast("bigint"))


def _e2_sql() -> str:
    from .queries_text import _cos_sched_sql
    t_expr = f"CAST(least(floor(1000.0 * {Q.u('t', 'id')}), 999) AS INTEGER)"
    return f"""
WITH {I.DOC_SQL()}, {I.MOL_SQL},
z AS (SELECT a.*, CAST(a.mol AS VARCHAR) AS id,
      coalesce(CASE WHEN regexp_full_match(a.symbol, '[0-9]+') THEN CAST(a.symbol AS INTEGER) END, e.z, 0) AS zn
      FROM atoms a LEFT JOIN (SELECT * FROM (VALUES {", ".join(f"('{s}', {k + 1})" for k, s in enumerate(M_ELEMENTS))})
      AS el(symbol, z)) e ON a.symbol = e.symbol),
alpha AS (SELECT DISTINCT '[' || symbol || ']' AS token FROM z),
missing AS (SELECT token FROM alpha WHERE token NOT IN (SELECT token FROM vocab)),
ext AS (SELECT token, (SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY token) AS id FROM missing),
v2 AS (SELECT token, id FROM vocab UNION ALL SELECT token, id FROM ext),
tok AS (SELECT z.id, z.atom_idx AS pos, coalesce(v2.id, {K.UNK_ID}) AS token_id
        FROM z LEFT JOIN v2 ON '[' || z.symbol || ']' = v2.token WHERE z.atom_idx < 64),
tt AS (SELECT *, {t_expr} AS t FROM tok),
mr AS (SELECT *, {_cos_sched_sql('t', 1000, 0.0, 1.0)} AS ratio FROM tt),
mk AS (SELECT *, {Q.u('mask', 'id', 'pos')} < ratio AS m FROM mr),
seqs AS (SELECT id, any_value(t) AS timestep,
         list(CASE WHEN m THEN {K.MASK_ID} ELSE token_id END ORDER BY pos) AS ids,
         list(CASE WHEN m THEN token_id ELSE {K.IGNORE_ID} END ORDER BY pos) AS labels FROM mk GROUP BY id),
av AS (SELECT id, list(zn ORDER BY atom_idx) AS v FROM z GROUP BY id),
ord AS (SELECT id, row_number() OVER (ORDER BY {Q.u('shuffle', 'id')}, id) - 1 AS idx FROM av),
txt AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, {Q.tokens('o_orderpriority')} AS toks FROM orders),
txi AS (SELECT x.id, list(coalesce(v2.id, {K.UNK_ID}) ORDER BY x.i) AS ids
        FROM (SELECT id, unnest(toks) AS token, unnest(range(len(toks))) AS i FROM txt) x LEFT JOIN v2 ON x.token = v2.token GROUP BY x.id)
SELECT array_to_string(coalesce(x.ids, []), ',') AS text_ids, s.id, CAST(o.idx AS BIGINT) AS idx, CAST(o.idx // 2 AS BIGINT) AS batch_id, CAST(s.timestep AS BIGINT) AS timestep,
       array_to_string(s.ids, ',') AS ids, array_to_string(s.labels, ',') AS labels,
       array_to_string(list_concat(a.v, list_transform(range({I.MAX_ATOMS} - len(a.v)), lambda q: 0)), ',') AS atom_vec
FROM seqs s JOIN av a ON s.id = a.id JOIN ord o ON s.id = o.id LEFT JOIN txi x ON s.id = x.id
"""


@register("e2_molecule_feed", _e2_sql())
def e2_molecule_feed(spark, sf, rng="portable"):
    """E2 end to end on converted MOL records: parse, gate, SELFIES ids with
    the timestep mask, padded atoms, shuffled batches."""
    from ..operators import tokens as TK
    from ..functions import arrays as AR
    # written once, without the matrices that the feed does not ask for
    records = checkpoint(_convert(spark, sf, I.MAX_ATOMS)[0].select("id", "selfies_string", "text_description", "atom_vec_str", "coordinates_str"))
    base = I.doc_vocab(spark, sf)
    alpha = AR.explode_rows(TK.tokenise_selfies(records.select("id", "selfies_string"), "selfies_string"),
                            ["id"], "tokens", out="token")
    vocab = base.unionByName(TK.extend_vocab(base, alpha))
    feed = molecule_training_feed(records, vocab, max_atoms=I.MAX_ATOMS, max_selfies_len=64, rng=rng)
    return feed.select("id", F.array_join(F.transform("text_input_ids", lambda v: v.cast("string")), ",").alias("text_ids"),
                       F.col("idx").cast("bigint"), F.col("batch_id").cast("bigint"),
                       F.col("timestep").cast("bigint"),
                       F.array_join(F.transform("selfies_input_ids", lambda v: v.cast("string")), ",").alias("ids"),
                       F.array_join(F.transform("true_selfies_labels", lambda v: v.cast("string")), ",").alias("labels"),
                       F.array_join(F.transform("atom_vec", lambda v: v.cast("string")), ",").alias("atom_vec"))
