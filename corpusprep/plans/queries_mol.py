"""Queries over MOL (= ``lineitem``: molecule = order, atoms = its lines,
xyz = quantity/discount/tax, symbol = return flag): M1-M9, C2, C6, N7, T2, T4."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.rng import uniform
from ..functions import schedules as S
from ..operators import clean as C
from ..operators import masking as N
from ..operators import molecules as M
from ..operators import tokens as TK
from ..operators.ordering import top_k_per_group
from ..session import table
from . import inputs as I
from . import sqlkit as Q
from .registry import register

R6 = lambda c: F.round(c, 6)
MAXA = I.MAX_ATOMS


def _elements_sql() -> str:
    rows = ", ".join(f"('{s}', {i + 1})" for i, s in enumerate(M.ELEMENTS))
    return f"(SELECT * FROM (VALUES {rows}) AS e(symbol, z))"


_Z = f"""
atoms_z AS (SELECT a.*, coalesce(CASE WHEN regexp_full_match(a.symbol, '[0-9]+') THEN CAST(a.symbol AS INTEGER) END,
            e.z, 0) AS atomic_num FROM atoms a LEFT JOIN {_elements_sql()} e ON a.symbol = e.symbol)"""
ATOMS_Z_SQL = f"{I.MOL_SQL},{_Z}"
LARGE = "UNION ALL BY NAME SELECT CAST(mol AS BIGINT) AS mol FROM mol_large"


def _with_rejects(df, spark, sf):
    """Molecules over the gate stay visible: a row each, without values."""
    return df.unionByName(I.mol_rejects(spark, sf).select(F.col("mol").cast("bigint")), allowMissingColumns=True)


def _atoms_z(spark, sf):
    return M.atom_numbers(I.mol_atoms(spark, sf))


@register("m1_atom_to_id", f"""
WITH {I.MOL_ALL_SQL},{_Z}
SELECT CAST(mol AS BIGINT) AS mol, CAST(atom_idx AS BIGINT) AS atom_idx, CAST(atomic_num AS BIGINT) AS atomic_num FROM atoms_z
""")
def m1_atom_to_id(spark, sf):
    a = M.atom_numbers(I.mol_atoms_all(spark, sf))
    return a.select(F.col("mol").cast("bigint"), F.col("atom_idx").cast("bigint"), F.col("atomic_num").cast("bigint"))


M4_SQL = f"""
WITH {ATOMS_Z_SQL}
SELECT CAST(mol AS BIGINT) AS mol, CAST(count(*) AS BIGINT) AS n_atoms,
       string_agg(CAST(atomic_num AS VARCHAR), ',' ORDER BY atom_idx) AS atom_vec,
       string_agg(printf('%.4f,%.4f,%.4f', x, y, z), ';' ORDER BY atom_idx) AS coords
FROM atoms_z GROUP BY mol
{LARGE}
"""


def _coord_str(c):
    return F.format_string("%.4f,%.4f,%.4f", c[0], c[1], c[2])


@register("m4_atom_features", M4_SQL)
def m4_atom_features(spark, sf):
    m = M.molecule_arrays(_atoms_z(spark, sf))
    m = m.select(F.col("mol").cast("bigint"), F.size("atom_vec").cast("bigint").alias("n_atoms"),
                 F.array_join(F.transform("atom_vec", lambda v: v.cast("string")), ",").alias("atom_vec"),
                 F.array_join(F.transform("coords", _coord_str), ";").alias("coords"))
    return _with_rejects(m, spark, sf)


M5_SQL = f"""
WITH {I.MOL_SQL},
p AS (SELECT a.mol, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
      FROM atoms a JOIN atoms b ON a.mol = b.mol)
SELECT CAST(mol AS BIGINT) AS mol, CAST(count(*) AS BIGINT) AS cells, round(sum(d), 6) AS dist_sum, round(max(d), 6) AS dist_max
FROM p GROUP BY mol
{LARGE}
"""


@register("m5_pairwise_distance", M5_SQL)
def m5_pairwise_distance(spark, sf):
    m = M.molecule_arrays(_atoms_z(spark, sf)).withColumn("dist", M.distance_matrix(F.col("coords")))
    flat = F.flatten("dist")
    m = m.select(F.col("mol").cast("bigint"), F.size(flat).cast("bigint").alias("cells"),
                 R6(F.aggregate(flat, F.lit(0.0), lambda a, v: a + v)).alias("dist_sum"),
                 R6(F.array_max(flat)).alias("dist_max"))
    return _with_rejects(m, spark, sf)


M6_SQL = f"""
WITH {I.MOL_ALL_SQL},
b AS (SELECT a.mol, a.atom_idx AS i, c.atom_idx AS j,
      CASE (a.atom_idx % 5) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS bond_type
      FROM atoms a JOIN atoms c ON a.mol = c.mol AND c.atom_idx = a.atom_idx + 1),
e AS (SELECT mol, i, j, bond_type FROM b UNION SELECT mol, j AS i, i AS j, bond_type FROM b)
SELECT CAST(mol AS BIGINT) AS mol, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(1 AS BIGINT) AS edge,
       CAST(bond_type AS BIGINT) AS bond_type FROM e
"""


def _edges(spark, sf):
    return M.bond_edges(M.chain_bonds(I.mol_atoms_all(spark, sf)))


@register("m6_bond_edges", M6_SQL)
def m6_bond_edges(spark, sf):
    e = _edges(spark, sf)
    return e.select(*[F.col(c).cast("bigint") for c in ("mol", "i", "j", "edge", "bond_type")])


M7_SQL = f"""
WITH {ATOMS_Z_SQL},
g AS (SELECT mol, list(atomic_num ORDER BY atom_idx) AS v, list(x + 2 * y + 3 * z ORDER BY atom_idx) AS c FROM atoms_z GROUP BY mol)
SELECT CAST(mol AS BIGINT) AS mol,
       array_to_string(list_concat(v, list_transform(range({MAXA} - len(v)), lambda q: 0)), ',') AS atom_vec,
       array_to_string(list_transform(range({MAXA}), lambda i: CASE WHEN i < len(v) THEN 1 ELSE 0 END), '') AS atoms_mask,
       CAST(len(v) AS BIGINT) AS n_atoms, round(list_sum(c), 6) AS coord_sum
FROM g
{LARGE}
"""


@register("m7_pad_atoms", M7_SQL)
def m7_pad_atoms(spark, sf):
    m = M.molecule_arrays(_atoms_z(spark, sf))
    ids, xyz, mask = M.pad_atoms(F.col("atom_vec"), F.col("coords"), MAXA)
    m = m.select("mol", ids.alias("ids"), xyz.alias("xyz"), mask.alias("mask"))
    m = m.select(F.col("mol").cast("bigint"), F.array_join(F.transform("ids", lambda v: v.cast("string")), ",")
                    .alias("atom_vec"),
                    F.array_join(F.transform("mask", lambda b: F.when(b, "1").otherwise("0")), "").alias("atoms_mask"),
                    F.size(F.filter("mask", lambda b: b)).cast("bigint").alias("n_atoms"),
                    R6(F.aggregate("xyz", F.lit(0.0), lambda a, p: a + p[0] + 2 * p[1] + 3 * p[2])).alias("coord_sum"))
    return _with_rejects(m, spark, sf)


M8_SQL = f"""
WITH {I.MOL_SQL},
b AS (SELECT a.mol, a.atom_idx AS i, c.atom_idx AS j,
      CASE (a.atom_idx % 5) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS bond_type
      FROM atoms a JOIN atoms c ON a.mol = c.mol AND c.atom_idx = a.atom_idx + 1),
e AS (SELECT mol, i, j, bond_type FROM b UNION SELECT mol, j AS i, i AS j, bond_type FROM b)
SELECT CAST(m.mol AS BIGINT) AS mol, CAST({MAXA * MAXA} AS BIGINT) AS cells,
       CAST(count(*) FILTER (WHERE bond_type <> 0) AS BIGINT) AS nnz,
       CAST(coalesce(sum((i * {MAXA} + j) * bond_type), 0) AS BIGINT) AS weighted
FROM mol_ok m LEFT JOIN e ON m.mol = e.mol GROUP BY m.mol
{LARGE}
"""


@register("m8_densify", M8_SQL)
def m8_densify(spark, sf):
    atoms = I.mol_atoms(spark, sf)
    d = M.densify(M.bond_edges(M.chain_bonds(atoms)), "bond_type", MAXA, molecules=atoms.where("atom_idx = 0").select("mol"))
    flat = F.flatten("bond_type")
    d = d.select(F.col("mol").cast("bigint"), F.size(flat).cast("bigint").alias("cells"),
                    F.size(F.filter(flat, lambda v: v != 0)).cast("bigint").alias("nnz"),
                    F.aggregate(F.transform(flat, lambda v, k: v.cast("long") * k), F.lit(0).cast("long"),
                                lambda a, v: a + v).alias("weighted"))
    return _with_rejects(d, spark, sf)


# ------------------------------------------ JSON records, gate, reasons ----
def records(spark, sf, rng="portable"):
    """Converted-record stand-in: the JSON strings of every molecule of at
    most GATE atoms, whole, with some rows corrupted (malformed JSON, no atoms,
    a ragged coordinate) chosen by ``u('corrupt', mol)``."""
    li = I.mol_lines(spark, sf).join(I.mol_rejects(spark, sf, GATE).select("mol"), "mol", "left_anti")
    g = li.groupBy("mol").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "symbol", "x", "y", "z"))).alias("a"))
    u = uniform("corrupt", "mol", rng=rng)
    atom_str = F.to_json(F.transform("a", lambda r: r["symbol"]))
    coord_str = F.to_json(F.transform("a", lambda r: F.array(r["x"], r["y"], r["z"])))
    atom_str = (F.when(u < 0.02, F.lit("[")).when(u < 0.04, F.lit("[]")).otherwise(atom_str))
    coord_str = F.when((u >= 0.04) & (u < 0.06), F.regexp_replace(coord_str, r"\]\]$", ",1.0]]")) \
                 .otherwise(coord_str)
    return g.select("mol", atom_str.alias("atom_vec_str"), coord_str.alias("coordinates_str"))


# Gate of the converted records: molecules up to the raw maximum pass, the
# stand-in's widest orders (sf-dependent) are rejected with too_many_atoms.
GATE = 6

C2_SQL = f"""
WITH raw AS (SELECT l_orderkey AS mol, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS s,
             list([l_quantity, l_discount, l_tax] ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS c
             FROM lineitem GROUP BY l_orderkey),
u AS (SELECT mol, len(s) AS n, s, c, {Q.u('corrupt', 'mol')} AS uu FROM raw),
r AS (SELECT mol, n, CASE WHEN uu < 0.02 THEN NULL WHEN uu < 0.04 THEN [] ELSE s END AS s,
      CASE WHEN uu >= 0.02 AND uu < 0.04 THEN c
           WHEN uu >= 0.04 AND uu < 0.06 THEN list_concat(c[1:len(c) - 1], [list_concat(c[len(c)], [1.0])]) ELSE c END AS c FROM u)
SELECT CAST(mol AS BIGINT) AS mol,
  CASE WHEN n > {GATE} THEN 'too_many_atoms'
       WHEN s IS NULL OR c IS NULL THEN 'parse_error' WHEN len(s) = 0 THEN 'no_atoms'
       WHEN len(c) <> len(s) OR NOT list_bool_and(list_transform(c, lambda t: len(t) = 3)) THEN 'shape_mismatch'
       ELSE 'ok' END AS reason
FROM r
"""


def _gated(spark, sf, rng="portable"):
    """Every molecule with its reason: too large by a partial count, else from the parsed record."""
    p = M.parse_record(records(spark, sf, rng))
    p = p.withColumn("reason", C.validity(F.col("atom_vec"), F.col("coordinates"), GATE))
    large = I.mol_rejects(spark, sf, GATE).select("mol", F.lit("too_many_atoms").alias("reason"))
    return p.unionByName(large, allowMissingColumns=True)


@register("c2_validity_gate", C2_SQL)
def c2_validity_gate(spark, sf, rng="portable"):
    return _gated(spark, sf, rng).select(F.col("mol").cast("bigint"), "reason")


C6_SQL = f"""
WITH g AS ({C2_SQL})
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY reason
"""


@register("c6_quarantine_counts", C6_SQL)
def c6_quarantine_counts(spark, sf, rng="portable"):
    return C.reason_counts(_gated(spark, sf, rng)).select("reason", F.col("n").cast("bigint"))


M2_SQL = f"""
WITH g AS ({C2_SQL}),
raw AS (SELECT l_orderkey AS mol, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS s
        FROM lineitem GROUP BY l_orderkey),
a AS (SELECT raw.mol, unnest(range(len(raw.s))) AS atom_idx, unnest(raw.s) AS symbol
      FROM raw JOIN g ON raw.mol = g.mol WHERE g.reason = 'ok')
SELECT CAST(a.mol AS BIGINT) AS mol, CAST(a.atom_idx AS BIGINT) AS atom_idx,
       CAST(coalesce(CASE WHEN regexp_full_match(a.symbol, '[0-9]+') THEN CAST(a.symbol AS INTEGER) END, e.z, 0) AS BIGINT)
       AS atomic_num
FROM a LEFT JOIN {_elements_sql()} e ON a.symbol = e.symbol
"""


@register("m2_parse_records", M2_SQL)
def m2_parse_records(spark, sf, rng="portable"):
    ok, _ = C.split_quarantine(_gated(spark, sf, rng))
    a = I.explode_rows(ok, "mol", "atom_vec", pos="atom_idx", out="symbol")
    z = M.atom_numbers(a)
    return z.select(F.col("mol").cast("bigint"), F.col("atom_idx").cast("bigint"), F.col("atomic_num").cast("bigint"))


M3_SQL = f"""
WITH {ATOMS_Z_SQL},
pair AS (SELECT a.mol, a.atom_idx AS i, b.atom_idx AS j,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
         FROM atoms a JOIN atoms b ON a.mol = b.mol),
drow AS (SELECT mol, i, list(d ORDER BY j) AS r FROM pair GROUP BY mol, i),
dm AS (SELECT mol, list(r ORDER BY i) AS dist FROM drow GROUP BY mol),
av AS (SELECT mol, list(atomic_num ORDER BY atom_idx) AS v, list([x, y, z] ORDER BY atom_idx) AS c
       FROM atoms_z GROUP BY mol)
SELECT CAST(av.mol AS BIGINT) AS mol, CAST(to_json(v) AS VARCHAR) AS atom_vec_str,
       CAST(to_json(c) AS VARCHAR) AS coords_str, CAST(to_json(dist) AS VARCHAR) AS dist_str
FROM av JOIN dm ON av.mol = dm.mol
{LARGE}
"""


@register("m3_serialize_records", M3_SQL)
def m3_serialize_records(spark, sf):
    m = M.molecule_arrays(_atoms_z(spark, sf)).withColumn("dist", M.distance_matrix(F.col("coords")))
    m = M.to_json_record(m, ["atom_vec", "coords", "dist"]).select(F.col("mol").cast("bigint"), "atom_vec_str", "coords_str", "dist_str")
    return _with_rejects(m, spark, sf)


# ------------------------------------------------------------ N7 ----
T7 = 1000
N7_SQL = f"""
WITH {I.MOL_ALL_SQL},
s AS (SELECT CAST(range AS INTEGER) AS t FROM range({T7})),
b AS (SELECT t, 0.0001 + CAST(t AS DOUBLE) * {(0.02 - 0.0001) / (T7 - 1)!r} AS beta FROM s),
sab AS (SELECT t, sqrt(exp(sum(ln(1.0 - beta)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS sa FROM b),
a AS (SELECT *, CAST(least(floor({float(T7)} * {Q.u('t', 'mol')}), {T7 - 1}) AS INTEGER) AS t FROM atoms),
j AS (SELECT a.*, sab.sa FROM a JOIN sab ON a.t = sab.t)
SELECT CAST(mol AS BIGINT) AS mol, CAST(atom_idx AS BIGINT) AS atom_idx,
  {', '.join(f"round((sa * CAST({c} AS DOUBLE) + sqrt(greatest(1.0 - sa * sa, 0.0)) * sqrt(-2.0 * ln(greatest({Q.u(f'coord{i}:bm1', 'mol', 'atom_idx')}, 1e-20))) * cos(2.0 * {math.pi!r} * {Q.u(f'coord{i}:bm2', 'mol', 'atom_idx')})) * 1.0, 6) + 0.0 AS {c}_t" for i, c in enumerate('xyz'))}
FROM j
"""


@register("n7_coord_noise", N7_SQL)
def n7_coord_noise(spark, sf, rng="portable"):
    sched = S.noise_schedule(spark, "linear", 0.0001, 0.02, T7)
    a = I.mol_atoms_all(spark, sf).withColumn("t", N.timestep("mol", T7, rng=rng))
    r = N.coordinate_noise(a, "mol", "t", sched, rng=rng)
    return r.select(F.col("mol").cast("bigint"), F.col("atom_idx").cast("bigint"),
                    *[(R6(F.col(f"{c}_t")) + F.lit(0.0)).alias(f"{c}_t") for c in "xyz"])  # no -0.0


# ----------------------------------------------------------- T2, T4 ----
def _selfies_str():
    return F.concat(F.lit("["), F.col("l_returnflag"), F.lit("][="), F.col("l_linestatus"), F.lit("]"),
                    F.when(F.col("l_quantity") > 25, F.lit("[Branch1][C]")).otherwise(F.lit("[Ring1]")))


SELFIES_SQL = ("('[' || l_returnflag || '][=' || l_linestatus || ']' || "
               "CASE WHEN l_quantity > 25 THEN '[Branch1][C]' ELSE '[Ring1]' END)")

T2_SQL = f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, regexp_extract_all({SELFIES_SQL}, '(\\[[^\\]]*\\])', 1) AS toks FROM lineitem)
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_partkey AS BIGINT) AS l_partkey, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM s
"""


@register("t2_selfies_tokens", T2_SQL)
def t2_selfies_tokens(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("selfies", _selfies_str())
    t = TK.tokenise_selfies(li, "selfies")
    return t.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint"),
                    F.col("l_partkey").cast("bigint"), F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


T4_SQL = f"""
WITH {I.DOC_SQL()},
alpha AS (SELECT DISTINCT unnest(regexp_extract_all({SELFIES_SQL}, '(\\[[^\\]]*\\])', 1)) AS token FROM lineitem),
missing AS (SELECT token FROM alpha WHERE token NOT IN (SELECT token FROM vocab)),
base AS (SELECT max(id) AS b FROM vocab)
SELECT token, CAST(b + row_number() OVER (ORDER BY token) AS BIGINT) AS id FROM missing, base
"""


@register("t4_extend_vocab", T4_SQL)
def t4_extend_vocab(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("selfies", _selfies_str())
    alpha = I.explode_rows(TK.tokenise_selfies(li, "selfies"), "l_orderkey", "tokens")
    new = TK.extend_vocab(I.doc_vocab(spark, sf), alpha)
    return new.select("token", F.col("id").cast("bigint"))


# ------------------------------------------------------------ J1 + P12 ----
# Job parameter: the questions asked of every molecule.
QUESTIONS = ["What is the molecular formula of this molecule?",
             "Describe the structure of this molecule in detail.",
             "Which functional groups does it contain?"]


#: Atoms of a molecule that are gathered at once.
PIECE = 1_024


def _q_values_sql() -> str:
    rows = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))
    return f"(SELECT * FROM (VALUES {rows}) AS q(q_idx, question))"


J1_SQL = f"""
WITH {I.DOC_SQL()}, {I.MOL_ALL_SQL},
sym AS (SELECT mol, list('[' || symbol || ']' ORDER BY atom_idx) AS toks FROM atoms GROUP BY mol),
alpha AS (SELECT DISTINCT unnest(toks) AS token FROM sym),
missing AS (SELECT token FROM alpha WHERE token NOT IN (SELECT token FROM vocab)),
ext AS (SELECT token, (SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY token) AS id FROM missing),
v2 AS (SELECT token, id FROM vocab UNION ALL SELECT token, id FROM ext),
su AS (SELECT mol, unnest(toks) AS token, unnest(range(len(toks))) AS i FROM sym),
sel AS (SELECT su.mol, list(coalesce(v2.id, {K.UNK_ID}) ORDER BY su.i) AS ids FROM su LEFT JOIN v2 ON su.token = v2.token GROUP BY su.mol),
qt AS (SELECT q_idx, {Q.tokens('question')} AS toks FROM {_q_values_sql()} qv),
qu AS (SELECT q_idx, unnest(toks) AS token, unnest(range(len(toks))) AS i FROM qt),
qi AS (SELECT qu.q_idx, list(coalesce(v2.id, {K.UNK_ID}) ORDER BY qu.i) AS ids FROM qu LEFT JOIN v2 ON qu.token = v2.token GROUP BY qu.q_idx)
SELECT CAST(sel.mol AS BIGINT) AS mol, CAST(qi.q_idx AS BIGINT) AS q_idx,
       array_to_string(list_concat([{K.MMU_ID}, {K.SOM_ID}], sel.ids, [{K.EOM_ID}, {K.BOS_ID}], qi.ids), ',') AS ids
FROM sel CROSS JOIN qi
"""


@register("j1_molecule_questions", J1_SQL)
def j1_molecule_questions(spark, sf):
    from ..operators.joins import ask_questions
    from ..operators.prompts import molecule_question
    atoms = I.mol_atoms_all(spark, sf).select("mol", "atom_idx", F.concat(F.lit("["), F.col("symbol"), F.lit("]")).alias("token"))
    base = I.doc_vocab(spark, sf)
    vocab = base.unionByName(TK.extend_vocab(base, atoms))
    # molecules of any size: pieces first, so that no task sorts all atoms of a molecule
    pieces = (TK.encode_long(atoms, vocab).groupBy("mol", F.floor(F.col("atom_idx") / PIECE).alias("piece"))
              .agg(F.array_sort(F.collect_list(F.struct("atom_idx", "token_id"))).alias("_s")))
    sel = (pieces.groupBy("mol").agg(F.array_sort(F.collect_list(F.struct("piece", F.col("_s.token_id").alias("ids")))).alias("_p"))
           .select("mol", F.flatten(F.col("_p.ids")).alias("selfies_ids")))
    qs = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "q_idx int, question string")
    q_ids = TK.encode(TK.tokenise(qs, "question"), vocab, "q_idx", out="question_ids").select("q_idx", "question_ids")
    asked = ask_questions(sel, QUESTIONS).join(F.broadcast(q_ids), "q_idx")  # <= MAX_QUESTIONS rows
    seq = molecule_question(F.col("selfies_ids"), F.col("question_ids"))
    return asked.select(F.col("mol").cast("bigint"), F.col("q_idx").cast("bigint"),
                        F.array_join(F.transform(seq, lambda v: v.cast("string")), ",").alias("ids"))
