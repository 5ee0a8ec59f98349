"""Queries over TEXT (= ``documents``): sources, cleaning, tokens, masking,
schedules, shuffle/shard/batch."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions import constants as K
from ..functions import schedules as S
from ..functions import text as T
from ..functions.rng import uniform
from ..operators import batching as B
from ..operators import clean as C
from ..operators import masking as N
from ..operators import prompts as P
from ..operators import tokens as TK
from ..operators.ordering import dense_index
from ..session import table
from ..sources.shards import limit_rows, read_shards
from . import inputs as I
from . import sqlkit as Q
from .registry import register

R6 = lambda c: F.round(c, 6)
BIG = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


def _docs(spark, sf):
    return table(spark, sf, "documents")


# ------------------------------------------------------------ sources ----
@register("s1_read_shards", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def s1_read_shards(spark, sf):
    return read_shards(spark, [f"{sf}/document{{s}}.parquet"]).select("doc_id", "lang", "source", "n_chars", "text")


@register("s10_limit_rows", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def s10_limit_rows(spark, sf):
    return limit_rows(_docs(spark, sf), 100, ["doc_id"]).select("doc_id", "n_chars")


# ----------------------------------------------------------- cleaning ----
@register("c1_drop_empty", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND text <> ''")
def c1_drop_empty(spark, sf):
    return C.drop_empty(_docs(spark, sf), "text").select("doc_id", "lang")


@register("c3_null_to_empty", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def c3_null_to_empty(spark, sf):
    return C.null_to_empty(_docs(spark, sf), "text").select("doc_id", "text")


@register("c5_drop_missing", "SELECT doc_id FROM documents WHERE text IS NOT NULL")
def c5_drop_missing(spark, sf):
    return C.drop_missing(_docs(spark, sf), "text").select("doc_id")


def _inject_person(col):
    """Tags injected into TEXT: single, upper-case and comma/and runs."""
    t = F.replace(col, F.lit(" the "), F.lit(" <person> "))
    t = F.replace(t, F.lit(" of "), F.lit(" <PERSON>, and <Person> "))
    t = F.replace(t, F.lit(" und "), F.lit(" <Person> and <person> "))
    return F.replace(t, F.lit(" le "), F.lit(" <pErSoN>,<person> "))


def _inject_person_sql(col):
    return (f"replace(replace(replace(replace({col}, ' the ', ' <person> '), ' of ', ' <PERSON>, and <Person> '),"
            f" ' und ', ' <Person> and <person> '), ' le ', ' <pErSoN>,<person> ')")


C4_SQL = f"""
WITH tagged AS (SELECT doc_id, {_inject_person_sql('text')} AS t FROM documents),
runs AS (SELECT doc_id, regexp_replace(t, '{T.PERSON_RUN_RE}', ' people ', 'g') AS t FROM tagged),
parts AS (SELECT doc_id, regexp_split_to_array(t, '{T.PERSON_RE}') AS p FROM runs)
SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE
  ' ' || ['{K.PERSON_WORDS[0]}', '{K.PERSON_WORDS[1]}', '{K.PERSON_WORDS[2]}'][CAST(floor(3 * {Q.u('person', 'doc_id', 'i - 2')}) AS INTEGER) + 1]
  || ' ' || x END), '') AS text
FROM parts
"""


@register("c4_person_scrub", C4_SQL)
def c4_person_scrub(spark, sf):
    d = _docs(spark, sf).select("doc_id", _inject_person(F.col("text")).alias("text"))
    return d.select("doc_id", T.scrub_person_tags(F.col("text"), F.col("doc_id")).alias("text"))


C7_SQL = """
WITH h AS (SELECT sha256(concat_ws(chr(31), text, lang, source, CAST(n_chars AS VARCHAR))) AS hx,
                  lang, source, n_chars FROM documents)
SELECT hx || '#' || CAST(row_number() OVER (PARTITION BY hx) AS VARCHAR) AS id, lang, source, n_chars FROM h
"""


@register("c7_ensure_id", C7_SQL)
def c7_ensure_id(spark, sf):
    d = _docs(spark, sf).drop("doc_id")
    return C.ensure_id(d, ["text", "lang", "source", "n_chars"]).select("id", "lang", "source", "n_chars")


# ------------------------------------------------------------- tokens ----
T1_SQL = f"""
WITH d AS (SELECT doc_id, {Q.tokens('text')}[1:{I.DOC_LEN}] AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM d
"""


@register("t1_tokenise", T1_SQL)
def t1_tokenise(spark, sf):
    d = TK.tokenise(_docs(spark, sf), "text", max_len=I.DOC_LEN)
    return d.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


T3_SQL = f"""
WITH doc_tok AS (SELECT doc_id, {Q.tokens('text')} AS toks FROM documents),
c AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(toks) AS token FROM doc_tok) x
      WHERE NOT regexp_full_match(token, '{Q.MARKER_FULL}') GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 AS BIGINT) AS id, CAST(cnt AS BIGINT) AS count
FROM c QUALIFY id < {K.MAX_WORD_VOCAB}
"""


@register("t3_build_vocab", T3_SQL)
def t3_build_vocab(spark, sf):
    toks = I.explode_rows(I.doc_tokens(spark, sf), "doc_id", "_toks")
    v = TK.build_vocab(toks)
    return v.select("token", BIG("id").alias("id"), BIG("count").alias("count"))


T5_SQL = f"""
WITH {I.DOC_SQL(None)}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos, CAST(token_id AS BIGINT) AS token_id FROM doc_rows
"""


@register("t5_encode", T5_SQL)
def t5_encode(spark, sf):
    r = I.doc_token_rows(spark, sf, None)
    return r.select(BIG("doc_id").alias("doc_id"), BIG("pos").alias("pos"), BIG("token_id").alias("token_id"))


LM_LEN = 512

T6_SQL = f"""
WITH {I.DOC_SQL()},
lens AS (SELECT doc_id, least(len(toks), {I.DOC_LEN}) AS n,
         CASE WHEN len(toks) = 0 THEN 0 WHEN toks[1] = '{K.BOS_TOKEN}' THEN 0 ELSE 1 END AS shift FROM doc_tok)
SELECT CAST(r.doc_id AS BIGINT) AS doc_id, CAST(r.pos + l.shift AS BIGINT) AS pos, r.token
FROM doc_rows r JOIN lens l ON r.doc_id = l.doc_id JOIN vocab v ON r.token = v.token
WHERE v.id < {K.MAX_WORD_VOCAB} AND r.pos + l.shift < {LM_LEN}
"""


@register("t6_decode", T6_SQL)
def t6_decode(spark, sf):
    vocab = I.doc_vocab(spark, sf)
    rows = I.doc_lm_rows(spark, sf, LM_LEN, vocab=vocab).select("doc_id", "pos", F.col("token_id").alias("tid"))
    out = TK.decode_long(rows, vocab, "tid", "token")
    return out.select(BIG("doc_id").alias("doc_id"), BIG("pos").alias("pos"), "token")


@register("t7_special_tokens", f"""
SELECT s.token, CAST(s.id AS BIGINT) AS id, CAST(coalesce(c.n, 0) AS BIGINT) AS uses
FROM {Q.specials_values()} s LEFT JOIN
     (SELECT token, count(*) AS n FROM (SELECT unnest({Q.tokens('text')}) AS token FROM documents) t GROUP BY token) c ON s.token = c.token
""")
def t7_special_tokens(spark, sf):
    """The special tokens with their ids and how often the texts hold them."""
    rows = I.explode_rows(I.doc_tokens(spark, sf), "doc_id", "_toks")
    special = F.broadcast(TK.special_tokens(spark))  # a fixed list
    uses = rows.join(special.select("token"), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return special.join(uses, "token", "left").select("token", BIG("id").alias("id"), F.coalesce(BIG("n"), F.lit(0).cast("bigint")).alias("uses"))


# ------------------------------------------------------------ masking ----
N1_SQL = f"""
WITH {I.DOC_SQL(None)},
m AS (SELECT doc_id, pos, token_id, {Q.u('mask', 'doc_id', 'pos')} < 0.15 AS mk FROM doc_rows)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos,
       CAST(CASE WHEN mk THEN {K.MASK_ID} ELSE token_id END AS BIGINT) AS input_id,
       CAST(CASE WHEN mk THEN token_id ELSE {K.IGNORE_ID} END AS BIGINT) AS label
FROM m
"""


@register("n1_bernoulli_mask", N1_SQL)
def n1_bernoulli_mask(spark, sf, rng="portable"):
    r = N.bernoulli_mask(I.doc_token_rows(spark, sf, None), "doc_id", 0.15, rng=rng)
    return r.select(BIG("doc_id").alias("doc_id"), BIG("pos").alias("pos"),
                    BIG("input_id").alias("input_id"), BIG("label").alias("label"))


TSTEPS = 1000


def _cos_sched_sql(t: str, T: int, start: float, end: float) -> str:
    f0 = math.cos((0.008 / 1.008) * math.pi / 2) ** 2
    ft = f"pow(cos((CAST({t} AS DOUBLE) / {float(T)} + 0.008) / 1.008 * {math.pi / 2!r}), 2)"
    return (f"least(greatest({float(start)!r} + {float(end - start)!r} * (1.0 - sqrt({ft} / {f0!r})), 0.0), 1.0)")


def _t_sql(key: str, T: int = TSTEPS) -> str:
    return f"CAST(least(floor({float(T)} * {Q.u('t', key)}), {T - 1}) AS INTEGER)"


N2_SQL = f"""
WITH {I.DOC_SQL()},
t AS (SELECT doc_id, pos, token_id, {_t_sql('doc_id')} AS t FROM doc_rows),
m AS (SELECT *, {_cos_sched_sql('t', TSTEPS, 0.0, 1.0)} AS mask_ratio FROM t),
k AS (SELECT *, {Q.u('mask', 'doc_id', 'pos')} < mask_ratio AS mk FROM m)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos, CAST(t AS BIGINT) AS t,
       round(mask_ratio, 6) AS mask_ratio,
       CAST(CASE WHEN mk THEN {K.MASK_ID} ELSE token_id END AS BIGINT) AS input_id,
       CAST(CASE WHEN mk THEN token_id ELSE {K.IGNORE_ID} END AS BIGINT) AS label
FROM k
"""


@register("n2_timestep_mask", N2_SQL)
def n2_timestep_mask(spark, sf, rng="portable"):
    r = N.timestep_mask(I.doc_token_rows(spark, sf), "doc_id", timesteps=TSTEPS, schedule="cosine",
                        start=0.0, end=1.0, rng=rng)
    return r.select(BIG("doc_id").alias("doc_id"), BIG("pos").alias("pos"), BIG("t").alias("t"),
                    R6(F.col("mask_ratio")).alias("mask_ratio"),
                    BIG("input_id").alias("input_id"), BIG("label").alias("label"))


N3_SQL = f"""
WITH {I.DOC_SQL()},
padded AS (SELECT doc_id, list_concat(ids, list_transform(range({I.DOC_LEN} - len(ids)), lambda x: {K.PAD_ID})) AS s
           FROM doc_arr),
r AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS token_id, {_t_sql('doc_id')} AS t FROM padded),
z AS (SELECT *, token_id <> {K.PAD_ID} AS nonpad,
      least(greatest(0.0 + (1.0 - 0.0) * (CAST(t AS DOUBLE) / {float(TSTEPS - 1)}), 0.0), 1.0) AS ratio,
      {Q.u('select', 'doc_id', 'pos')} AS uu FROM r),
c AS (SELECT *, sum(CAST(nonpad AS INTEGER)) OVER (PARTITION BY doc_id) AS n,
      row_number() OVER (PARTITION BY doc_id ORDER BY nonpad DESC, uu, pos) AS rk FROM z),
m AS (SELECT *, nonpad AND rk <= CAST(floor(CAST(n AS DOUBLE) * ratio) AS INTEGER) AS mk FROM c)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos,
       CAST(CASE WHEN mk THEN {K.MASK_ID} ELSE token_id END AS BIGINT) AS input_id,
       CAST(CASE WHEN mk THEN token_id ELSE {K.IGNORE_ID} END AS BIGINT) AS label
FROM m
"""


@register("n3_exact_count_mask", N3_SQL)
def n3_exact_count_mask(spark, sf, rng="portable"):
    # Documents are hash-partitioned by id before tokenising: exploding and
    # the broadcast vocabulary join keep that partitioning, so the
    # per-document selection window needs no exchange of the token rows.
    docs = I.doc_tokens(spark, sf, I.DOC_LEN, cluster_by_id=True)
    seq = F.concat("_toks", F.array_repeat(F.lit("[iPAD]"), F.lit(I.DOC_LEN) - F.size("_toks")))
    d = docs.select("doc_id", seq.alias("_s"), N.timestep("doc_id", TSTEPS, rng=rng).alias("t"),
                    F.size(F.array_remove("_toks", "[iPAD]")).alias("_n"))  # non-pad count per document
    rows = AR.explode_rows(d, ["doc_id", "_n", "t"], "_s", out="token")
    rows = TK.encode_long(rows, I.doc_vocab(spark, sf), "token", "token_id")
    ratio = S.selfies_ratio("linear", F.col("t"), TSTEPS, 0.0, 1.0)
    r = N.exact_count_mask(rows, "doc_id", ratio, pad_id=K.PAD_ID, n_col="_n", rng=rng)
    return r.select(BIG("doc_id").alias("doc_id"), BIG("pos").alias("pos"),
                    BIG("input_id").alias("input_id"), BIG("label").alias("label"))


def _lm_rows_sql(L: int = LM_LEN) -> str:
    return f"""
lm AS (SELECT doc_id, CASE WHEN len(ids) = 0 THEN [{K.BOS_ID}] WHEN ids[1] <> {K.BOS_ID}
              THEN list_concat([{K.BOS_ID}], ids) ELSE ids END || [{K.EOS_ID}] AS t FROM doc_arr),
seq AS (SELECT doc_id, CASE WHEN len(t) <= {L} THEN list_concat(t, list_transform(range({L} - len(t)), lambda x: {K.EOS_ID}))
               ELSE t[1:{L}] END AS s FROM lm),
lm_rows AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS token_id FROM seq)"""


N4_SQL = f"""
WITH {I.DOC_SQL()}, {_lm_rows_sql()},
m AS (SELECT *, CAST(0.999 AS DOUBLE) * {Q.u('t', 'doc_id')} + CAST(0.001 AS DOUBLE) AS p_mask FROM lm_rows)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos, CAST(token_id AS BIGINT) AS token_id,
       CAST(CASE WHEN {Q.u('mask', 'doc_id', 'pos')} < p_mask THEN {K.MASK_ID} ELSE token_id END AS BIGINT) AS noisy_id,
       round(p_mask, 6) AS p_mask, CAST({LM_LEN} AS BIGINT) AS answer_len
FROM m
"""


def lm_rows(spark, sf, L=LM_LEN):
    return I.doc_lm_rows(spark, sf, L).select("doc_id", "pos", "token_id")


@register("n4_lm_mask", N4_SQL)
def n4_lm_mask(spark, sf, rng="portable"):
    rows = I.doc_lm_rows(spark, sf, LM_LEN, keep={"_p": N.mask_probability("doc_id", rng=rng)}).select("doc_id", "_p", "pos", "token_id")
    r = N.diffusion_mask(rows, "doc_id", answer_len="attention", seq_len=LM_LEN, p_col="_p", rng=rng)
    return r.select(BIG("doc_id").alias("doc_id"), BIG("pos").alias("pos"), BIG("token_id").alias("token_id"),
                    BIG("noisy_id").alias("noisy_id"), R6(F.col("p_mask")).alias("p_mask"),
                    BIG("answer_len").alias("answer_len"))


N9_SQL = f"""
WITH {I.DOC_SQL(None)},
m AS (SELECT doc_id, pos, {Q.u('mask', 'doc_id', 'pos')} < 0.15 AS mk, {Q.u('t', 'doc_id')} AS t FROM doc_rows)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos,
       round(1.0 - (1.0 - CAST(mk AS DOUBLE)) * ((1.0 - t) * 0.7), 6) AS loss_weight
FROM m
"""


@register("n9_loss_weight", N9_SQL)
def n9_loss_weight(spark, sf, rng="portable"):
    r = N.bernoulli_mask(I.doc_token_rows(spark, sf, None), "doc_id", 0.15, rng=rng)
    w = N.loss_weight(uniform("t", "doc_id", rng=rng), (F.col("label") != K.IGNORE_ID).cast("int"), 0.3)
    return r.select(BIG("doc_id").alias("doc_id"), BIG("pos").alias("pos"), R6(w).alias("loss_weight"))


# ------------------------------------------- masked share and quotas ----
A1_SQL = f"""
WITH {I.DOC_SQL()}, {_lm_rows_sql()},
m AS (SELECT doc_id, CAST(sum(CASE WHEN {Q.u('mask', 'doc_id', 'pos')} < CAST(0.999 AS DOUBLE) * {Q.u('t', 'doc_id')} + CAST(0.001 AS DOUBLE)
      THEN 1 ELSE 0 END) AS BIGINT) AS n_masked, CAST(count(*) AS BIGINT) AS n FROM lm_rows GROUP BY doc_id)
SELECT doc_id, n_masked, CAST(greatest(0, (10 * n_masked + n - 1) // n - 1) AS BIGINT) AS bucket FROM m
"""


def masked_counts(spark, sf, rng="portable"):
    r = N.diffusion_mask(lm_rows(spark, sf), "doc_id", answer_len="attention", seq_len=LM_LEN, rng=rng)
    return r.groupBy("doc_id").agg(
        F.sum((F.col("noisy_id") == K.MASK_ID).cast("int")).cast("bigint").alias("n_masked"),
        F.count(F.lit(1)).cast("bigint").alias("n"))


@register("a1_masked_bucket", A1_SQL)
def a1_masked_bucket(spark, sf, rng="portable"):
    from ..operators.metrics import masked_bucket
    m = masked_counts(spark, sf, rng)
    return m.select(BIG("doc_id").alias("doc_id"), "n_masked",
                    masked_bucket(F.col("n_masked"), F.col("n")).cast("bigint").alias("bucket"))


K4_STEPS = 8
K4_SQL = f"""
WITH {I.DOC_SQL()}, {_lm_rows_sql()},
m AS (SELECT doc_id, CAST(sum(CASE WHEN {Q.u('mask', 'doc_id', 'pos')} < CAST(0.999 AS DOUBLE) * {Q.u('t', 'doc_id')} + CAST(0.001 AS DOUBLE)
      THEN 1 ELSE 0 END) AS BIGINT) AS n_masked FROM lm_rows GROUP BY doc_id)
SELECT doc_id, n_masked, array_to_string(list_transform(range({K4_STEPS}),
       lambda i: n_masked // {K4_STEPS} + CASE WHEN i < n_masked % {K4_STEPS} THEN 1 ELSE 0 END), ',') AS quota
FROM m
"""


@register("k4_transfer_quota", K4_SQL)
def k4_transfer_quota(spark, sf, rng="portable"):
    from ..operators.select import transfer_quota
    m = masked_counts(spark, sf, rng)
    return m.select(BIG("doc_id").alias("doc_id"), "n_masked",
                    F.array_join(transfer_quota(F.col("n_masked"), K4_STEPS), ",").alias("quota"))


# ---------------------------------------------------------- schedules ----
D1_SQL = f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST({_t_sql('doc_id')} AS BIGINT) AS t,
       round(0.0001 + CAST({_t_sql('doc_id')} AS DOUBLE) * {(0.02 - 0.0001) / (TSTEPS - 1)!r}, 6) AS mask_ratio
FROM documents
"""


@register("d1_linear_schedule", D1_SQL)
def d1_linear_schedule(spark, sf, rng="portable"):
    d = _docs(spark, sf).select("doc_id", N.timestep("doc_id", TSTEPS, rng=rng).alias("t"))
    return d.select(BIG("doc_id").alias("doc_id"), BIG("t").alias("t"),
                    R6(S.linear_mask(F.col("t"), TSTEPS, 0.0001, 0.02)).alias("mask_ratio"))


D2_SQL = f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST({_t_sql('doc_id')} AS BIGINT) AS t,
       round({_cos_sched_sql(_t_sql('doc_id'), TSTEPS, 0.0001, 0.02)}, 6) AS mask_ratio
FROM documents
"""


@register("d2_cosine_schedule", D2_SQL)
def d2_cosine_schedule(spark, sf, rng="portable"):
    d = _docs(spark, sf).select("doc_id", N.timestep("doc_id", TSTEPS, rng=rng).alias("t"))
    return d.select(BIG("doc_id").alias("doc_id"), BIG("t").alias("t"),
                    R6(S.cosine_mask(F.col("t"), TSTEPS, 0.0001, 0.02)).alias("mask_ratio"))


def _sig(x):
    return 1.0 / (1.0 + math.exp(-x))


_VS, _VE = _sig(-3.0), _sig(3.0)
D3_SQL = f"""
WITH u AS (SELECT doc_id, {Q.u('r', 'doc_id')} AS t FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id, round(t, 6) AS t,
  round(cos(t * {math.pi / 2!r}), 6) AS r_cosine,
  round(least(greatest(1.0 - t, 1e-6), 1.0), 6) AS r_linear,
  round(least(greatest(1.0 - pow(t, 2.0), 1e-6), 1.0), 6) AS r_pow2,
  round(least(greatest(({_VE!r} - 1.0 / (1.0 + exp(-((t * 6.0 + -3.0) / 1.0)))) / {_VE - _VS!r}, 1e-6), 1.0), 6) AS r_sigmoid
FROM u
"""


@register("d3_ratio_functions", D3_SQL)
def d3_ratio_functions(spark, sf, rng="portable"):
    d = _docs(spark, sf).select("doc_id", uniform("r", "doc_id", rng=rng).alias("t"))
    t = F.col("t")
    return d.select(BIG("doc_id").alias("doc_id"), R6(t).alias("t"),
                    R6(S.ratio("cosine", t)).alias("r_cosine"), R6(S.ratio("linear", t)).alias("r_linear"),
                    R6(S.ratio("pow2", t)).alias("r_pow2"), R6(S.ratio("sigmoid", t)).alias("r_sigmoid"))


D4_SQL = f"""
WITH s AS (SELECT CAST(range AS INTEGER) AS t FROM range({TSTEPS})),
b AS (SELECT t, least(1.0 - pow(cos(((CAST(t AS DOUBLE) + 1.0) / {float(TSTEPS)} + 0.008) / 1.008 * {math.pi / 2!r}), 2)
                 / pow(cos((CAST(t AS DOUBLE) / {float(TSTEPS)} + 0.008) / 1.008 * {math.pi / 2!r}), 2), 0.999) AS beta FROM s),
sab AS (SELECT t, sqrt(exp(sum(ln(1.0 - beta)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS sqrt_alpha_bar FROM b)
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(d.t AS BIGINT) AS t, round(s.sqrt_alpha_bar, 6) AS sqrt_alpha_bar
FROM (SELECT doc_id, {_t_sql('doc_id')} AS t FROM documents) d JOIN sab s ON d.t = s.t
"""


@register("d4_noise_schedule", D4_SQL)
def d4_noise_schedule(spark, sf, rng="portable"):
    sched = S.noise_schedule(spark, "cosine", 0.0001, 0.02, TSTEPS)
    d = _docs(spark, sf).select("doc_id", N.timestep("doc_id", TSTEPS, rng=rng).alias("t"))
    j = d.join(F.broadcast(sched), "t", "inner")  # T rows
    return j.select(BIG("doc_id").alias("doc_id"), BIG("t").alias("t"),
                    R6(F.col("sqrt_alpha_bar")).alias("sqrt_alpha_bar"))


# ----------------------------------------------- shuffle/shard/batch ----
def _shuffled(spark, sf, rng="portable"):
    # only the key is shuffled (and checkpointed); payloads join back by key
    return B.shuffle(_docs(spark, sf).select("doc_id"), "doc_id", rng=rng)


SHUF_SQL = f"(SELECT doc_id, text, row_number() OVER (ORDER BY {Q.u('shuffle', 'doc_id')}, doc_id) - 1 AS idx FROM documents)"


@register("b2_shuffle", f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(idx AS BIGINT) AS idx FROM {SHUF_SQL} s")
def b2_shuffle(spark, sf, rng="portable"):
    return _shuffled(spark, sf, rng).select(BIG("doc_id").alias("doc_id"), BIG("idx").alias("idx"))


@register("b1_assign_shard", f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(idx % 4 AS BIGINT) AS shard FROM {SHUF_SQL} s")
def b1_assign_shard(spark, sf, rng="portable"):
    return B.assign_shard(_shuffled(spark, sf, rng), 4).select(BIG("doc_id").alias("doc_id"),
                                                                 BIG("shard").alias("shard"))


@register("b4_batch_assign", f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(idx // 8 AS BIGINT) AS batch_id FROM {SHUF_SQL} s")
def b4_batch_assign(spark, sf, rng="portable"):
    return B.batch_id(_shuffled(spark, sf, rng), 8).select(BIG("doc_id").alias("doc_id"), "batch_id")


B3_SQL = f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(epoch AS BIGINT) AS epoch,
       CAST(row_number() OVER (PARTITION BY epoch ORDER BY {Q.u('shuffle', 'epoch', 'doc_id')}, doc_id) - 1 AS BIGINT) AS idx
FROM (SELECT doc_id, unnest(range(3)) AS epoch FROM documents) e
"""


@register("b3_epochs", B3_SQL)
def b3_epochs(spark, sf, rng="portable"):
    e = B.epochs(_docs(spark, sf).select("doc_id"), 3)
    s = B.shuffle(e, "doc_id", epoch_col="epoch", rng=rng)
    return s.select(BIG("doc_id").alias("doc_id"), BIG("epoch").alias("epoch"), BIG("idx").alias("idx"))


B5_SQL = f"""
WITH {I.DOC_SQL()},
s AS {SHUF_SQL},
b AS (SELECT a.doc_id, s.idx // 8 AS batch_id, a.ids FROM doc_arr a JOIN s ON a.doc_id = s.doc_id),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS padded_len FROM b)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(padded_len AS BIGINT) AS padded_len,
       array_to_string(list_concat(ids, list_transform(range(padded_len - len(ids)), lambda x: {K.EOS_ID})), ',') AS ids,
       array_to_string(list_concat(ids, list_transform(range(padded_len - len(ids)), lambda x: {K.IGNORE_ID})), ',') AS labels
FROM m
"""


@register("b5_collate", B5_SQL)
def b5_collate(spark, sf, rng="portable"):
    # Documents move once, partitioned by batch; exploding, the broadcast
    # vocabulary join, the regroup by (batch, document) and the batch-max
    # window all reuse that partitioning, so token rows never shuffle.
    s = B.batch_id(_shuffled(spark, sf, rng), 8).select("doc_id", "batch_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = I.doc_tokens(spark, sf, I.DOC_LEN).join(s, "doc_id").repartition(n, "batch_id")
    d = TK.encode(docs, I.doc_vocab(spark, sf), ["batch_id", "doc_id"], tokens_col="_toks", out="ids")
    c = B.collate(d.withColumn("labels", F.col("ids")), "batch_id", ids="ids", labels="labels")
    return c.select(BIG("doc_id").alias("doc_id"), "batch_id", BIG("padded_len").alias("padded_len"),
                    F.array_join("ids", ",").alias("ids"), F.array_join("labels", ",").alias("labels"))


MIX = [("lm", 0.6), ("instruct", 0.4)]
MIX4 = [("cot", 0.25), ("vqa", 0.25), ("clevr2", 0.25), ("geo", 0.25)]

B6_SQL = f"""
WITH s AS (SELECT DISTINCT idx // 8 AS batch_id FROM {SHUF_SQL} x),
u AS (SELECT batch_id, {Q.u('mix', 'batch_id')} AS uu FROM s)
SELECT CAST(batch_id AS BIGINT) AS batch_id,
       CASE WHEN uu < {0.6!r} THEN 'lm' ELSE 'instruct' END AS source,
       CASE WHEN uu < {0.25!r} THEN 'cot' WHEN uu < {0.5!r} THEN 'vqa' WHEN uu < {0.75!r} THEN 'clevr2' ELSE 'geo' END AS source4
FROM u
"""


@register("b6_mix_sources", B6_SQL)
def b6_mix_sources(spark, sf, rng="portable"):
    steps = B.batch_id(_shuffled(spark, sf, rng), 8).select("batch_id").distinct()
    m = B.mix_sources(steps, "batch_id", MIX, rng=rng)
    m = B.mix_sources(m, "batch_id", MIX4, rng=rng, out="source4")
    return m.select(BIG("batch_id").alias("batch_id"), "source", "source4")


I1_SQL = """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey,
       CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS idx
FROM lineitem
"""


@register("i1_dense_index", I1_SQL)
def i1_dense_index(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    d = dense_index(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return d.select(BIG("l_orderkey").alias("l_orderkey"), BIG("l_linenumber").alias("l_linenumber"),
                    BIG("l_partkey").alias("l_partkey"), BIG("l_suppkey").alias("l_suppkey"), BIG("idx").alias("idx"))
