"""Sequence-builder queries (P0, P3-P6, P8-P11, C9) over TEXT ids and the
image-code stand-in (a code for every value of an embedding, paired with the document
of the same id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions import constants as K
from ..functions.rng import uniform
from ..operators import batching as B
from ..operators import clean as C
from ..operators import prompts as P
from ..session import table
from . import inputs as I
from . import sqlkit as Q
from .registry import register

TEXT_LEN = 128
SEQ_LEN = 512
DROP_P = 0.1


def _ints(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def _pairs(spark, sf):
    """(doc_id, ids, image): documents with the image of the same id."""
    return I.doc_ids(spark, sf).join(I.images(spark, sf).withColumnRenamed("vec_id", "doc_id"), "doc_id")


# ----------------------------------------------------------- SQL kit ----
def rep(v, n: str) -> str:
    return f"list_transform(range(CAST(greatest({n}, 0) AS BIGINT)), lambda q: {v})"


def with_bos(ids: str) -> str:
    return (f"(CASE WHEN len({ids}) = 0 THEN [{K.BOS_ID}] WHEN {ids}[1] <> {K.BOS_ID} "
            f"THEN list_concat([{K.BOS_ID}], {ids}) ELSE {ids} END)")


def pad_or_cut(t: str, L: int, eos_on_cut: bool) -> str:
    cut = f"list_concat({t}[1:{L - 1}], [{K.EOS_ID}])" if eos_on_cut else f"{t}[1:{L}]"
    return f"(CASE WHEN len({t}) <= {L} THEN list_concat({t}, {rep(K.EOS_ID, f'{L} - len({t})')}) ELSE {cut} END)"


def last_pos(arr: str, v: int) -> str:
    lp = f"coalesce(list_position(list_reverse({arr}), {v}), 0)"
    return f"(CASE WHEN {lp} = 0 THEN -1 ELSE len({arr}) - {lp} END)"


def s(arr: str) -> str:
    return f"array_to_string({arr}, ',')"


PAIRS_SQL = f"""{I.DOC_SQL()},
pairs AS (SELECT a.doc_id, a.ids, {I.IMAGE_SQL} AS image FROM doc_arr a JOIN embeddings e ON a.doc_id = e.vec_id)"""


# --------------------------------------------------------------- C9 ----
@register("c9_vq_offset", f"SELECT CAST(vec_id AS BIGINT) AS vec_id, {s(I.IMAGE_SQL)} AS image FROM embeddings")
def c9_vq_offset(spark, sf):
    e = table(spark, sf, "embeddings")
    codes = F.transform("embedding", lambda x: F.least(F.greatest(
        F.floor((x.cast("double") + 1.0) * 4096.0).cast("int"), F.lit(0)), F.lit(8191)))
    return e.select(F.col("vec_id").cast("bigint"), _ints(C.vq_to_tokens(codes)).alias("image"))


# --------------------------------------------------------------- P0 ----
@register("p0_bos_normalise", f"""
WITH {I.DOC_SQL(None)}
SELECT CAST(doc_id AS BIGINT) AS doc_id, {s(with_bos('ids'))} AS ids FROM doc_arr
""")
def p0_bos_normalise(spark, sf):
    d = I.doc_ids(spark, sf, None)
    return d.select(F.col("doc_id").cast("bigint"), _ints(P.with_bos(F.col("ids"))).alias("ids"))


# --------------------------------------------------------------- P6 ----
@register("p6_lm_prompt", f"""
WITH {I.DOC_SQL()},
t AS (SELECT doc_id, list_concat({with_bos('ids')}, [{K.EOS_ID}]) AS t FROM doc_arr),
q AS (SELECT doc_id, {pad_or_cut('t', SEQ_LEN, False)} AS seq FROM t)
SELECT CAST(doc_id AS BIGINT) AS doc_id, {s('seq')} AS input_ids, CAST(len(seq) AS BIGINT) AS mask_sum,
       {s('seq')} AS labels FROM q
""")
def p6_lm_prompt(spark, sf):
    d = I.doc_ids(spark, sf).withColumn("r", P.lm_prompt(F.col("ids"), SEQ_LEN))
    return d.select(F.col("doc_id").cast("bigint"), _ints(F.col("r.input_ids")).alias("input_ids"),
                    F.aggregate("r.mask", F.lit(0), lambda a, v: a + v).cast("bigint").alias("mask_sum"),
                    _ints(F.col("r.labels")).alias("labels"))


# ----------------------------------------------------------- P3/P4/P5 ----
def _t2i_sql(drop: bool, labels: bool) -> str:
    Lp = TEXT_LEN + 1
    base = f"list_concat([{K.T2I_ID}], {with_bos('ids')}, [{K.EOS_ID}])"
    t = (f"CASE WHEN {Q.u('drop', 'doc_id')} < {DROP_P} THEN [{K.T2I_ID}, {K.BOS_ID}, {K.EOS_ID}] ELSE {base} END"
         if drop else base)
    lab = (f", {s(f'list_transform(list_concat(text, [{K.SOI_ID}], image, [{K.EOI_ID}]), lambda x: CASE WHEN x = {K.PAD_ID} THEN {K.IGNORE_ID} ELSE x END)')} AS labels"
           if labels else "")
    return f"""
WITH {PAIRS_SQL},
a AS (SELECT doc_id, image, {t} AS t FROM pairs),
b AS (SELECT doc_id, image, t,
      CASE WHEN len(t) <= {Lp} THEN list_concat({rep(K.PAD_ID, f'{Lp} - len(t)')}, t)
           ELSE list_concat(t[1:{Lp - 1}], [{K.EOS_ID}]) END AS text,
      CASE WHEN len(t) <= {Lp} THEN list_concat({rep(0, f'{Lp} - len(t)')}, {rep(1, 'len(t) + len(image) + 2')})
           ELSE {rep(1, f'{Lp} + len(image) + 2')} END AS mask FROM a)
SELECT CAST(doc_id AS BIGINT) AS doc_id, {s(f'list_concat(text, [{K.SOI_ID}], image, [{K.EOI_ID}])')} AS input_ids,
       {s('mask')} AS mask{lab}
FROM b
"""


@register("p3_t2i_prompt", _t2i_sql(True, True))
def p3_t2i_prompt(spark, sf, rng="portable"):
    d = _pairs(spark, sf)
    r = P.t2i_prompt(F.col("ids"), F.col("image"), TEXT_LEN, drop=uniform("drop", "doc_id", rng=rng) < DROP_P)
    d = d.withColumn("r", r)
    return d.select(F.col("doc_id").cast("bigint"), _ints(F.col("r.input_ids")).alias("input_ids"),
                    _ints(F.col("r.mask")).alias("mask"), _ints(F.col("r.labels")).alias("labels"))


@register("p5_t2i_gen_prompt", _t2i_sql(False, False))
def p5_t2i_gen_prompt(spark, sf):
    d = _pairs(spark, sf).withColumn("r", P.t2i_prompt(F.col("ids"), F.col("image"), TEXT_LEN, with_labels=False))
    return d.select(F.col("doc_id").cast("bigint"), _ints(F.col("r.input_ids")).alias("input_ids"),
                    _ints(F.col("r.mask")).alias("mask"))


@register("p4_cond_dropout", f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, {Q.u('drop', 'doc_id')} < {DROP_P} AS dropped FROM documents
""")
def p4_cond_dropout(spark, sf, rng="portable"):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("bigint"), (uniform("drop", "doc_id", rng=rng) < DROP_P).alias("dropped"))


# ----------------------------------------------------------- P8/P9 ----
def _mmu_sql(labels: bool) -> str:
    lab = (f", {s(f'list_transform(list_concat({rep(K.IGNORE_ID, 'len(image) + 3')}, text), lambda x: CASE WHEN x = {K.PAD_ID} THEN {K.IGNORE_ID} ELSE x END)')} AS labels"
           if labels else "")
    return f"""
WITH {PAIRS_SQL},
a AS (SELECT doc_id, image, list_concat({with_bos('ids')}, [{K.EOS_ID}]) AS t FROM pairs),
b AS (SELECT doc_id, image, {pad_or_cut('t', TEXT_LEN, True)} AS text FROM a),
c AS (SELECT doc_id, image, text, list_concat([{K.MMU_ID}, {K.SOI_ID}], image, [{K.EOI_ID}]) AS head,
      {last_pos('text', K.END_HEADER_ID)} AS eh FROM b),
d AS (SELECT *, list_concat(head, text) AS seq, len(head) + CASE WHEN eh >= 0 THEN eh + 1 ELSE 0 END AS plen FROM c)
SELECT CAST(doc_id AS BIGINT) AS doc_id, {s('seq')} AS input_ids,
       {s(f"list_concat({rep(1, 'plen')}, {rep(0, 'len(seq) - plen')})")} AS mask{lab}
FROM d
"""


@register("p8_mmu_prompt", _mmu_sql(True))
def p8_mmu_prompt(spark, sf):
    d = _pairs(spark, sf).withColumn("r", P.mmu_prompt(F.col("image"), F.col("ids"), TEXT_LEN))
    return d.select(F.col("doc_id").cast("bigint"), _ints(F.col("r.input_ids")).alias("input_ids"),
                    _ints(F.col("r.mask")).alias("mask"), _ints(F.col("r.labels")).alias("labels"))


@register("p9_mmu_gen_prompt", _mmu_sql(False))
def p9_mmu_gen_prompt(spark, sf):
    d = _pairs(spark, sf).withColumn("r", P.mmu_prompt(F.col("image"), F.col("ids"), TEXT_LEN, with_labels=False))
    return d.select(F.col("doc_id").cast("bigint"), _ints(F.col("r.input_ids")).alias("input_ids"),
                    _ints(F.col("r.mask")).alias("mask"))


# -------------------------------------------------------------- P10 ----
@register("p10_r2i_prompt", f"""
WITH {PAIRS_SQL},
a AS (SELECT doc_id, image, list_concat({with_bos('ids')}, [{K.EOS_ID}]) AS t FROM pairs),
b AS (SELECT doc_id, image, {pad_or_cut('t', TEXT_LEN, True)} AS text FROM a),
c AS (SELECT *, {last_pos('text', K.END_HEADER_ID)} AS eh FROM b),
d AS (SELECT *, CASE WHEN eh >= 0 THEN eh + 1 ELSE len(text) END AS tp,
      list_concat([{K.R2I_ID}], text, [{K.SOI_ID}], image, [{K.EOI_ID}]) AS seq FROM c)
SELECT CAST(doc_id AS BIGINT) AS doc_id, {s('seq')} AS input_ids,
       {s(f"list_concat([1], {rep(1, 'tp')}, {rep(0, 'len(text) - tp')}, [1], {rep(0, 'len(image)')}, [1])")} AS mask,
       {s('seq')} AS labels
FROM d
""")
def p10_r2i_prompt(spark, sf):
    d = _pairs(spark, sf).withColumn("r", P.r2i_prompt(F.col("image"), F.col("ids"), TEXT_LEN))
    return d.select(F.col("doc_id").cast("bigint"), _ints(F.col("r.input_ids")).alias("input_ids"),
                    _ints(F.col("r.mask")).alias("mask"), _ints(F.col("r.labels")).alias("labels"))


# -------------------------------------------------------------- P11 ----
T2I_PER_BATCH = 4
BATCH = 8


@register("p11_t2i_plus_lm", f"""
WITH {PAIRS_SQL},
al AS (SELECT a.doc_id, a.ids, p.image FROM doc_arr a LEFT JOIN pairs p ON a.doc_id = p.doc_id),
ix AS (SELECT *, row_number() OVER (ORDER BY {Q.u('shuffle', 'doc_id')}, doc_id) - 1 AS idx FROM al),
tk AS (SELECT *, CASE WHEN image IS NOT NULL AND idx % {BATCH} < {T2I_PER_BATCH} THEN 't2i' ELSE 'lm' END AS task FROM ix),
t2i AS (SELECT doc_id, task, list_concat([{K.T2I_ID}], {with_bos('ids')}, [{K.EOS_ID}]) AS t, image FROM tk WHERE task = 't2i'),
t2i_seq AS (SELECT doc_id, task, list_concat(
      CASE WHEN len(t) <= {TEXT_LEN + 1} THEN list_concat({rep(K.PAD_ID, f'{TEXT_LEN + 1} - len(t)')}, t)
           ELSE list_concat(t[1:{TEXT_LEN}], [{K.EOS_ID}]) END, [{K.SOI_ID}], image, [{K.EOI_ID}]) AS seq FROM t2i),
lm AS (SELECT doc_id, task, list_concat({with_bos('ids')}, [{K.EOS_ID}]) AS t FROM tk WHERE task = 'lm'),
lm_seq AS (SELECT doc_id, task, {pad_or_cut('t', SEQ_LEN, False)} AS seq FROM lm)
SELECT CAST(doc_id AS BIGINT) AS doc_id, task, {s('seq')} AS input_ids FROM t2i_seq
UNION ALL SELECT CAST(doc_id AS BIGINT) AS doc_id, task, {s('seq')} AS input_ids FROM lm_seq
""")
def p11_t2i_plus_lm(spark, sf, rng="portable"):
    keys = B.shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", rng=rng)  # keys only
    pictures = I.images(spark, sf).withColumnRenamed("vec_id", "doc_id")
    d = I.doc_ids(spark, sf).join(keys, "doc_id").join(pictures, "doc_id", "left")
    # a text without an image can only be a language-model sample
    d = d.withColumn("task", F.when(F.col("image").isNotNull() & (F.pmod(F.col("idx"), F.lit(BATCH)) < T2I_PER_BATCH), F.lit("t2i"))
                     .otherwise(F.lit("lm")))
    r = P.build_sequences(d, "task", max_text_len=TEXT_LEN, max_seq_len=SEQ_LEN)
    return r.select(F.col("doc_id").cast("bigint"), "task", _ints(F.col("seq.input_ids")).alias("input_ids"))


# --------------------------------------------------------------- N6 ----
N6_SQL = f"""
WITH {PAIRS_SQL},
a AS (SELECT doc_id, image, list_concat({with_bos('ids')}, [{K.EOS_ID}]) AS t FROM pairs),
b AS (SELECT doc_id, image, {pad_or_cut('t', TEXT_LEN, True)} AS text FROM a),
c AS (SELECT doc_id, text, list_concat([{K.MMU_ID}, {K.SOI_ID}], image, [{K.EOI_ID}]) AS head,
      {last_pos('text', K.END_HEADER_ID)} AS eh FROM b),
d AS (SELECT doc_id, list_concat(head, text) AS seq, len(head) + CASE WHEN eh >= 0 THEN eh + 1 ELSE 0 END AS plen FROM c),
r AS (SELECT doc_id, plen, len(seq) AS n, unnest(range(len(seq))) AS pos, unnest(seq) AS token_id FROM d),
m AS (SELECT *, CAST(0.999 AS DOUBLE) * {Q.u('t', 'doc_id')} + CAST(0.001 AS DOUBLE) AS p_mask FROM r)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos, CAST(token_id AS BIGINT) AS token_id,
       CAST(CASE WHEN {Q.u('mask', 'doc_id', 'pos')} < p_mask AND pos >= plen THEN {K.MASK_ID} ELSE token_id END AS BIGINT)
       AS noisy_id, round(p_mask, 6) AS p_mask, CAST(n - plen AS BIGINT) AS answer_len
FROM m
"""


@register("n6_mmu_mask", N6_SQL)
def n6_mmu_mask(spark, sf, rng="portable"):
    from ..operators import masking as N
    d = _pairs(spark, sf).withColumn("r", P.mmu_prompt(F.col("image"), F.col("ids"), TEXT_LEN, with_labels=False))
    d = d.select("doc_id", F.arrays_zip(F.col("r.input_ids").alias("t"), F.col("r.mask").alias("m")).alias("_z"),
                 F.size(F.filter("r.mask", lambda x: x == 0)).alias("_n"))
    rows = AR.explode_rows(d, ["doc_id", "_n"], "_z", out="z").select(
        "doc_id", "pos", F.col("z.t").alias("token_id"), F.col("z.m").alias("prompt_mask"), "_n")
    m = N.diffusion_mask(rows, "doc_id", prompt_mask="prompt_mask", clamp_min=False, n_col="_n", rng=rng)
    return m.select(F.col("doc_id").cast("bigint"), F.col("pos").cast("bigint"), F.col("token_id").cast("bigint"),
                    F.col("noisy_id").cast("bigint"), F.round("p_mask", 6).alias("p_mask"),
                    F.col("answer_len").cast("bigint"))
