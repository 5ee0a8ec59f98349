"""User-function queries (U1, U3, U4): each plugs a small user function into
the library hook and is checked against the built-in semantics."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import udf as U
from ..operators import batching as B
from ..session import table
from . import inputs as I
from . import sqlkit as Q
from .registry import register


def _whitespace_tokenizer():
    pat = re.compile(r"[ \t\n\r\f]+")
    return lambda s: [t for t in pat.split(s) if t]


@register("u1_pluggable_tokenizer", f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len({Q.tokens('text')}) AS BIGINT) AS n_tokens FROM documents
""")
def u1_pluggable_tokenizer(spark, sf):
    d = U.tokenise_with(table(spark, sf, "documents").select("doc_id", "text"), "text", _whitespace_tokenizer)
    return d.select(F.col("doc_id").cast("bigint"), F.size("tokens").cast("bigint").alias("n_tokens"))


U2_T = 1000
U2_SQL = f"""
WITH {I.DOC_SQL(None)},
t AS (SELECT doc_id, pos, token_id, CAST(least(floor({float(U2_T)} * {Q.u('t', 'doc_id')}), {U2_T - 1}) AS INTEGER) AS t
      FROM doc_rows),
m AS (SELECT *, least(greatest(1.0 - pow(CAST(t AS DOUBLE) / {float(U2_T - 1)}, 3.0), 1e-6), 1.0) AS mask_ratio FROM t),
k AS (SELECT *, {Q.u('mask', 'doc_id', 'pos')} < mask_ratio AS mk FROM m)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos, round(mask_ratio, 6) AS mask_ratio,
       CAST(CASE WHEN mk THEN {K.MASK_ID} ELSE token_id END AS BIGINT) AS input_id
FROM k
"""


@register("u2_pluggable_schedule", U2_SQL)
def u2_pluggable_schedule(spark, sf, rng="portable"):
    """N2 with a user schedule: the pow3 ratio function of t / (T - 1)."""
    from ..functions import schedules as S
    from ..operators import masking as N
    user = lambda t: S.ratio("pow3", t / F.lit(float(U2_T - 1)))
    r = N.timestep_mask(I.doc_token_rows(spark, sf, None), "doc_id", timesteps=U2_T, schedule=user, rng=rng)
    return r.select(F.col("doc_id").cast("bigint"), F.col("pos").cast("bigint"),
                    F.round("mask_ratio", 6).alias("mask_ratio"), F.col("input_id").cast("bigint"))


def _batch_summary(t: pa.Table) -> pa.Table:
    lens = pc.utf8_length(t.column("text"))
    return pa.table({"batch_id": pa.array([t.column("batch_id")[0].as_py()], pa.int64()),
                     "n": pa.array([t.num_rows], pa.int64()),
                     "max_chars": pa.array([pc.max(lens).as_py()], pa.int64())})


@register("u3_per_batch_function", f"""
WITH s AS (SELECT doc_id, text, row_number() OVER (ORDER BY {Q.u('shuffle', 'doc_id')}, doc_id) - 1 AS idx FROM documents)
SELECT CAST(idx // 8 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n, CAST(max(length(text)) AS BIGINT) AS max_chars
FROM s GROUP BY idx // 8
""")
def u3_per_batch_function(spark, sf, rng="portable"):
    docs = table(spark, sf, "documents")
    keys = B.batch_id(B.shuffle(docs.select("doc_id"), "doc_id", rng=rng), 8)  # keys only; texts move once
    d = docs.select("doc_id", "text").join(keys.select("doc_id", "batch_id"), "doc_id")
    return U.apply_per_batch(d.select("batch_id", "text"), "batch_id", _batch_summary,
                             "batch_id long, n long, max_chars long")


def _argmax_model():
    def model(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b["embedding"].to_numpy())
        return pd.DataFrame({"vec_id": b["vec_id"].astype("int64"), "pred": x.argmax(axis=1).astype("int64")})
    return model


@register("u4_batch_predictor", """
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS pred
FROM embeddings
""")
def u4_batch_predictor(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return U.predict(e, _argmax_model, "vec_id long, pred long")
