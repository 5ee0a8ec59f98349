"""Randomised differential test of the sequence builders against plain
Python versions written from the builder semantics (one Spark job per
builder over 300 random cases: empty ids, bos already first, end-headers,
exact fits and overflows all occur)."""

import random

import pytest
from pyspark.sql import functions as F

from corpusprep.functions import constants as K
from corpusprep.operators import prompts as P

B, E, H = K.BOS_ID, K.EOS_ID, K.END_HEADER_ID
L = 9


def bos(ids):
    return [B] if not ids else (ids if ids[0] == B else [B] + ids)


def fit(t, n, cut_eos):
    if len(t) <= n:
        return t + [E] * (n - len(t))
    return t[:n - 1] + [E] if cut_eos else t[:n]


def last(xs, v):
    return max((i for i, x in enumerate(xs) if x == v), default=-1)


def py_lm_chat(ids):
    seq = fit(bos(ids) + [E], L, False)
    p = last(seq, H) + 1
    return seq, [1] * p + [0] * (len(seq) - p)


def py_t2i(ids, img, drop):
    t = [K.T2I_ID, B, E] if drop else [K.T2I_ID] + bos(ids) + [E]
    lp = L + 1
    if len(t) <= lp:
        text, mask = [K.PAD_ID] * (lp - len(t)) + t, [0] * (lp - len(t)) + [1] * (len(t) + len(img) + 2)
    else:
        text, mask = t[:lp - 1] + [E], [1] * (lp + len(img) + 2)
    seq = text + [K.SOI_ID] + img + [K.EOI_ID]
    return seq, mask, [K.IGNORE_ID if x == K.PAD_ID else x for x in seq]


def py_mmu(img, ids):
    text = fit(bos(ids) + [E], L, True)
    head = [K.MMU_ID, K.SOI_ID] + img + [K.EOI_ID]
    eh = last(text, H)
    p = len(head) + (eh + 1 if eh >= 0 else 0)
    seq = head + text
    return seq, [1] * p + [0] * (len(seq) - p), [K.IGNORE_ID] * len(head) + text


def py_r2i(img, ids):
    text = fit(bos(ids) + [E], L, True)
    eh = last(text, H)
    tp = eh + 1 if eh >= 0 else len(text)
    seq = [K.R2I_ID] + text + [K.SOI_ID] + img + [K.EOI_ID]
    mask = [1] + [1] * tp + [0] * (len(text) - tp) + [1] + [0] * len(img) + [1]
    return seq, mask


@pytest.fixture(scope="module")
def cases(spark):
    rnd = random.Random(7)
    rows = []
    for k in range(300):
        n = rnd.choice([0, 1, 2, L - 2, L - 1, L, L + 1, L + 4])
        ids = [rnd.choice([B, H, 5, 6, 7, 8]) for _ in range(n)]
        img = [100 + rnd.randrange(5) for _ in range(rnd.choice([0, 1, 3]))]
        rows.append((k, ids, img, rnd.random() < 0.2))
    df = spark.createDataFrame(rows, "k int, ids array<int>, image array<int>, drop boolean")
    return rows, df


def _run(df, expr):
    return {r["k"]: r["r"] for r in df.select("k", expr.alias("r")).collect()}


def test_lm_chat_random(cases):
    rows, df = cases
    got = _run(df, P.lm_chat_prompt(F.col("ids"), L))
    for k, ids, _, _ in rows:
        seq, mask = py_lm_chat(ids)
        assert got[k]["input_ids"] == seq and got[k]["mask"] == mask and got[k]["labels"] == seq


def test_t2i_random(cases):
    rows, df = cases
    got = _run(df, P.t2i_prompt(F.col("ids"), F.col("image"), L, drop=F.col("drop")))
    for k, ids, img, drop in rows:
        seq, mask, labels = py_t2i(ids, img, drop)
        assert (got[k]["input_ids"], got[k]["mask"], got[k]["labels"]) == (seq, mask, labels)


def test_mmu_random(cases):
    rows, df = cases
    got = _run(df, P.mmu_prompt(F.col("image"), F.col("ids"), L))
    for k, ids, img, _ in rows:
        seq, mask, labels = py_mmu(img, ids)
        assert (got[k]["input_ids"], got[k]["mask"], got[k]["labels"]) == (seq, mask, labels)


def test_r2i_random(cases):
    rows, df = cases
    got = _run(df, P.r2i_prompt(F.col("image"), F.col("ids"), L))
    for k, ids, img, _ in rows:
        seq, mask = py_r2i(img, ids)
        assert (got[k]["input_ids"], got[k]["mask"]) == (seq, mask)
