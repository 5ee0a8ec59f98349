"""Hand-computed goldens for the sequence builders: empty ids, bos already
present, exact fit, overflow, zero / one / two end-headers, header cut off."""

import pytest
from pyspark.sql import functions as F

from corpusprep.functions import constants as K
from corpusprep.operators import prompts as P

B, E, H = K.BOS_ID, K.EOS_ID, K.END_HEADER_ID
PAD, SOI, EOI, T2I, MMU, R2I = K.PAD_ID, K.SOI_ID, K.EOI_ID, K.T2I_ID, K.MMU_ID, K.R2I_ID
IMG = [100, 101]


def run(spark, rows, expr_fn, image=True):
    schema = "k int, ids array<int>, image array<int>, drop boolean"
    df = spark.createDataFrame([(i, r, IMG if image else [], d) for i, (r, d) in enumerate(rows)], schema)
    out = df.select("k", expr_fn(df).alias("r")).orderBy("k").collect()
    return [r["r"].asDict() for r in out]


def test_p0_with_bos(spark):
    df = spark.createDataFrame([([],), ([B, 5],), ([5],)], "ids array<int>")
    got = [r[0] for r in df.select(P.with_bos(F.col("ids"))).collect()]
    assert got == [[B], [B, 5], [B, 5]]


def test_p6_lm_prompt(spark):
    rows = [([], False), ([B, 5, 6], False), ([5, 6, 7, 8], False), ([5, 6, 7, 8, 9], False)]
    got = run(spark, rows, lambda d: P.lm_prompt(F.col("ids"), 6))
    assert [g["input_ids"] for g in got] == [
        [B, E, E, E, E, E], [B, 5, 6, E, E, E], [B, 5, 6, 7, 8, E], [B, 5, 6, 7, 8, 9]]
    assert all(g["mask"] == [1] * 6 for g in got)          # mask after padding (all ones)
    assert all(g["labels"] == g["input_ids"] for g in got)


def test_p7_lm_chat_prompt(spark):
    rows = [([5, H, 6, H, 7], False), ([5, 6], False), ([5, H, 6], False)]
    got = run(spark, rows, lambda d: P.lm_chat_prompt(F.col("ids"), 8))
    assert got[0]["input_ids"] == [B, 5, H, 6, H, 7, E, E]
    assert got[0]["mask"] == [1, 1, 1, 1, 1, 0, 0, 0]       # up to the LAST end-header
    assert got[1]["mask"] == [0] * 8                          # no header: nothing is prompt
    assert got[2]["mask"] == [1, 1, 1, 0, 0, 0, 0, 0]
    cut = run(spark, [([5, 6, 7, H], False)], lambda d: P.lm_chat_prompt(F.col("ids"), 4))
    assert cut[0]["input_ids"] == [B, 5, 6, 7] and cut[0]["mask"] == [0, 0, 0, 0]  # header cut off


def test_p3_t2i_prompt(spark):
    rows = [([5, 6], False), ([5], False), ([5, 6, 7], False), ([5, 6], True), ([], False)]
    got = run(spark, rows, lambda d: P.t2i_prompt(F.col("ids"), F.col("image"), 4, drop=F.col("drop")))
    assert got[0]["input_ids"] == [T2I, B, 5, 6, E, SOI, 100, 101, EOI]        # exact fit
    assert got[0]["mask"] == [1] * 9
    assert got[1]["input_ids"] == [PAD, T2I, B, 5, E, SOI, 100, 101, EOI]      # left pad
    assert got[1]["mask"] == [0] + [1] * 8
    assert got[1]["labels"] == [-100, T2I, B, 5, E, SOI, 100, 101, EOI]
    assert got[2]["input_ids"] == [T2I, B, 5, 6, E, SOI, 100, 101, EOI]        # overflow: cut + eos
    assert got[3]["input_ids"] == [PAD, PAD, T2I, B, E, SOI, 100, 101, EOI]    # condition dropped
    assert got[4]["input_ids"] == [PAD, PAD, T2I, B, E, SOI, 100, 101, EOI]    # empty -> bos


def test_p8_mmu_prompt(spark):
    rows = [([5, H, 6], False), ([5, 6, 7, 8, 9], False), ([H, 5, H], False), ([], False)]
    got = run(spark, rows, lambda d: P.mmu_prompt(F.col("image"), F.col("ids"), 5))
    head = [MMU, SOI, 100, 101, EOI]
    assert got[0]["input_ids"] == head + [B, 5, H, 6, E]
    assert got[0]["mask"] == [1] * 8 + [0] * 2
    assert got[0]["labels"] == [-100] * 5 + [B, 5, H, 6, E]
    assert got[1]["input_ids"] == head + [B, 5, 6, 7, E]                       # cut to L-1 + eos
    assert got[1]["mask"] == [1] * 5 + [0] * 5                                 # image part only
    assert got[2]["mask"] == [1] * 9 + [0]                                     # two headers: last one
    assert got[3]["input_ids"] == head + [B, E, E, E, E]                       # empty -> bos, eos padding


def test_p10_r2i_prompt(spark):
    rows = [([5, H, 6], False), ([5, 6], False)]
    got = run(spark, rows, lambda d: P.r2i_prompt(F.col("image"), F.col("ids"), 5))
    assert got[0]["input_ids"] == [R2I, B, 5, H, 6, E, SOI, 100, 101, EOI]
    assert got[0]["mask"] == [1, 1, 1, 1, 0, 0, 1, 0, 0, 1]
    assert got[1]["mask"] == [1, 1, 1, 1, 1, 1, 1, 0, 0, 1]                    # no header: all text


def test_p11_unknown_task_fails(spark):
    df = spark.createDataFrame([([5], [1], "bogus")], "ids array<int>, image array<int>, task string")
    with pytest.raises(Exception):
        P.build_sequences(df, "task").collect()
