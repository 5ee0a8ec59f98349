"""Properties: masking invariants, partition independence, skew-safe
ordering primitives, the EMA scan against a sequential loop."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusprep.functions import constants as K
from corpusprep.functions.rng import uniform
from corpusprep.operators import batching as B
from corpusprep.operators import masking as N
from corpusprep.operators import metrics as A
from corpusprep.operators import select as S
from corpusprep.operators.ordering import dense_index, top_k_per_group
from corpusprep.plans import inputs as I
from corpusprep.plans.chat_feed import chat_feed
from corpusprep.session import table


def test_bernoulli_labels_and_rate(spark, smoke_dir):
    rows = I.doc_token_rows(spark, smoke_dir)
    m = N.bernoulli_mask(rows, "doc_id", 0.3).toPandas()
    masked = m["input_id"] == K.MASK_ID
    assert (m.loc[masked, "label"] == m.loc[masked, "token_id"]).all()
    assert (m.loc[~masked, "label"] == K.IGNORE_ID).all()
    n, rate = len(m), masked.mean()
    assert abs(rate - 0.3) < 4 * math.sqrt(0.3 * 0.7 / n)


def test_mask_independent_of_partitioning(spark, smoke_dir):
    rows = I.doc_token_rows(spark, smoke_dir).select("doc_id", "pos", "token_id")
    base = None
    for parts in (1, 3, 16):
        r = N.diffusion_mask(rows.repartition(parts), "doc_id", answer_len="attention", seq_len=512)
        got = r.select("doc_id", "pos", "noisy_id", "p_mask").toPandas().sort_values(["doc_id", "pos"])
        got = got.reset_index(drop=True)
        if base is None:
            base = got
        else:
            pd.testing.assert_frame_equal(base, got)


def test_fast_and_portable_rng_are_uniform(spark):
    df = spark.range(20000).select(uniform("x", "id").alias("p"), uniform("x", "id", rng="fast").alias("f"))
    s = df.agg(F.min("p"), F.max("p"), F.avg("p"), F.min("f"), F.max("f"), F.avg("f")).first()
    assert 0 <= s[0] and s[1] < 1 and abs(s[2] - 0.5) < 0.01
    assert 0 <= s[3] and s[4] < 1 and abs(s[5] - 0.5) < 0.01


def test_chat_prompt_positions_never_masked(spark, smoke_dir):
    f = chat_feed(table(spark, smoke_dir, "conversations"), max_seq_len=128).toPandas()
    assert (f.loc[f["prompt_mask"] == 1, "noisy_id"] == f.loc[f["prompt_mask"] == 1, "token_id"]).all()
    assert (f.groupby("conv_id").size() == 128).all()
    assert (f["label"] == f["token_id"]).all()
    assert (f["answer_len"] >= 1).all()


@pytest.mark.parametrize("L,gen", [(1200, False), (64, True)])
def test_chat_positions_match_sql(spark, smoke_dir, L, gen):
    """Long sequences (salted top-k path) and the generation prompt."""
    from corpusprep.plans.chat_feed import chat_positions
    from corpusprep.plans.queries_chat import _chat_positions_sql
    from tests.oracle_check import duck
    got = chat_positions(table(spark, smoke_dir, "conversations"), L, add_generation_prompt=gen).toPandas()
    want = duck(smoke_dir).execute(f"WITH {_chat_positions_sql(L, gen)} SELECT conv_id, pos, token FROM positions").df()
    key = ["conv_id", "pos"]
    got = got.sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    assert len(got) == len(want) == got["conv_id"].nunique() * L
    assert (got["token"].values == want["token"].values).all()
    assert (got["pos"].values == want["pos"].values).all()


def test_chat_feed_partition_independent(spark, smoke_dir):
    conv = table(spark, smoke_dir, "conversations")
    cols = ["conv_id", "pos", "token_id", "noisy_id", "prompt_mask", "answer_len"]
    base = None
    for parts in (1, 3, 16):
        got = chat_feed(conv.repartition(parts), max_seq_len=96).select(cols).toPandas() \
            .sort_values(["conv_id", "pos"]).reset_index(drop=True)
        if base is None:
            base = got
        else:
            pd.testing.assert_frame_equal(base, got)


def test_chat_feed_hot_conversation(spark):
    """One conversation with most of the turns: positions stay exact and
    only the first max_seq_len positions are produced."""
    turns = [(0, t, "user" if t % 2 == 0 else "assistant", f"w{t} x{t}") for t in range(3000)]
    turns += [(c, t, "user", f"q{c}") for c in range(1, 40) for t in range(2)]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    from corpusprep.plans.chat_feed import chat_positions
    got = chat_positions(conv, 64).where("conv_id = 0").orderBy("pos").toPandas()
    want = [K.BOS_TOKEN]
    for t in range(3000):
        want += [K.START_HEADER_TOKEN, "user" if t % 2 == 0 else "assistant", K.END_HEADER_TOKEN,
                 f"w{t}", f"x{t}", K.EOT_TOKEN]
    assert got["pos"].tolist() == list(range(64))
    assert got["token"].tolist() == want[:64]


def test_exact_count_mask(spark):
    rows = spark.createDataFrame([(1, p, 0 if p >= 7 else 10 + p) for p in range(10)],
                                 "k long, pos int, token_id int")
    r = N.exact_count_mask(rows, "k", F.lit(0.5), pad_id=0).toPandas()
    assert (r["input_id"] == K.MASK_ID).sum() == int(7 * 0.5)
    assert (r.loc[r["token_id"] == 0, "label"] == K.IGNORE_ID).all()
    none = N.exact_count_mask(rows, "k", F.lit(0.0), pad_id=0).toPandas()
    assert (none["input_id"] != K.MASK_ID).all()
    full = N.exact_count_mask(rows, "k", F.lit(1.0), pad_id=0).toPandas()
    assert (full["input_id"] == K.MASK_ID).sum() == 7


def test_exact_count_mask_array_equals_window(spark):
    seqs = [(k, [10 + ((k * 7 + i) % 5) for i in range(n)] + [0] * (12 - n)) for k, n in enumerate([0, 1, 5, 12, 9])]
    df = spark.createDataFrame(seqs, "k long, s array<int>")
    arr = df.select("k", N.exact_count_mask_array(F.col("s"), "k", F.lit(0.4), is_pad=lambda e: e == 0).alias("m"))
    got = {(r["k"], i) for r in arr.collect() for i, m in enumerate(r["m"]) if m}
    rows = df.select("k", F.posexplode("s").alias("pos", "token_id"))
    win = N.exact_count_mask(rows, "k", F.lit(0.4), pad_id=0).where(F.col("input_id") == K.MASK_ID)
    assert got == {(r["k"], r["pos"]) for r in win.collect()}


def test_release_takes_the_most_confident(spark):
    rows = [(k % 3, k, float((k * 37) % 11), (k * 7) % 5 != 0) for k in range(300)]
    df = spark.createDataFrame(rows, "seq int, pos int, conf double, candidate boolean")
    for block in (None, (30, 120)):
        got = {(r["seq"], r["pos"]) for r in S.release(df, "seq", F.lit(17), block=block).where("released").collect()}
        able = [r for r in rows if r[3] and (block is None or block[0] <= r[1] < block[1])]
        want = {(r[0], r[1]) for s in range(3) for r in sorted((r for r in able if r[0] == s), key=lambda r: (-r[2], r[1]))[:17]}
        assert got == want and len(got) == 3 * 17


def test_release_guards(spark):
    import pytest
    assert S.block_steps(64, 16, 8) == 2
    for bad in ((60, 16, 8), (64, 16, 6), (64, 0, 8)):
        with pytest.raises(ValueError):
            S.block_steps(*bad)
    with pytest.raises(ValueError):
        S.confidence("entropy", F.lit(0.0), "pos")
    drawn = spark.range(5).select(S.confidence("random", F.lit(0.0), "id").alias("c")).collect()
    assert len({r.c for r in drawn}) == 5


def test_entries_equal_the_long_form(spark):
    rows = [(i, [float((i * 7 + k * 13) % 17) for k in range(n)]) for i, n in enumerate((0, 1, 5, 40))]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    long = S.explode_scores(df, "id", "v")
    for kw in ({"top_k": 3}, {"top_p": 0.4}, {"top_k": 9, "top_p": 0.6, "min_tokens_to_keep": 3}, {"top_k": 100}):
        a = {(r.id, r.k) for r in S.top_k_top_p(long, "id", **kw).collect()}
        b = {(r.id, r.e.k) for r in df.select("id", F.explode(S.top_k_top_p_entries(F.col("v"), **kw)).alias("e")).collect()}
        assert a == b
    a = {(r.id, r.k) for r in S.top_k_rows(long, "id", 4).collect()}
    assert a == {(r.id, r.e.k) for r in df.select("id", F.explode(S.top_k_entries(F.col("v"), 4)).alias("e")).collect()}


def test_quota_sums(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 10, 37, 512)], "n int")
    q = df.select("n", S.transfer_quota(F.col("n"), 4).alias("q")).collect()
    for r in q:
        assert sum(r["q"]) == r["n"] and max(r["q"]) - min(r["q"]) <= 1
    assert [r["q"] for r in q if r["n"] == 10][0] == [3, 3, 2, 2]


def test_batches_cover_each_id_once_per_epoch(spark, smoke_dir):
    e = B.epochs(table(spark, smoke_dir, "documents").select("doc_id"), 2)
    s = B.batch_id(B.shuffle(e, "doc_id", epoch_col="epoch"), 8).toPandas()
    n = s["doc_id"].nunique()
    for _, g in s.groupby("epoch"):
        assert sorted(g["idx"]) == list(range(n))
        assert g["doc_id"].is_unique
        assert g.groupby("batch_id").size().max() <= 8


def test_combine_modes(spark):
    a = spark.range(5).select(F.col("id").alias("batch_id"))
    b = spark.range(2).select(F.col("id").alias("batch_id"))
    cyc = {(r["step"], r["source"]): r["batch_id"] for r in B.combine(a, {"b": b}).collect()}
    assert len(cyc) == 10 and cyc[(4, "b")] == 0 and cyc[(3, "b")] == 1      # short source wraps
    mn = B.combine(a, {"b": b}, mode="min_size").collect()
    assert sorted({r["step"] for r in mn}) == [0, 1] and len(mn) == 4
    seq = sorted((r["step"], r["source"], r["batch_id"]) for r in B.combine(a, {"b": b}, mode="sequential").collect())
    assert [s[0] for s in seq] == list(range(7)) and seq[5] == (5, "b", 0)


def test_updates_per_epoch_and_scale_conf(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (8,)], "n int")
    got = [r[0] for r in df.select(B.updates_per_epoch(F.col("n"), 4)).collect()]
    assert got == [0, 1, 2, 2]
    from corpusprep.session import scale_conf
    conf = scale_conf(100 << 40, executors=1000, cores_per_executor=8)
    assert int(conf["spark.sql.shuffle.partitions"]) >= 3 * 8000
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_chat_training_feed_batches(spark, smoke_dir):
    from corpusprep.plans.jobs import chat_training_feed
    f = chat_training_feed(table(spark, smoke_dir, "conversations"), max_seq_len=32, batch_size=4).toPandas()
    per_conv = f.groupby("conv_id")["batch_id"].nunique()
    assert (per_conv == 1).all()                                     # a conversation sits in one batch
    assert f.groupby("batch_id")["conv_id"].nunique().max() <= 4
    assert (f.groupby("conv_id").size() == 32).all()


def test_dense_index_with_hot_group(spark):
    # one group holds ~1/3 of the rows; indices must stay dense per group
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
                                  F.col("id").alias("v"))
    out = dense_index(df, ["v"], group_by=["g"], partitions=8).toPandas()
    for _, g in out.groupby("g"):
        g = g.sort_values("v")
        assert list(g["idx"]) == list(range(len(g)))
    glob = dense_index(df, [F.desc("v")], partitions=8).toPandas().sort_values("v", ascending=False)
    assert list(glob["idx"]) == list(range(3000))


def test_top_k_per_group_matches_window(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    want = df.toPandas().sort_values("v", ascending=False).groupby("g").head(5)
    got = top_k_per_group(df, ["g"], [F.desc("v")], 5, salts=4).toPandas()   # native partial limit
    assert sorted(got["v"]) == sorted(want["v"])
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "2")                                                   # forces the salted path
    try:
        got = top_k_per_group(df, ["g"], [F.desc("v")], 5, salts=4).toPandas()
    finally:
        spark.conf.set(key, old)
    assert sorted(got["v"]) == sorted(want["v"])


def test_ema_scan_matches_sequential_loop(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 7)  # many chunks: exercises the carries
    xs = [float((i * 37) % 11) for i in range(60)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)] + [("t", i, 1.0) for i in range(5)],
                               "series string, step long, value double")
    got = A.ema_series(df, "series", "step", "value").where("series = 's'").orderBy("step").toPandas()
    ema, want = 0.0, []
    for i, x in enumerate(xs):
        s = max(0, i - 1)
        d = 0.0 if s <= 0 else min((1 + s) / (10 + s), 0.9999)
        ema = d * ema + (1 - d) * x
        want.append(ema)
    assert got["ema"].tolist() == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_top_p_ties_and_min_keep(spark):
    long = spark.createDataFrame([(1, k, x) for k, x in enumerate([2.0, 2.0, 1.0, 0.0])], "id int, k int, x double")
    kept = S.top_k_top_p(long, "id", top_p=0.1).toPandas()
    assert kept["k"].tolist() == [0]                       # first always kept
    kept3 = S.top_k_top_p(long, "id", top_p=0.1, min_tokens_to_keep=3).toPandas()
    assert sorted(kept3["k"].tolist()) == [0, 1, 2, 3]      # m=3 protects the first m+1
    tk = S.top_k_top_p(long, "id", top_k=1).toPandas()
    assert sorted(tk["k"].tolist()) == [0, 1]               # ties at the k-th value are kept


def test_molecule_feed_invariants(spark, smoke_dir):
    from corpusprep.plans.queries_eval import e2_molecule_feed
    f = e2_molecule_feed(spark, smoke_dir).toPandas()
    assert f["id"].is_unique
    assert sorted(f["idx"]) == list(range(len(f)))
    assert (f["batch_id"] == f["idx"] // 2).all()
    for ids, labels, atoms in zip(f["ids"], f["labels"], f["atom_vec"]):
        ids, labels = [int(x) for x in ids.split(",")], [int(x) for x in labels.split(",")]
        assert len(atoms.split(",")) == I.MAX_ATOMS
        for i, lab in zip(ids, labels):
            assert (i == K.MASK_ID and lab != K.IGNORE_ID) or (lab == K.IGNORE_ID)


def test_random_topk_mask_ties_not_masked(spark):
    df = spark.createDataFrame([(1, [0.25, 0.25, 0.25, 0.25], 2)], "id long, p array<double>, n int")
    out = N.with_random_topk_mask(df, "p", F.col("n"), 0.0, "id").first()["mask"]
    assert out == [False, False, False, False]              # all equal to the cut-off: none masked
