"""Queries over LOGITS (= ``embeddings``: 64 logits per row, target =
label; a sample is the group of rows with one label): K1-K7, N8, J6,
A2-A7, A9, A13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, true_positions
from ..functions.rng import uniform
from ..operators import masking as N
from ..operators import metrics as A
from ..operators import select as K
from . import inputs as I
from . import sqlkit as Q
from .registry import register

R6 = lambda c: F.round(c, 6)
V = 64

SOFTMAX_SQL = f"""{I.LOGITS_SQL},
sm AS (SELECT vec_id, label, logits, list_max(logits) AS mx FROM logits),
ex AS (SELECT vec_id, label, logits, list_transform(logits, lambda v: exp(v - mx)) AS e FROM sm),
prob AS (SELECT vec_id, label, logits, list_transform(e, lambda v: v / list_sum(e)) AS p FROM ex)"""


def _probs(spark, sf):
    return K.with_softmax(I.logits(spark, sf), "logits", "p")


# ------------------------------------------------------------ K7 ----
K7_SQL = f"""
WITH {SOFTMAX_SQL}
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS argmax,
       round(p[list_position(logits, list_max(logits))], 6) AS p_max
FROM prob
"""


@register("k7_softmax_argmax", K7_SQL)
def k7_softmax_argmax(spark, sf):
    d = _probs(spark, sf).withColumn("argmax", K.argmax(F.col("logits")))
    return d.select(F.col("vec_id").cast("bigint"), F.col("argmax").cast("bigint"),
                    R6(F.get(F.col("p"), F.col("argmax"))).alias("p_max"))


# ------------------------------------------------------------ K1 ----
K1_SQL = f"""
WITH {I.LOGITS_SQL},
s AS (SELECT vec_id,
  list_transform(logits, lambda v, i: v / 1.0 + {Q.gumbel(Q.u('gumbel', 'vec_id', 'i - 1'))}) AS s_div,
  list_transform(logits, lambda v, i: v + 0.5 * {Q.gumbel(Q.u('gumbel', 'vec_id', 'i - 1'))}) AS s_scale
  FROM logits)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(list_position(s_div, list_max(s_div)) - 1 AS BIGINT) AS sample_div,
       CAST(list_position(s_scale, list_max(s_scale)) - 1 AS BIGINT) AS sample_scale
FROM s
"""


@register("k1_gumbel_sample", K1_SQL)
def k1_gumbel_sample(spark, sf, rng="portable"):
    lg = I.logits(spark, sf)
    return lg.select(F.col("vec_id").cast("bigint"),
                     K.gumbel_argmax(F.col("logits"), F.col("vec_id"), 1.0, mode="divide", rng=rng)
                     .cast("bigint").alias("sample_div"),
                     K.gumbel_argmax(F.col("logits"), F.col("vec_id"), 0.5, mode="scale", rng=rng)
                     .cast("bigint").alias("sample_scale"))


# ------------------------------------------------------------ K2 ----
K2_SQL = f"""
WITH {I.LOGITS_SQL},
r AS (SELECT vec_id, unnest(range(len(logits))) AS k, unnest(logits) AS x FROM logits),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) AS rn FROM r)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(k AS BIGINT) AS k, round(x, 6) AS x FROM t WHERE rn <= 7
"""


@register("k2_top_k", K2_SQL)
def k2_top_k(spark, sf):
    import math
    kk = math.ceil((1 - 0.9) * V)
    t = I.logits(spark, sf).select("vec_id", F.explode(K.top_k_entries(F.col("logits"), kk)).alias("e"))
    return t.select(F.col("vec_id").cast("bigint"), F.col("e.k").cast("bigint").alias("k"), R6(F.col("e.x")).alias("x"))


# ------------------------------------------------------------ K3 ----
K3_SQL = f"""
WITH {I.LOGITS_SQL},
r AS (SELECT vec_id, unnest(range(len(logits))) AS k, unnest(logits) AS x FROM logits),
tk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) AS rn FROM r),
kx AS (SELECT *, max(CASE WHEN rn = 10 THEN x END) OVER (PARTITION BY vec_id) AS kth FROM tk),
f AS (SELECT vec_id, k, x FROM kx WHERE x >= kth),
m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS mx FROM f),
e AS (SELECT *, exp(x - mx) AS ee FROM m),
p AS (SELECT *, ee / sum(ee) OVER (PARTITION BY vec_id) AS pp FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) AS rn2,
      coalesce(sum(pp) OVER (PARTITION BY vec_id ORDER BY x DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before
      FROM p)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(k AS BIGINT) AS k, round(x, 6) AS x
FROM c WHERE rn2 = 1 OR NOT (before > 0.5)
"""


@register("k3_top_k_top_p", K3_SQL)
def k3_top_k_top_p(spark, sf):
    kept = K.top_k_top_p_entries(F.col("logits"), top_k=10, top_p=0.5)
    t = I.logits(spark, sf).select("vec_id", F.explode(kept).alias("e"))
    return t.select(F.col("vec_id").cast("bigint"), F.col("e.k").cast("bigint").alias("k"), R6(F.col("e.x")).alias("x"))


# ------------------------------------------------------------ N8 ----
N8_SQL = f"""
WITH {SOFTMAX_SQL},
c AS (SELECT vec_id, CAST(floor(64 * {Q.u('mlen', 'vec_id')}) AS INTEGER) AS mask_len,
      list_transform(p, lambda q, i: ln(greatest(q, 1e-20)) + 1.0 * {Q.gumbel(Q.u('gumbel', 'vec_id', 'i - 1'))}) AS conf
      FROM prob),
m AS (SELECT vec_id, mask_len, list_transform(conf, lambda x: x < list_sort(conf)[mask_len + 1]) AS mk FROM c)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(mask_len AS BIGINT) AS mask_len,
       array_to_string(list_filter(range(64), lambda i: mk[i + 1]), ',') AS masked
FROM m
"""


@register("n8_random_topk_mask", N8_SQL)
def n8_random_topk_mask(spark, sf, rng="portable"):
    d = _probs(spark, sf).withColumn("mask_len", F.floor(F.lit(64.0) * uniform("mlen", "vec_id", rng=rng)).cast("int"))
    d = N.with_random_topk_mask(d, "p", F.col("mask_len"), 1.0, "vec_id", out="mk", rng=rng)
    return d.select(F.col("vec_id").cast("bigint"), F.col("mask_len").cast("bigint"),
                    F.array_join(true_positions(F.col("mk")), ",").alias("masked"))


# ------------------------------------------------------ K6 + J6 ----
K6_SQL = f"""
WITH c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS cond FROM embeddings),
u AS (SELECT vec_id, list_reverse(CAST(embedding AS DOUBLE[])) AS uncond FROM embeddings),
g AS (SELECT c.vec_id, list_transform(range(len(cond)), lambda i: uncond[i + 1] + 2.5 * (cond[i + 1] - uncond[i + 1])) AS gl
      FROM c JOIN u ON c.vec_id = u.vec_id)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(list_position(gl, list_max(gl)) - 1 AS BIGINT) AS argmax,
       round(list_max(gl), 6) AS max_logit
FROM g
"""


@register("k6_guidance", K6_SQL)
def k6_guidance(spark, sf):
    cond = I.logits(spark, sf).select("vec_id", F.col("logits").alias("cond"))
    unc = I.logits(spark, sf).select("vec_id", F.reverse("logits").alias("uncond"))
    g = cond.join(unc, "vec_id").withColumn("gl", K.guidance(F.col("cond"), F.col("uncond"), 1.5))
    return g.select(F.col("vec_id").cast("bigint"), K.argmax(F.col("gl")).cast("bigint").alias("argmax"),
                    R6(F.array_max("gl")).alias("max_logit"))


# ------------------------------------------------------------ K5 ----
K5_SQL = f"""
WITH {SOFTMAX_SQL},
c AS (SELECT label, vec_id, list_position(logits, list_max(logits)) - 1 AS x0,
      p[list_position(logits, list_max(logits))] AS conf, {Q.u('masked', 'vec_id')} < 0.5 AS cand FROM prob),
n AS (SELECT *, sum(CAST(cand AS INTEGER)) OVER (PARTITION BY label) AS n_cand FROM c),
q AS (SELECT *, n_cand // 4 + CASE WHEN 0 < n_cand % 4 THEN 1 ELSE 0 END AS quota,
      row_number() OVER (PARTITION BY label ORDER BY cand DESC, conf DESC, vec_id) AS rk FROM n)
SELECT CAST(label AS BIGINT) AS label, CAST(vec_id AS BIGINT) AS vec_id, CAST(x0 AS BIGINT) AS x0,
       cand AND rk <= quota AS released
FROM q
"""


@register("k5_release_step", K5_SQL)
def k5_release_step(spark, sf, rng="portable"):
    d = (_probs(spark, sf).withColumn("x0", K.argmax(F.col("logits")))
         .withColumn("conf", F.get(F.col("p"), F.col("x0")))
         .withColumn("candidate", uniform("masked", "vec_id", rng=rng) < 0.5))
    # the stand-in "sequence" is a label group (a tenth of the rows each):
    # candidate counts are a partial aggregate, ranking the skew-safe index
    n = d.groupBy("label").agg(F.sum(F.col("candidate").cast("int")).alias("_n"))
    d = d.join(n, "label").withColumn("quota", F.get(K.transfer_quota(F.col("_n"), 4), 0))
    r = K.release(d, "label", F.col("quota"), pos="vec_id")
    return r.select(F.col("label").cast("bigint"), F.col("vec_id").cast("bigint"), F.col("x0").cast("bigint"),
                    "released")


K5_BLOCK = (100, 300)


@register("k5_release_random_block", f"""
WITH {SOFTMAX_SQL},
c AS (SELECT label, vec_id, {Q.u('release', 'vec_id')} AS conf,
      {Q.u('masked', 'vec_id')} < 0.5 AND vec_id >= {K5_BLOCK[0]} AND vec_id < {K5_BLOCK[1]} AS cand FROM prob),
q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cand DESC, conf DESC, vec_id) AS rk FROM c)
SELECT CAST(label AS BIGINT) AS label, CAST(vec_id AS BIGINT) AS vec_id, cand AND rk <= 3 AS released FROM q
""")
def k5_release_random_block(spark, sf, rng="portable"):
    """The random strategy within one block of positions."""
    d = (_probs(spark, sf).withColumn("conf", K.confidence("random", F.lit(0.0), "vec_id", rng=rng))
         .withColumn("candidate", uniform("masked", "vec_id", rng=rng) < 0.5))
    r = K.release(d, "label", F.lit(3), pos="vec_id", block=K5_BLOCK)
    return r.select(F.col("label").cast("bigint"), F.col("vec_id").cast("bigint"), "released")


# ---------------------------------------------------- bucket metrics ----
def _masked(spark, sf, rng="portable"):
    """Positions with their sample (label), mask flag and sample bucket.

    Per-sample counts are a partial aggregate joined back (one row per
    sample), not a window: a sample's positions never meet in one task."""
    d = _probs(spark, sf).withColumn(
        "masked", uniform("mask", "vec_id", rng=rng) < uniform("ratio", "label", rng=rng))
    per = d.groupBy("label").agg(F.sum(F.col("masked").cast("int")).alias("n_masked"),
                                 F.count(F.lit(1)).alias("n"))
    per = per.withColumn("bucket", A.masked_bucket(F.col("n_masked"), F.col("n")))
    return d.join(per, "label")


MASKED_SQL = f"""{SOFTMAX_SQL},
mk AS (SELECT *, {Q.u('mask', 'vec_id')} < {Q.u('ratio', 'label')} AS masked FROM prob),
cnt AS (SELECT *, sum(CAST(masked AS INTEGER)) OVER (PARTITION BY label) AS n_masked,
        count(*) OVER (PARTITION BY label) AS n FROM mk),
bk AS (SELECT *, greatest(0, (10 * n_masked + n - 1) // n - 1) AS bucket FROM cnt),
buckets AS (SELECT CAST(range AS INTEGER) AS bucket FROM range(10))"""


A3_SQL = f"""
WITH {MASKED_SQL},
e AS (SELECT label, bucket, -list_sum(list_transform(p, lambda q: CASE WHEN q > 0 THEN q * ln(q) ELSE 0.0 END)) AS ent
      FROM bk WHERE masked),
s AS (SELECT label, any_value(bucket) AS bucket, avg(ent) AS v FROM e GROUP BY label),
b AS (SELECT bucket, avg(v) AS v FROM s GROUP BY bucket)
SELECT CAST(buckets.bucket AS BIGINT) AS bucket, round(coalesce(b.v, 0.0), 6) AS value
FROM buckets LEFT JOIN b ON buckets.bucket = b.bucket
"""


@register("a3_pixel_entropy_bucket", A3_SQL)
def a3_pixel_entropy_bucket(spark, sf, rng="portable"):
    d = _masked(spark, sf, rng).where("masked").withColumn("ent", A.entropy(F.col("p")))
    per = d.groupBy("label").agg(F.first("bucket").alias("bucket"), F.avg("ent").alias("v"))
    out = A.average_by_buckets(per, "bucket", "v")
    return out.select(F.col("bucket").cast("bigint"), R6(F.col("value")).alias("value"))


A4_SQL = f"""
WITH {MASKED_SQL},
r AS (SELECT label, bucket, unnest(range(64)) AS k, unnest(p) AS q FROM bk WHERE masked),
m AS (SELECT label, any_value(bucket) AS bucket, k, avg(q) AS q FROM r GROUP BY label, k),
s AS (SELECT label, any_value(bucket) AS bucket, -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0.0 END) AS v FROM m GROUP BY label),
b AS (SELECT bucket, avg(v) AS v FROM s GROUP BY bucket)
SELECT CAST(buckets.bucket AS BIGINT) AS bucket, round(coalesce(b.v, 0.0), 6) AS value
FROM buckets LEFT JOIN b ON buckets.bucket = b.bucket
"""


@register("a4_image_entropy_bucket", A4_SQL)
def a4_image_entropy_bucket(spark, sf, rng="portable"):
    d = explode_rows(_masked(spark, sf, rng).where("masked"), ["label", "bucket"], "p", pos="k", out="q")
    m = d.groupBy("label", "k").agg(F.first("bucket").alias("bucket"), F.avg("q").alias("q"))
    s = m.groupBy("label").agg(F.first("bucket").alias("bucket"),
                               (-F.sum(F.when(F.col("q") > 0, F.col("q") * F.log("q")).otherwise(0.0))).alias("v"))
    out = A.average_by_buckets(s, "bucket", "v")
    return out.select(F.col("bucket").cast("bigint"), R6(F.col("value")).alias("value"))


A5_SQL = f"""
WITH {MASKED_SQL},
z AS (SELECT *, ln(list_sum(list_transform(logits, lambda w: exp(w - list_max(logits))))) + list_max(logits) AS lse FROM bk),
l AS (SELECT *, list_transform(logits, lambda v: v - lse) AS lp FROM z),
ce AS (SELECT bucket, 0.9 * (-lp[label + 1]) + 0.1 * (-list_sum(lp)) / 64.0 AS v FROM l WHERE masked),
b AS (SELECT bucket, avg(v) AS v FROM ce GROUP BY bucket)
SELECT CAST(buckets.bucket AS BIGINT) AS bucket, round(coalesce(b.v, 0.0), 6) AS value
FROM buckets LEFT JOIN b ON buckets.bucket = b.bucket
"""


@register("a5_cross_entropy_bucket", A5_SQL)
def a5_cross_entropy_bucket(spark, sf, rng="portable"):
    d = _masked(spark, sf, rng).where("masked")  # unmasked positions carry label -100 (ignored)
    d = A.with_log_softmax(d, "logits", "lp").withColumn("v", A.smoothed_ce(F.col("lp"), F.col("label"), 0.1))
    out = A.average_by_buckets(d, "bucket", "v")
    return out.select(F.col("bucket").cast("bigint"), R6(F.col("value")).alias("value"))


A6_SQL = f"""
WITH {MASKED_SQL},
first_sample AS (SELECT bucket, min(label) AS label FROM bk GROUP BY bucket),
first_pos AS (SELECT f.bucket, min(b.vec_id) AS vec_id FROM first_sample f JOIN bk b
              ON b.label = f.label AND b.masked GROUP BY f.bucket),
r AS (SELECT fp.bucket, unnest(range(64)) AS k, unnest(b.p) AS prob FROM first_pos fp JOIN bk b ON b.vec_id = fp.vec_id)
SELECT CAST(bucket AS BIGINT) AS bucket, CAST(k AS BIGINT) AS k, round(prob, 6) AS prob FROM r
"""


@register("a6_token_distribution_bucket", A6_SQL)
def a6_token_distribution_bucket(spark, sf, rng="portable"):
    d = _masked(spark, sf, rng)
    first_sample = d.groupBy("bucket").agg(F.min("label").alias("label"))
    cand = d.where("masked").join(first_sample, ["bucket", "label"])
    rep = cand.groupBy("bucket").agg(F.min_by("p", "vec_id").alias("p"))
    r = explode_rows(rep, ["bucket"], "p", pos="k", out="prob")
    return r.select(F.col("bucket").cast("bigint"), F.col("k").cast("bigint"), R6(F.col("prob")).alias("prob"))


A2_SQL = f"""
WITH {MASKED_SQL},
s AS (SELECT label, any_value(bucket) AS bucket, avg(logits[label + 1]) AS v FROM bk GROUP BY label),
b AS (SELECT bucket, avg(v) AS v FROM s GROUP BY bucket)
SELECT CAST(buckets.bucket AS BIGINT) AS bucket, round(coalesce(b.v, 0.0), 6) AS value
FROM buckets LEFT JOIN b ON buckets.bucket = b.bucket
"""


@register("a2_average_by_bucket", A2_SQL)
def a2_average_by_bucket(spark, sf, rng="portable"):
    d = _masked(spark, sf, rng).withColumn("t", F.get(F.col("logits"), F.col("label")))
    per = d.groupBy("label").agg(F.first("bucket").alias("bucket"), F.avg("t").alias("v"))
    out = A.average_by_buckets(per, "bucket", "v")
    return out.select(F.col("bucket").cast("bigint"), R6(F.col("value")).alias("value"))


A7_SQL = f"""
WITH {I.LOGITS_SQL},
m AS (SELECT label, logits, CAST({Q.u('attn', 'vec_id')} < 0.9 AS DOUBLE) AS w FROM logits),
r AS (SELECT label, w, unnest(range(64)) AS k, unnest(logits) AS x FROM m)
SELECT CAST(label AS BIGINT) AS label, CAST(k AS BIGINT) AS k, round(sum(x * w) / (sum(w) + 1e-5), 6) AS pooled
FROM r GROUP BY label, k
"""


@register("a7_masked_mean_pool", A7_SQL)
def a7_masked_mean_pool(spark, sf, rng="portable"):
    d = I.logits(spark, sf).withColumn("w", (uniform("attn", "vec_id", rng=rng) < 0.9).cast("double"))
    r = d.select("label", "w", F.posexplode("logits").alias("k", "x"))
    out = r.groupBy("label", "k").agg((F.sum(F.col("x") * F.col("w")) / (F.sum("w") + F.lit(1e-5))).alias("pooled"))
    return out.select(F.col("label").cast("bigint"), F.col("k").cast("bigint"), R6(F.col("pooled")).alias("pooled"))


A9_SQL = f"""
WITH {I.LOGITS_SQL},
f AS (SELECT label, min(vec_id) AS first_id FROM logits GROUP BY label),
r AS (SELECT l.vec_id, l.logits[1:32] AS lg, list_reverse(l.logits)[1:32] AS st,
      CASE WHEN {Q.u('ign', 'l.vec_id')} < 0.3 THEN -100 ELSE l.label END AS target
      FROM logits l JOIN f ON l.label = f.label WHERE l.vec_id <> f.first_id),
s AS (SELECT *, list_max(lg) AS mx, list_max(st) AS smx FROM r),
q AS (SELECT *, list_transform(st, lambda v: exp(v - smx) / list_sum(list_transform(st, lambda w: exp(w - smx)))) AS soft,
      ln(list_sum(list_transform(lg, lambda w: exp(w - mx)))) + mx AS lse FROM s),
l AS (SELECT target, list_sum(list_transform(range(32), lambda i: -soft[i + 1] * (lg[i + 1] - lse))) AS loss FROM q)
SELECT round(sum(CASE WHEN target = -100 THEN 0.0 ELSE loss END) / sum(CASE WHEN target = -100 THEN 0 ELSE 1 END), 6) AS loss
FROM l
"""


@register("a9_soft_target_ce", A9_SQL)
def a9_soft_target_ce(spark, sf, rng="portable"):
    lg = I.logits(spark, sf)
    first = lg.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    d = lg.join(first, "label").where(F.col("vec_id") != F.col("first_id"))
    d = d.select(F.slice("logits", 1, 32).alias("lg"), F.slice(F.reverse("logits"), 1, 32).alias("st"),
                 F.when(uniform("ign", "vec_id", rng=rng) < 0.3, F.lit(-100)).otherwise(F.col("label")).alias("target"))
    d = A.with_log_softmax(K.with_softmax(d, "st", "soft"), "lg", "lp")
    d = d.withColumn("loss", F.aggregate(F.zip_with("soft", "lp", lambda s, p: -s * p), F.lit(0.0),
                                         lambda a, v: a + v))
    active = F.col("target") != -100
    out = d.agg((F.sum(F.when(active, F.col("loss")).otherwise(0.0)) / F.sum(active.cast("int"))).alias("loss"))
    return out.select(R6(F.col("loss")).alias("loss"))


A13_SQL = f"""
WITH {I.LOGITS_SQL},
r AS (SELECT label, unnest(logits) AS x FROM logits)
SELECT CAST(label AS BIGINT) AS label, round(sqrt(sum(x * x)) / count(*), 6) AS norm FROM r GROUP BY label
"""


@register("a13_norm_per_numel", A13_SQL)
def a13_norm_per_numel(spark, sf):
    out = A.norm_per_numel(I.logits(spark, sf), ["label"], "logits")
    return out.select(F.col("label").cast("bigint"), R6(F.col("norm")).alias("norm"))
