"""Queries over CHAT (= ``conversations``): P1, P2, P7, N5, C8, T8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import table
from . import sqlkit as Q
from ..operators import tokens as TK
from .chat_feed import chat_feed, chat_vocab
from .registry import register

CHAT_LEN = 512


def _chat_positions_sql(L: int, gen_prompt: bool = False) -> str:
    """SQL for (conv_id, pos, token) of the padded/cut chat sequence."""
    gen = ""
    if gen_prompt:
        gen = (f" UNION ALL SELECT conv_id, 1 AS g, max(turn) + 1 AS turn, "
               f"'{K.START_HEADER_TOKEN}assistant{K.END_HEADER_TOKEN}' || chr(10) AS segment "
               f"FROM conversations GROUP BY conv_id")
    return f"""
seg AS (SELECT conv_id, 0 AS g, turn, {Q.segment()} AS segment FROM conversations{gen}),
segtok AS (SELECT conv_id, g, turn, {Q.tokens('segment')} AS toks0,
           row_number() OVER (PARTITION BY conv_id ORDER BY g, turn) AS rn FROM seg),
withbos AS (SELECT conv_id, g, turn,
            CASE WHEN rn = 1 THEN list_concat(['{K.BOS_TOKEN}'], toks0) ELSE toks0 END AS toks FROM segtok),
offs AS (SELECT conv_id, g, turn, toks,
         CAST(coalesce(sum(len(toks)) OVER (PARTITION BY conv_id ORDER BY g, turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off,
         CAST(sum(len(toks)) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM withbos),
turn_pos AS (SELECT conv_id, off + i AS pos, toks[i + 1] AS token
             FROM (SELECT conv_id, off, toks, unnest(range(len(toks))) AS i FROM offs) x),
pad_pos AS (SELECT conv_id, unnest(range(total, {L})) AS pos, '{K.EOS_TOKEN}' AS token
            FROM (SELECT DISTINCT conv_id, total FROM offs) t WHERE total < {L}),
positions AS (SELECT * FROM turn_pos WHERE pos < {L} UNION ALL SELECT * FROM pad_pos)"""


def _chat_vocab_sql() -> str:
    return Q.vocab_from(f"SELECT unnest({Q.tokens(Q.segment())}) AS token FROM conversations")


N5_SQL = f"""
WITH {_chat_positions_sql(CHAT_LEN)},
vocab AS {_chat_vocab_sql()},
enc AS (SELECT p.conv_id, p.pos, coalesce(v.id, {K.UNK_ID}) AS token_id
        FROM positions p LEFT JOIN vocab v ON p.token = v.token),
pl AS (SELECT *, coalesce(max(CASE WHEN token_id = {K.END_HEADER_ID} THEN pos END)
                 OVER (PARTITION BY conv_id) + 1, 0) AS prompt_len FROM enc),
m AS (SELECT *, CAST(pos < prompt_len AS INTEGER) AS prompt_mask,
      CAST(0.999 AS DOUBLE) * {Q.u('t', 'conv_id')} + CAST(0.001 AS DOUBLE) AS p_mask FROM pl)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(pos AS BIGINT) AS pos, CAST(token_id AS BIGINT) AS token_id,
       CAST(CASE WHEN {Q.u('mask', 'conv_id', 'pos')} < p_mask AND prompt_mask = 0
            THEN {K.MASK_ID} ELSE token_id END AS BIGINT) AS noisy_id,
       CAST(token_id AS BIGINT) AS label, CAST(prompt_mask AS BIGINT) AS prompt_mask,
       round(p_mask, 6) AS p_mask, CAST(greatest({CHAT_LEN} - prompt_len, 1) AS BIGINT) AS answer_len
FROM m
"""


@register("n5_chat_mask", N5_SQL)
def n5_chat_mask(spark, sf_dir, rng: str = "portable"):
    """Flagship: chat render -> tokens -> last-header prompt mask -> diffusion mask."""
    conv = table(spark, sf_dir, "conversations")
    df = chat_feed(conv, max_seq_len=CHAT_LEN, rng=rng)
    return df.select(
        F.col("conv_id").cast("bigint"), F.col("pos").cast("bigint"), F.col("token_id").cast("bigint"),
        F.col("noisy_id").cast("bigint"), F.col("label").cast("bigint"),
        F.col("prompt_mask").cast("bigint"), F.round("p_mask", 6).alias("p_mask"),
        F.col("answer_len").cast("bigint"))


# ---------------------------------------------------------------- P1 ----
P1_SQL = f"""
WITH seg AS (SELECT conv_id, 0 AS g, turn, {Q.segment()} AS segment FROM conversations
             UNION ALL SELECT conv_id, 1 AS g, max(turn) + 1 AS turn,
             '{K.START_HEADER_TOKEN}assistant{K.END_HEADER_TOKEN}' || chr(10) AS segment FROM conversations GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY g, turn) AS rn FROM seg)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(rn - 1 AS BIGINT) AS piece_no,
       CASE WHEN rn = 1 THEN '{K.BOS_TOKEN}' || segment ELSE segment END AS piece
FROM r
"""


@register("p1_chat_render", P1_SQL)
def p1_chat_render(spark, sf):
    from .chat_feed import render_chat_segments
    r = render_chat_segments(table(spark, sf, "conversations"), add_generation_prompt=True)
    return r.select(F.col("conv_id").cast("bigint"), F.col("piece_no").cast("bigint"), "piece")


# ---------------------------------------------------------------- P7 ----
P7_SQL = f"""
WITH {_chat_positions_sql(CHAT_LEN)},
vocab AS {_chat_vocab_sql()},
enc AS (SELECT p.conv_id, p.pos, coalesce(v.id, {K.UNK_ID}) AS token_id FROM positions p LEFT JOIN vocab v ON p.token = v.token)
SELECT CAST(conv_id AS BIGINT) AS conv_id,
       CAST(coalesce(max(CASE WHEN token_id = {K.END_HEADER_ID} THEN pos END) + 1, 0) AS BIGINT) AS prompt_len,
       CAST(count(*) AS BIGINT) AS seq_len
FROM enc GROUP BY conv_id
"""


@register("p7_lm_chat_prompt", P7_SQL)
def p7_lm_chat_prompt(spark, sf):
    conv = table(spark, sf, "conversations")
    df = chat_feed(conv, max_seq_len=CHAT_LEN)
    return df.groupBy("conv_id").agg(
        F.sum("prompt_mask").cast("bigint").alias("prompt_len"),
        F.count(F.lit(1)).cast("bigint").alias("seq_len")).select(
        F.col("conv_id").cast("bigint"), "prompt_len", "seq_len")


# ---------------------------------------------------------------- T8 ----
T8_SQL = f"""
WITH n5 AS ({N5_SQL}),
words AS (SELECT token, id FROM {_chat_vocab_sql()} v WHERE id < {K.MAX_WORD_VOCAB})
SELECT n5.conv_id, n5.pos, CASE WHEN n5.noisy_id = {K.MASK_ID} THEN 'MASK' ELSE 'GEN' END AS kind,
       CASE WHEN n5.noisy_id = {K.MASK_ID} THEN '[MASK]' ELSE coalesce(w.token, '') END AS token
FROM n5 LEFT JOIN words w ON n5.noisy_id = w.id
WHERE n5.prompt_mask = 0
"""


@register("t8_label_positions", T8_SQL)
def t8_label_positions(spark, sf, rng="portable"):
    conv = table(spark, sf, "conversations")
    vocab = chat_vocab(conv)
    df = chat_feed(conv, max_seq_len=CHAT_LEN, vocab=vocab, rng=rng).where(F.col("prompt_mask") == 0)
    words = F.broadcast(vocab.where(F.col("id") < K.MAX_WORD_VOCAB)
                        .select(F.col("id").alias("_id"), F.col("token").alias("_w")))
    masked = F.col("noisy_id") == K.MASK_ID
    out = df.join(words, F.col("noisy_id") == F.col("_id"), "left")
    return out.select(F.col("conv_id").cast("bigint"), F.col("pos").cast("bigint"),
                      F.when(masked, "MASK").otherwise("GEN").alias("kind"),
                      F.when(masked, "[MASK]").otherwise(F.coalesce(F.col("_w"), F.lit(""))).alias("token"))


# ---------------------------------------------------------------- C8 ----
_PREFIX_SQL = "'" + K.THINKING_PREFIX.rstrip("\n") + "' || chr(10)"


@register("c8_thinking_prefix", f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       CASE WHEN role = 'user' THEN {_PREFIX_SQL} || text ELSE text END AS text
FROM conversations
""")
def c8_thinking_prefix(spark, sf):
    from ..operators.clean import thinking_prefix
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                    thinking_prefix(F.col("text"), F.col("role") == "user").alias("text"))


# ---------------------------------------------------------------- P2 ----
P2_SQL = f"""
WITH vocab AS {_chat_vocab_sql()},
q AS (SELECT conv_id, turn, {Q.tokens(f"'{K.START_HEADER_TOKEN}user{K.END_HEADER_TOKEN}' || chr(10) || text || '{K.EOT_TOKEN}{K.START_HEADER_TOKEN}assistant{K.END_HEADER_TOKEN}' || chr(10)")} AS toks
      FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, unnest(range(len(toks))) AS i, unnest(toks) AS token FROM q),
e AS (SELECT r.conv_id, r.turn, list(coalesce(v.id, {K.UNK_ID}) ORDER BY r.i) AS ids
      FROM r LEFT JOIN vocab v ON r.token = v.token GROUP BY r.conv_id, r.turn)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       array_to_string(list_concat([{K.BOS_ID}], ids), ',') AS ids FROM e
"""


def question_ids(conv, vocab, close_tag: str = K.EOT_TOKEN):
    """Each user question wrapped in user/assistant headers (close tag is
    a parameter), tokenised, encoded, bos id prepended."""
    from ..operators import prompts as PR
    from ..functions import text as TX
    q = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", TX.tokens(F.concat(F.lit(K.START_HEADER_TOKEN + "user" + K.END_HEADER_TOKEN + "\n"),
                                              F.col("text"), F.lit(close_tag + K.START_HEADER_TOKEN + "assistant"
                                                                   + K.END_HEADER_TOKEN + "\n"))).alias("tokens"))
    enc = TK.encode(q, vocab, ["conv_id", "turn"])
    return enc.withColumn("ids", PR.chat_wrap(F.col("ids")))


@register("p2_question_wrap", P2_SQL)
def p2_question_wrap(spark, sf):
    conv = table(spark, sf, "conversations")
    q = question_ids(conv, chat_vocab(conv))
    return q.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                    F.array_join(F.transform("ids", lambda v: v.cast("string")), ",").alias("ids"))
