"""E3 chat training feed: CHAT -> P1 render -> T1/T5 -> P7 -> N5.

Built in long form (one row per token position) so that no conversation is
ever gathered into one row: a conversation holding a third of all turns is
first cut to the turns that can still reach ``max_seq_len`` (top-k per
conversation, limited on the map side; each turn yields at least one token),
after which every per-conversation window sees at most ``max_seq_len``
turns / positions.

Shuffles: one by conversation (the later windows reuse its partitioning);
the vocabulary is a separate bounded aggregate that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions import constants as K
from ..functions import text as T
from ..functions.rng import uniform
from ..operators import tokens as TK
from ..operators.ordering import dense_index, top_k_per_group


def turn_segments(conv: DataFrame, *, add_generation_prompt: bool = False,
                  close_tag: str = K.EOT_TOKEN) -> DataFrame:
    """P1 per turn: ``<|start_header_id|>role<|end_header_id|>\\n`` + trimmed
    content + close tag. Order key ``(_g, turn)``; ``_g = 1`` marks the
    generation prompt appended after the last turn when asked."""
    seg = F.concat(F.lit(K.START_HEADER_TOKEN), F.col("role"), F.lit(K.END_HEADER_TOKEN + "\n"),
                   T.strip_ws(F.coalesce(F.col("text"), F.lit(""))), F.lit(close_tag))
    rows = conv.select("conv_id", F.lit(0).alias("_g"), F.col("turn").cast("bigint").alias("turn"),
                       seg.alias("segment"))
    if add_generation_prompt:
        gen = (conv.groupBy("conv_id").agg(F.max("turn").cast("bigint").alias("turn"))
               .select("conv_id", F.lit(1).alias("_g"), (F.col("turn") + 1).alias("turn"),
                       F.lit(K.START_HEADER_TOKEN + "assistant" + K.END_HEADER_TOKEN + "\n")
                       .alias("segment")))
        rows = rows.unionByName(gen)
    return rows


def render_chat_segments(conv: DataFrame, *, add_generation_prompt: bool = True,
                         close_tag: str = K.EOT_TOKEN) -> DataFrame:
    """P1 as text pieces: ``(conv_id, piece_no, piece)``; concatenating the
    pieces of a conversation in ``piece_no`` order gives the rendered chat
    (bos text on the first turn). Kept as rows so a very long conversation
    never has to be one value."""
    rows = turn_segments(conv, add_generation_prompt=add_generation_prompt, close_tag=close_tag)
    # piece number = dense position of the turn in its conversation, via the
    # skew-safe grouped index (a huge conversation is split across tasks)
    rows = dense_index(rows, ["_g", "turn"], group_by=["conv_id"], out="piece_no")
    return rows.select(
        "conv_id", F.col("piece_no").cast("bigint"),
        F.when(F.col("piece_no") == 0, F.concat(F.lit(K.BOS_TOKEN), F.col("segment")))
        .otherwise(F.col("segment")).alias("piece"))


def chat_vocab(conv: DataFrame, *, max_size: int = K.MAX_WORD_VOCAB,
               close_tag: str = K.EOT_TOKEN) -> DataFrame:
    """T3 over the rendered turns of the whole chat corpus, plus specials."""
    segs = turn_segments(conv, close_tag=close_tag).select(T.tokens(F.col("segment")).alias("_st"))
    toks = AR.explode_rows(segs, [], "_st", out="token", keep_pos=False)
    return TK.with_specials(TK.build_vocab(toks, max_size=max_size))


def chat_positions(conv: DataFrame, max_seq_len: int, *, add_generation_prompt: bool = False,
                   close_tag: str = K.EOT_TOKEN, salts: int | None = None) -> DataFrame:
    """P1 + T1 + P6 padding in long form: ``(conv_id, pos, token)`` for
    ``pos`` in ``[0, max_seq_len)``: bos, turn tokens, then eos to the end
    (the sequence is ``([bos] + tokens + [eos]*L)[:L]``)."""
    L = int(max_seq_len)
    segs = turn_segments(conv, add_generation_prompt=add_generation_prompt, close_tag=close_tag)
    # Only the first L turns can contribute (each turn has >= 1 token).
    segs = top_k_per_group(segs, ["conv_id"], ["_g", "turn"], L, salts=salts, rank_col="_rank")
    w = Window.partitionBy("conv_id").orderBy("_g", "turn")
    segs = segs.withColumn("_st", T.tokens(F.col("segment"))).drop("segment")  # tokenised once per turn
    segs = (segs.withColumn("_first", F.col("_rank") == 1).drop("_rank")
            .withColumn("_toks", F.when(F.col("_first"), F.concat(F.array(F.lit(K.BOS_TOKEN)), F.col("_st")))
                        .otherwise(F.col("_st")))
            .withColumn("_n", F.size("_toks")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    segs = (segs.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy("conv_id"))))
    # Turn tokens that still fit, plus (on the first turn's row) eos padding.
    own = F.transform(
        F.slice("_toks", 1, F.greatest(F.least(F.lit(L) - F.col("_off"), F.col("_n")), F.lit(0))),
        lambda t, i: F.struct((F.col("_off") + i).cast("int").alias("pos"), t.alias("token")))
    pad = F.when(
        F.col("_first") & (F.col("_total") < L),
        F.transform(F.sequence(F.col("_total").cast("int"), F.lit(L - 1)),
                    lambda p: F.struct(p.alias("pos"), F.lit(K.EOS_TOKEN).alias("token"))),
    ).otherwise(F.array().cast("array<struct<pos:int,token:string>>"))
    rows = AR.explode_rows(segs, ["conv_id"], F.concat(own, pad), pos="_i", out="_t", keep_pos=False)
    return rows.select("conv_id", F.col("_t.pos").alias("pos"), F.col("_t.token").alias("token"))


def chat_feed(conv: DataFrame, *, max_seq_len: int = 512, eps: float = 1e-3,
              clamp_min: bool = True, add_generation_prompt: bool = False,
              close_tag: str = K.EOT_TOKEN, vocab: DataFrame | None = None,
              seed: int = 0, rng: str = "portable") -> DataFrame:
    """Flagship: masked chat training rows.

    Columns: ``conv_id, pos, token_id, noisy_id, label, prompt_mask, p_mask,
    answer_len``. ``prompt_mask`` = 1 up to and including the last
    end-header (P7); the diffusion mask (N5) draws ``t = u('t', conv)``,
    ``p = (1-eps)t + eps`` and masks a non-prompt position when
    ``u('mask', conv, pos) < p``. ``label`` is the clean id (the loss keeps
    masked positions only); ``answer_len`` = non-prompt positions, >= 1 when
    ``clamp_min``.
    """
    L = int(max_seq_len)
    if vocab is None:
        vocab = chat_vocab(conv, close_tag=close_tag)
    pos = chat_positions(conv, L, add_generation_prompt=add_generation_prompt, close_tag=close_tag)
    pos = TK.encode_long(pos, vocab, "token", "token_id")
    wc = Window.partitionBy("conv_id")
    last_header = F.max(F.when(F.col("token_id") == K.END_HEADER_ID, F.col("pos"))).over(wc)
    prompt_len = F.coalesce(last_header + 1, F.lit(0))
    p_mask = (1.0 - eps) * uniform("t", "conv_id", seed=seed, rng=rng) + eps
    ans = F.lit(L) - F.col("prompt_len")
    if clamp_min:
        ans = F.greatest(ans, F.lit(1))
    out = (pos.withColumn("prompt_len", prompt_len)
           .withColumn("prompt_mask", (F.col("pos") < F.col("prompt_len")).cast("int"))
           .withColumn("p_mask", p_mask)
           .withColumn("_m", (uniform("mask", "conv_id", "pos", seed=seed, rng=rng) < F.col("p_mask"))
                       & (F.col("prompt_mask") == 0))
           .withColumn("noisy_id", F.when(F.col("_m"), F.lit(K.MASK_ID)).otherwise(F.col("token_id")))
           .withColumn("answer_len", ans.cast("int")))
    return out.select("conv_id", "pos", "token_id", "noisy_id", F.col("token_id").alias("label"),
                      "prompt_mask", "p_mask", "answer_len")
