"""Tokens and vocabulary.

The vocabulary is a ``(token string, id int)`` table. Word ids come from
corpus frequency (0 .. ``MAX_WORD_VOCAB``-1), special markers have fixed ids
(``constants.SPECIAL_TOKENS``). Its size is checked before every broadcast; a
larger one is looked up in two steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def tokenise(df: DataFrame, text_col: str = "text", *, max_len: int | None = None,
             out: str = "tokens", mask_out: str | None = None) -> DataFrame:
    """Word tokens, truncated to ``max_len``; optional attention mask of ones."""
    toks = T.tokens(F.col(text_col))
    if max_len is not None:
        toks = F.slice(toks, 1, max_len)
    res = df.withColumn(out, toks)
    if mask_out:
        res = res.withColumn(mask_out, F.array_repeat(F.lit(1), F.size(out)))
    return res


def tokenise_selfies(df: DataFrame, col: str = "selfies", *, max_len: int | None = None,
                     out: str = "tokens") -> DataFrame:
    """Bracketed SELFIES symbols, truncated to ``max_len``."""
    toks = T.selfies_tokens(F.col(col))
    if max_len is not None:
        toks = F.slice(toks, 1, max_len)
    return df.withColumn(out, toks)


def special_tokens(spark: SparkSession) -> DataFrame:
    """The fixed special-token dimension ``(token, id)``."""
    rows = sorted(K.SPECIAL_TOKENS.items(), key=lambda kv: kv[1])
    return spark.createDataFrame(rows, "token string, id int")


def build_vocab(token_rows: DataFrame, token_col: str = "token", *,
                max_size: int | None = K.MAX_WORD_VOCAB,
                id_space: int | None = None) -> DataFrame:
    """Word vocabulary ``(token, id, count)`` by descending frequency
    (ties by token), at most ``max_size`` words (None: all). Special markers
    are left out. ``id_space`` is the first id that is taken; asking for more
    words than fit below it is an error.

    Counting is a partial (map-side combined) aggregate. Ranking goes
    through the distributed dense index, so neither the distinct-token table
    (which grows with the corpus) nor ``partitions x max_size`` top-k
    candidates ever pass through a single task.
    """
    from .ordering import dense_index
    if id_space is not None and (max_size is None or max_size > id_space):
        raise ValueError(f"{max_size or 'all'} words do not fit below id {id_space}")
    counts = (token_rows.where(~T.is_marker(F.col(token_col)))
              .groupBy(F.col(token_col).alias("token"))
              .agg(F.count(F.lit(1)).alias("count")))
    ranked = dense_index(counts, [F.desc("count"), F.asc("token")], out="_rank")
    return ((ranked if max_size is None else ranked.where(F.col("_rank") < max_size))
            .select("token", "count", F.col("_rank").cast("int").alias("id")))


def with_specials(vocab: DataFrame) -> DataFrame:
    """Word vocabulary plus the special dimension, ``(token, id)``."""
    spark = vocab.sparkSession
    return vocab.select("token", "id").unionByName(special_tokens(spark))


def extend_vocab(vocab: DataFrame, alphabet: DataFrame, token_col: str = "token") -> DataFrame:
    """T4: append alphabet tokens missing from the vocabulary; new ids follow
    the current maximum id in token order. Returns the new rows only."""
    missing = (alphabet.select(F.col(token_col).alias("token")).distinct()
               .join(vocab.select("token"), "token", "left_anti"))
    from .ordering import dense_index
    base = vocab.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]  # one scalar
    ranked = dense_index(missing, ["token"], out="_r")
    return ranked.select("token", (F.lit(int(base)) + 1 + F.col("_r")).cast("int").alias("id"))


#: Up to this many bytes a vocabulary is broadcast whole; of a larger one, its most frequent tokens are.
BROADCAST_BYTES = 64 << 20
#: What a vocabulary row takes beside its token's bytes.
ROW_BYTES = 48


def broadcast_share(vocab: DataFrame, limit: int) -> tuple[int | None, int]:
    """(cut, bytes): ids below ``cut`` fit a broadcast of ``limit`` bytes together
    with the special tokens (None: all do). Ids follow frequency, so the tokens
    below the cut are the most frequent ones. Sizes are counted, not assumed."""
    wide = F.octet_length("token") + ROW_BYTES
    size, most, ids = vocab.agg(F.sum(wide), F.max(wide), F.max("id")).first()
    if (size or 0) <= limit:
        return None, size or 0
    # token widths are uneven: count bytes below candidate cuts, then take the largest that fits
    cuts = sorted({int((ids + 1) * k / 64) for k in range(1, 65)} | {limit // most})
    below = vocab.agg(*[F.sum(F.when(F.col("id") < c, wide)).alias(f"c{c}") for c in cuts]).first()
    return max([c for c in cuts if (below[f"c{c}"] or 0) <= limit], default=0), size


def _looked_up(rows: DataFrame, vocab: DataFrame, key: str, on: str, give: str, limit: int) -> DataFrame:
    """``rows`` with ``_found``, the vocabulary's ``give`` where its ``on`` equals ``key``.

    A vocabulary that fits is broadcast. Of a larger one the frequent ids and the
    special tokens are, which settles nearly all rows in place; only rows of rare
    tokens are shuffled, and no rare token is a hot key."""
    v = vocab.select(F.col(on).alias("_on"), F.col(give).alias("_found"), F.col("id").alias("_vid"))
    cut, _ = broadcast_share(vocab, limit)
    if cut is None:
        return rows.join(F.broadcast(v.drop("_vid")), F.col(key) == F.col("_on"), "left").drop("_on")
    heavy = (F.col("_vid") < cut) | F.col("_vid").isin(*K.SPECIAL_TOKENS.values())
    near = rows.join(F.broadcast(v.where(heavy).drop("_vid")), F.col(key) == F.col("_on"), "left").drop("_on")
    open_ = F.col("_found").isNull() & F.col(key).isNotNull()
    far = near.where(open_).drop("_found").join(v.where(~heavy).drop("_vid"), F.col(key) == F.col("_on"), "left").drop("_on")
    return near.where(~open_).unionByName(far)


def encode_long(token_rows: DataFrame, vocab: DataFrame, token_col: str = "token",
                out: str = "token_id", *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """T5 (long form): one row per token, its id looked up, unknown -> unk.

    ``vocab`` may have any size, see ``_looked_up``."""
    rows = _looked_up(token_rows, vocab, token_col, "token", "id", broadcast_bytes)
    return rows.withColumn(out, F.coalesce(F.col("_found"), F.lit(K.UNK_ID))).drop("_found")


def encode(df: DataFrame, vocab: DataFrame, key: str | list[str], tokens_col: str = "tokens",
           out: str = "ids", *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """T5 (dense form): array of tokens -> array of ids, order kept.

    Explodes, looks ids up through a broadcast join and regroups by ``key``
    (which must identify rows); each group is one row's own token array."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c != tokens_col]
    # posexplode_outer keeps rows with no tokens (their null entry is not
    # collected), so no join back to the input is needed.
    rows = df.select(*keys, *rest, F.posexplode_outer(tokens_col).alias("_pos", "_word"))
    rows = encode_long(rows, vocab, "_word", "_wid", broadcast_bytes=broadcast_bytes)
    entry = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_wid"))
    ids = rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest],
                                  F.array_sort(F.collect_list(entry)).alias("_pairs"))
    return ids.select(*keys, *rest, F.transform("_pairs", lambda p: p["_wid"]).alias(out))


def decode_long(id_rows: DataFrame, vocab: DataFrame, id_col: str = "token_id",
                out: str = "token", skip_special: bool = True, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """T6 (long form): ids -> tokens; special ids dropped when asked. A
    vocabulary of any size, as in ``encode_long``."""
    res = _looked_up(id_rows, vocab, id_col, "id", "token", broadcast_bytes).withColumnRenamed("_found", out)
    return res.where(~F.coalesce(F.col(id_col).isin(*K.SPECIAL_TOKENS.values()), F.lit(False))) if skip_special else res
