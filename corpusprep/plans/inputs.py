"""Stand-in inputs derived from the driver tables (Spark side + SQL side).

TEXT = documents, CHAT = conversations, LOGITS = embeddings (64 logits per
row, target = label), MOL = lineitem (molecule = order, atoms = its lines),
METRIC = events (series = event_type). Each derivation reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions import constants as K
from ..functions import text as T
from ..operators import tokens as TK
from ..operators.ordering import dense_index, top_k_per_group
from ..session import table
from . import sqlkit as Q

DOC_LEN = 512          # text truncation for document sequences
MAX_ATOMS = 32         # molecule gate and padding width for the MOL stand-in


# ---------------------------------------------------------------- TEXT ----
def doc_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """T3 over the whole texts of the corpus, plus the special tokens."""
    rows = explode_rows(doc_tokens(spark, sf), "doc_id", "_toks")
    return TK.with_specials(TK.build_vocab(rows))


def doc_token_rows(spark: SparkSession, sf: str, max_len: int | None = DOC_LEN) -> DataFrame:
    """(doc_id, pos, token, token_id): first ``max_len`` tokens of each text
    (None: all), ids from the vocabulary of the whole corpus."""
    rows = explode_rows(doc_tokens(spark, sf, max_len), "doc_id", "_toks")
    return TK.encode_long(rows, doc_vocab(spark, sf), "token", "token_id")


def explode_rows(df: DataFrame, key: str, arr: str, pos: str = "pos", out: str = "token") -> DataFrame:
    """``(key, pos, out)`` rows of an array column (see ``arrays.explode_rows``)."""
    return AR.explode_rows(df, [key], arr, pos=pos, out=out)


def doc_tokens(spark: SparkSession, sf: str, max_len: int | None = None, *,
               cluster_by_id: bool = False) -> DataFrame:
    """``(doc_id, _toks)``: the token array, computed once per document.
    ``cluster_by_id`` hash-partitions the documents by id first, so later
    per-document windows over their exploded tokens need no exchange."""
    toks = T.tokens(F.col("text"))
    if max_len is not None:
        toks = F.slice(toks, 1, max_len)
    docs = table(spark, sf, "documents")
    if cluster_by_id:
        # explicit count: the text is small next to the rows it explodes
        # into, and AQE must not coalesce it into a few tasks
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return docs.select("doc_id", toks.alias("_toks"))


def _explode_encode(spark, sf, docs: DataFrame, seq, vocab: DataFrame | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    keep = keep or {}
    rows = AR.explode_rows(docs.select("doc_id", *[c.alias(n) for n, c in keep.items()], seq.alias("_s")), ["doc_id", *keep], "_s", out="token")
    return TK.encode_long(rows, doc_vocab(spark, sf) if vocab is None else vocab, "token", "token_id")


def doc_lm_rows(spark: SparkSession, sf: str, seq_len: int, max_len: int = DOC_LEN, *,
                vocab: DataFrame | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """P6 sequences in long form ``(doc_id, pos, token, token_id)``, built on
    the token strings and encoded once: ``([bos] + tokens + [eos] + [eos]*)[:L]``
    with bos prepended unless already first. No regrouping shuffle. ``keep``:
    columns found once for each document that its rows have too."""
    docs = doc_tokens(spark, sf, max_len)
    toks = F.col("_toks")
    bos, eos = F.array(F.lit(K.BOS_TOKEN)), F.array(F.lit(K.EOS_TOKEN))
    t = F.when(F.size(toks) == 0, bos).when(F.get(toks, 0) != F.lit(K.BOS_TOKEN), F.concat(bos, toks)) \
         .otherwise(toks)
    t = F.concat(t, eos)
    seq = F.slice(F.concat(t, F.array_repeat(F.lit(K.EOS_TOKEN), F.greatest(F.lit(seq_len) - F.size(t), F.lit(0)))),
                  1, seq_len)
    return _explode_encode(spark, sf, docs, seq, vocab, keep)


def doc_padded_rows(spark: SparkSession, sf: str, seq_len: int = DOC_LEN) -> DataFrame:
    """Truncated token sequences right-padded with ``[iPAD]`` to ``seq_len``,
    long form (the pad token encodes to the pad id through the specials)."""
    docs = doc_tokens(spark, sf, seq_len)
    seq = F.concat("_toks", F.array_repeat(F.lit("[iPAD]"), F.lit(seq_len) - F.size("_toks")))
    return _explode_encode(spark, sf, docs, seq)


def doc_ids(spark: SparkSession, sf: str, max_len: int | None = DOC_LEN) -> DataFrame:
    """(doc_id, ids): dense id arrays (T5) of the texts. Documents are dealt by
    id before they are tokenised, so regrouping their ids needs no exchange."""
    docs = doc_tokens(spark, sf, max_len, cluster_by_id=True).withColumnRenamed("_toks", "tokens")
    return TK.encode(docs, doc_vocab(spark, sf), "doc_id").select("doc_id", "ids")


def DOC_SQL(max_len: int | None = DOC_LEN) -> str:
    """CTEs doc_tok, vocab, doc_rows(doc_id,pos,token_id), doc_arr(doc_id, ids)."""
    last = "len(toks)" if max_len is None else f"least(len(toks), {max_len})"
    return f"""
doc_tok AS MATERIALIZED (SELECT doc_id, {Q.tokens('text')} AS toks FROM documents),
vocab AS MATERIALIZED {Q.vocab_from('SELECT unnest(toks) AS token FROM doc_tok')},
doc_pos AS (SELECT doc_id, i AS pos, toks[i + 1] AS token
            FROM (SELECT doc_id, toks, unnest(range({last})) AS i FROM doc_tok) x),
doc_rows AS MATERIALIZED (SELECT d.doc_id, d.pos, d.token, coalesce(v.id, {K.UNK_ID}) AS token_id
             FROM doc_pos d LEFT JOIN vocab v ON d.token = v.token),
doc_arr AS (SELECT t.doc_id, coalesce(a.ids, CAST([] AS INTEGER[])) AS ids FROM doc_tok t LEFT JOIN
            (SELECT doc_id, list(token_id ORDER BY pos) AS ids FROM doc_rows GROUP BY doc_id) a
            ON t.doc_id = a.doc_id)"""


# -------------------------------------------------------------- IMAGES ----
def image_ids_col(emb_col: str = "embedding"):
    """C9 stand-in: a VQ code from every value of the embedding, shifted by the offset."""
    return F.transform(F.col(emb_col),
                       lambda x: F.lit(K.IMAGE_OFFSET) + F.least(F.greatest(
                           F.floor((x.cast("double") + 1.0) * 4096.0).cast("int"), F.lit(0)), F.lit(8191)))


IMAGE_SQL = (f"list_transform(embedding, lambda x: {K.IMAGE_OFFSET} + "
             f"least(greatest(CAST(floor((CAST(x AS DOUBLE) + 1.0) * 4096.0) AS INTEGER), 0), 8191))")


def images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", image_ids_col().alias("image"))


# -------------------------------------------------------------- LOGITS ----
def logits(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, logits array<double>)."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


LOGITS_SQL = "logits AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS logits FROM embeddings)"


# ----------------------------------------------------------------- MOL ----
_ATOM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def mol_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The atoms as they come, one row each, without an index."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("mol"), *_ATOM_ORDER, F.col("l_returnflag").alias("symbol"),
        F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))


def mol_atoms_all(spark: SparkSession, sf: str) -> DataFrame:
    """Long atom table (mol, atom_idx, symbol, x, y, z) of every molecule,
    whatever its size: the index within a molecule is the skew-safe one."""
    atoms = dense_index(mol_lines(spark, sf), _ATOM_ORDER, group_by=["mol"], out="_i")
    return atoms.select("mol", F.col("_i").cast("int").alias("atom_idx"), "symbol", "x", "y", "z")


def mol_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """The same for forms that need whole molecules in a row: those of at most
    MAX_ATOMS atoms. ``mol_rejects`` has the others."""
    return atom_index(mol_lines(spark, sf), MAX_ATOMS)


def mol_rejects(spark: SparkSession, sf: str, max_atoms: int = MAX_ATOMS) -> DataFrame:
    """(mol, n): molecules over the gate, from a partial count."""
    return mol_lines(spark, sf).groupBy("mol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_atoms)


def atom_index(li: DataFrame, max_atoms: int) -> DataFrame:
    """Atom index per molecule and the size gate in one shuffle: keep the
    first ``max_atoms + 1`` atoms of every molecule (map-side partial limit,
    so a huge molecule is cut before the exchange), then a molecule is
    left out when it still has more than ``max_atoms`` (count over the same
    partitioning, at most ``max_atoms + 1`` rows)."""
    first = top_k_per_group(li, ["mol"], _ATOM_ORDER, max_atoms + 1, rank_col="_rn")
    n = F.count(F.lit(1)).over(Window.partitionBy("mol"))
    return (first.withColumn("_n", n).where(F.col("_n") <= max_atoms)
            .select("mol", (F.col("_rn") - 1).cast("int").alias("atom_idx"), "symbol", "x", "y", "z"))


MOL_ALL_SQL = """
mol_raw AS (SELECT l_orderkey AS mol, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
            l_returnflag AS symbol, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem),
atoms AS (SELECT mol, CAST(row_number() OVER (PARTITION BY mol ORDER BY l_linenumber, l_partkey,
          l_suppkey, l_extendedprice) - 1 AS INTEGER) AS atom_idx, symbol, x, y, z FROM mol_raw)"""


def MOL_SQL_UP_TO(max_atoms: int) -> str:
    """The same, molecules of at most ``max_atoms`` atoms; mol_large has the others."""
    return MOL_ALL_SQL.replace("FROM mol_raw)", "FROM mol_raw WHERE mol IN (SELECT mol FROM mol_ok))").replace(
        "atoms AS (", f"""mol_ok AS (SELECT mol FROM mol_raw GROUP BY mol HAVING count(*) <= {max_atoms}),
mol_large AS (SELECT mol, count(*) AS n FROM mol_raw GROUP BY mol HAVING count(*) > {max_atoms}),
atoms AS (""")


MOL_SQL = MOL_SQL_UP_TO(MAX_ATOMS)


# -------------------------------------------------------------- METRIC ----
def metric_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("series"), "ts", "event_id", "user_id", "value")
