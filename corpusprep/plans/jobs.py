"""End-to-end jobs: the molecule convert job (E1/M9), the molecule training
feed (E2) and the chat training feed (E3).

Each job is a plan of library operators; writing is the caller's choice
(``out`` path) and counters come from aggregates, never from a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batching as B
from ..operators import clean as C
from ..operators import molecules as M
from ..sources.shards import write_records


def _matrix(n, bonds, value):
    """N x N matrix of ``value(bond)`` from an array of directed bonds (i, j,
    bond_type): each row looks only at its own bonds."""
    def row(i):
        own = F.filter(bonds, lambda b: b["i"] == i)
        return F.transform(F.array(own), lambda mine: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(
            F.get(F.transform(F.filter(mine, lambda b: b["j"] == j), value), 0), F.lit(0))))[0]
    return F.transform(F.sequence(F.lit(0), n - 1), row)


def convert_molecules(atoms: DataFrame, bonds: DataFrame | None = None, *, descriptions: DataFrame | None = None,
                      max_atoms: int = 256, out: str | None = None) -> tuple:
    """M9: atom (and bond) tables -> gated molecule records with JSON fields.

    ``atoms``: ``(mol, atom_idx, symbol, x, y, z)``, where ``atom_idx`` may be
    of any type that orders a molecule's atoms; ``bonds``: ``(mol, i, j,
    bond)`` by position, or consecutive-atom bonds when absent;
    ``descriptions``: ``(mol, text_description)``, missing ones are empty.

    Molecules over ``max_atoms`` are counted, never gathered: of each at most
    ``max_atoms + 1`` atoms meet in a task. Atom numbers, SELFIES, coordinates,
    matrices of consecutive bonds and distances all come from one grouping.
    Returns ``(records, reason_counts, written)``; with ``out`` the records are
    written as Parquet and ``written`` is the ``Observation`` whose count comes
    from that write (else None)."""
    from ..operators.ordering import top_k_per_group
    capped = top_k_per_group(atoms, ["mol"], ["atom_idx"], max_atoms + 1)
    entry = F.struct("atom_idx", "symbol", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    grouped = capped.groupBy("mol").agg(F.array_sort(F.collect_list(entry)).alias("_a"))
    gated = grouped.select("mol", "_a", F.when(F.size("_a") > max_atoms, "too_many_atoms").otherwise("ok").alias("reason"))
    rec = gated.where(F.col("reason") == "ok").withColumn("n", F.size("_a"))
    if bonds is None:
        names = F.array(*[F.lit(x) for x in ("SINGLE", "DOUBLE", "TRIPLE", "AROMATIC", "DATIVE")])
        code = lambda i: M.bond_code(F.get(names, F.pmod(i, F.lit(5))))
        pair = lambda i, j, t: F.struct(i.alias("i"), j.alias("j"), t.alias("bond_type"))
        chain = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 2),
                                      lambda i: F.array(pair(i, i + 1, code(i)), pair(i + 1, i, code(i)))))
        rec = rec.withColumn("_b", F.when(F.col("n") > 1, chain).otherwise(F.array().cast("array<struct<i:int,j:int,bond_type:int>>")))
    else:
        mine = M.bond_edges(bonds).groupBy("mol").agg(F.collect_list(F.struct("i", "j", "bond_type")).alias("_b"))
        rec = rec.join(mine, "mol", "left").withColumn("_b", F.coalesce("_b", F.array().cast("array<struct<i:int,j:int,bond_type:int>>")))
    if descriptions is not None:
        rec = rec.join(descriptions.select("mol", "text_description"), "mol", "left")
    text = F.coalesce(F.col("text_description"), F.lit("")) if descriptions is not None else F.lit("")
    rec = rec.withColumn("coords", F.transform("_a", lambda a: F.array(a["x"], a["y"], a["z"])))
    records = rec.select(
        F.col("mol").cast("string").alias("id"),
        F.array_join(F.transform("_a", lambda a: F.concat(F.lit("["), a["symbol"], F.lit("]"))), "").alias("selfies_string"),
        text.alias("text_description"),
        F.to_json(F.transform("_a", lambda a: M._number_of(a["symbol"]))).alias("atom_vec_str"),
        F.to_json("coords").alias("coordinates_str"),
        F.to_json(_matrix(F.col("n"), F.col("_b"), lambda b: F.lit(1))).alias("edge_type_str"),
        F.to_json(_matrix(F.col("n"), F.col("_b"), lambda b: b["bond_type"])).alias("bond_type_str"),
        F.to_json(M.distance_matrix(F.col("coords"))).alias("dist_str"),
        F.lit("[]").alias("rdmol2selfies_str"))
    written = None
    if out:
        from pyspark.sql import Observation
        written = Observation("converted")   # .get -> {"written": n}, counted by the write itself
        write_records(records, out, mode="overwrite", observation=written)
    return records, C.reason_counts(gated), written


def molecule_training_feed(records: DataFrame, vocab: DataFrame, *, max_atoms: int = 256,
                           max_selfies_len: int = 256, max_text_len: int = 256, with_matrices: bool = False,
                           timesteps: int = 1000, schedule: str = "cosine",
                           batch_size: int = 2, seed: int = 0, rng: str = "fast") -> DataFrame:
    """Converted molecule records -> one training row per molecule.

    C1 (SELFIES present) -> M2 parse + C2 gate -> T2 SELFIES and T1 text
    tokens, T5 ids and the N2 timestep mask in long form (broadcast vocabulary
    and schedule) -> regrouped per molecule (bounded by ``max_selfies_len +
    max_text_len``) -> M7 padding -> I1 shuffle -> B4 batch. Atom numbers and
    matrices (``with_matrices``: edge, bond and distance N x N, the SELFIES map
    N x L, padded or cropped) are row-local. Records are dealt by id before their
    tokens are exploded: the regroup and the join to the features keep that
    dealing, token rows never move, and the shuffle index orders ids only.
    ``records`` are read three times: hand over what was written, not a plan.
    """
    from ..functions import arrays as AR
    from ..functions import text as T
    from ..operators import masking as N
    from ..operators import tokens as TK

    recs = C.drop_empty(records, "selfies_string")
    parsed = M.parse_record(recs, with_matrices=with_matrices).withColumn("reason", C.validity(F.col("atom_vec"), F.col("coordinates"),
                                                                  max_atoms))
    ok = parsed.where(F.col("reason") == "ok").select(
        F.col("id"), "selfies_string", "text_description", "atom_vec", "coordinates",
        *(["edge_type", "bond_type", "dist", "rdmol2selfies"] if with_matrices else []))
    named = lambda toks, sel: F.transform(toks, lambda t: F.struct(F.lit(sel).alias("sel"), t.alias("token")))
    both = F.concat(named(F.slice(T.selfies_tokens(F.col("selfies_string")), 1, max_selfies_len), True),
                    named(F.slice(T.tokens(F.coalesce(F.col("text_description"), F.lit(""))), 1, max_text_len), False))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ok.select("id", "selfies_string", "text_description").repartition(parts, "id").select("id", both.alias("_t"))
    rows = AR.explode_rows(dealt, ["id"], "_t", out="_e").select("id", "pos", "_e.sel", "_e.token")
    rows = TK.encode_long(rows, vocab, "token", "token_id")
    masked = N.timestep_mask(rows, "id", timesteps=timesteps, schedule=schedule, seed=seed, rng=rng)
    seqs = masked.groupBy("id").agg(
        F.first("t").alias("timestep"),
        F.array_sort(F.collect_list(F.struct("pos", "sel", "input_id", "label", "token_id"))).alias("_all"))
    seqs = seqs.withColumn("_s", F.filter("_all", lambda s: s["sel"])).withColumn("_w", F.filter("_all", lambda s: ~s["sel"]))
    seqs = seqs.select("id", "timestep",
                       F.transform("_w", lambda s: s["token_id"]).alias("text_input_ids"),
                       F.array_repeat(F.lit(1), F.size("_w")).alias("text_attention_mask"),
                       F.transform("_s", lambda s: s["input_id"]).alias("selfies_input_ids"),
                       F.transform("_s", lambda s: s["label"]).alias("true_selfies_labels"),
                       F.array_repeat(F.lit(1), F.size("_s")).alias("selfies_attention_mask"))
    feats = ok.drop("selfies_string", "text_description").repartition(parts, "id").withColumn("atom_ids", F.transform("atom_vec", M._number_of))
    ids, xyz, mask = M.pad_atoms(F.col("atom_ids"), F.col("coordinates"), max_atoms)
    square = [M.fit_matrix(F.col(c), max_atoms, max_atoms).alias(c) for c in ("edge_type", "bond_type", "dist")]
    wide = [M.fit_matrix(F.col("rdmol2selfies"), max_atoms, max_selfies_len).alias("rdmol2selfies")]
    feats = feats.select("id", ids.alias("atom_vec"), xyz.alias("coordinates"), mask.alias("atoms_mask"),
                         *(square + wide if with_matrices else []))
    samples = seqs.join(feats, "id")
    order = B.batch_id(B.shuffle(ok.where(F.size(both) > 0).select("id"), "id", seed=seed, rng=rng), batch_size)
    return samples.join(order.select("id", "idx", "batch_id"), "id")


def chat_training_feed(conv: DataFrame, *, max_seq_len: int = 512, batch_size: int = 8,
                       rng: str = "fast", out: str | None = None) -> DataFrame:
    """Masked chat rows (flagship) with a shuffled batch id per
    conversation; one row per position, clustered by batch when written."""
    from .chat_feed import chat_feed
    feed = chat_feed(conv, max_seq_len=max_seq_len, rng=rng)
    order = B.batch_id(B.shuffle(conv.select("conv_id").distinct(), "conv_id", rng=rng), batch_size)
    res = feed.join(order.select("conv_id", "batch_id"), "conv_id")
    if out:
        (res.repartition("batch_id").sortWithinPartitions("batch_id", "conv_id", "pos")
         .write.mode("overwrite").parquet(out))
    return res


__all__ = ["convert_molecules", "molecule_training_feed", "chat_training_feed"]
