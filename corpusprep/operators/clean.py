"""Projection, filtering and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import checkpoint
from .ordering import BROADCAST_BYTES, dense_index, running_sum

#: Bytes of an entry (two hashes, two counts) of C7's table.
LATER_BYTES = 192


def drop_empty(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose key string is null or empty (a plain predicate,
    pushed into the Parquet scan)."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))


def null_to_empty(df: DataFrame, col: str) -> DataFrame:
    """NULL text becomes ''."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("")))


def drop_missing(df: DataFrame, col: str) -> DataFrame:
    """Drop samples without the column value."""
    return df.where(F.col(col).isNotNull())


def ensure_id(df: DataFrame, content_cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """Keep ``id_col`` when present; otherwise ``sha256(content) + '#' +
    n`` where n numbers rows of equal content 1, 2, ..., in the order of
    their other columns, whatever the partitioning.

    Rows are counted by two hashes (content, whole row) and only the counts are
    ordered, by a running sum that splits a hot content over ranges. The first
    row of a content needs no entry there, so rows meet a table of the others
    only, broadcast if it fits; rows move only where they are copies in every
    column, which the skew-safe grouped index numbers."""
    if id_col in df.columns:
        return df
    content = F.concat_ws("\u001f", *[F.col(c).cast("string") for c in content_cols])
    hashed = df.withColumn("_h", F.sha2(content, 256)).withColumn("_all", F.xxhash64(*df.columns))
    keys = hashed.groupBy("_h", "_all").agg(F.count(F.lit(1)).alias("_c"))
    keys = running_sum(keys, ["_all"], F.col("_c"), group_by=["_h"], out="_base")
    later = checkpoint(keys.where("_base > 0 OR _c > 1"))
    if later.count() * LATER_BYTES <= BROADCAST_BYTES:
        later = F.broadcast(later)
    marked = hashed.join(later, ["_h", "_all"], "left")
    one = marked.where(F.coalesce("_c", F.lit(1)) == 1).withColumn("_n", F.coalesce("_base", F.lit(0)))
    # rows with the same content and the same other columns are the same row, so any of them may have any number
    more = dense_index(marked.where("_c > 1"), [F.monotonically_increasing_id()], group_by=["_h", "_all"], out="_i")
    d = one.unionByName(more.withColumn("_n", F.col("_base") + F.col("_i")).drop("_i"))
    return d.withColumn(id_col, F.concat(F.col("_h"), F.lit("#"), (F.col("_n") + 1).cast("string"))) \
            .select(id_col, *df.columns)


def thinking_prefix(text: Column, flag: Column, prefix: str = K.THINKING_PREFIX) -> Column:
    """Prepend the thinking instruction when flagged."""
    return F.when(flag, F.concat(F.lit(prefix), text)).otherwise(text)


def vq_to_tokens(codes: Column, offset: int = K.IMAGE_OFFSET) -> Column:
    """VQ code -> token id."""
    return F.transform(codes, lambda c: c + F.lit(offset))


REASONS = ("parse_error", "no_atoms", "too_many_atoms", "shape_mismatch", "ok")


def _triple(c: Column) -> Column:
    """Three coordinates, none NULL."""
    return F.coalesce((F.size(c) == 3) & F.forall(c, lambda x: x.isNotNull()), F.lit(False))


def validity(atom_vec: Column, coords: Column, max_atoms: int) -> Column:
    """C2 reason column for a parsed molecule: ``parse_error`` (NULL after
    parsing), ``no_atoms``, ``too_many_atoms``, ``shape_mismatch`` (not one
    xyz triple per atom) or ``ok``."""
    n = F.size(atom_vec)
    return (F.when(atom_vec.isNull() | coords.isNull(), F.lit("parse_error"))
            .when(n == 0, F.lit("no_atoms"))
            .when(n > F.lit(int(max_atoms)), F.lit("too_many_atoms"))
            .when((F.size(coords) != n) | ~F.forall(coords, _triple), F.lit("shape_mismatch"))
            .otherwise(F.lit("ok")))


def split_quarantine(df: DataFrame, reason_col: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows (the rejected keep their reason)."""
    return df.where(F.col(reason_col) == "ok"), df.where(F.col(reason_col) != "ok")


def reason_counts(df: DataFrame, reason_col: str = "reason") -> DataFrame:
    """C6 counters: processed/skipped per reason (a partial aggregate)."""
    return df.groupBy(reason_col).agg(F.count(F.lit(1)).alias("n"))
