"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | Column) -> Column:
    """The words of a text in order (null text: empty array)."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, mod 4, is 2 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def least_hashes(rows: DataFrame, limit: int, key: str, *ties: str) -> DataFrame:
    """The ``limit`` rows whose keys have the least hashes. A cut at twice the
    share that is wanted goes first, so that no task sends many rows to the sort."""
    total = rows.count()
    if total > 4 * limit:
        rows = rows.where(F.xxhash64(key) <= F.lit(int(-2**63 + 2**64 * (2 * limit / total))))
    return rows.orderBy(F.xxhash64(key), key, *ties).limit(limit)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def null_last(name: str, fill) -> Column:
    """A struct that orders like the column, nulls after all values."""
    c = F.col(name)
    return F.struct(c.isNull().alias("n"), F.coalesce(c, F.lit(fill)).alias("v"))


def ids_as_text(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """The id for a trip through pandas, where a null among integers would turn all to floats."""
    return F.col(id_col).cast("string").alias("doc_id")


def ids_back(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


#: Rows that Python code turns into objects at once; whole Arrow batches would hold too many texts.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
