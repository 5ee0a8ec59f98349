"""A training corpus from raw documents, stage by stage.

Each stage is a function (spark, docs, sf_dir) over all that its predecessor
kept; its result is written before the next one reads it. Empty tables stay
empty, and columns of any name pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusprep.llm import bpe, mixing, passages, simhash, toxicity
from corpusprep.llm.common import n_words, read
from corpusprep.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts get the rate of such examples; equal texts share a
    decision, repeated rows all stay or all go; an id plays no part."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of its smallest id.

    Null ids come last; of rows that share the id that of the smallest text hash
    stays, of rows equal in both any one. Null, empty and wordless texts are one
    group (fingerprint zero)."""
    return simhash.representatives(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that stand in an earlier document go; every document stays.

    Null texts become empty ones, and so does a text that was nothing but a
    repeat; n_chars is counted anew. Very long texts are read whole."""
    return passages.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for it.

    A null source is one of its own, the last; documents without a word add
    nothing to a target; repeated rows are drawn each for itself."""
    return mixing.repeated(mixing.mix_sources(docs, n_words("text")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, and the bytes that they decode to.

    Null and empty texts have no ids; a row for each row, equal ids included."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_passages),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", tokenise),
]

#: SQL cannot express learning from labels, joining components or merging tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared
    checkpoint folder and read again, so that none is computed twice."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{at}")
            docs = spark.read.parquet(f"{folder}/{at}")
    return docs
