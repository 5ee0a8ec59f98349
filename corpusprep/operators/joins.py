"""Joins that are operators of their own (J7) plus the orphan report.

Both sides are large and keyed by the sample key, so these are plain
equi-joins: Catalyst picks a sort-merge join and AQE splits a skewed key's
partition (``spark.sql.adaptive.skewJoin.enabled``); nothing is broadcast
without a size bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_captions(samples: DataFrame, captions: DataFrame, key: str) -> DataFrame:
    """Samples joined with their external caption/label rows."""
    return samples.join(captions, key, "inner")


MAX_QUESTIONS = 1024


def ask_questions(samples: DataFrame, questions: list[str], *, most: int = MAX_QUESTIONS) -> DataFrame:
    """Every configured question for every sample, ``(…, q_idx,
    question)``. The questions are a job parameter (a short list, at
    most ``most`` of them), not a table: each sample row is repeated by
    a generator, so the output grows linearly with the samples and no join
    is planned."""
    if not questions:
        raise ValueError("no questions")
    if len(questions) > most:
        raise ValueError(f"{len(questions)} questions, at most {most}: join a question table by key instead")
    qs = F.array(*[F.struct(F.lit(i).alias("q_idx"), F.lit(q).alias("question")) for i, q in enumerate(questions)])
    return samples.withColumn("_q", F.explode(qs)).select("*", "_q.q_idx", "_q.question").drop("_q")


def answers_by_sample(answers: DataFrame, key: str, *, order: str = "q_idx", answer: str = "answer") -> DataFrame:
    """A sample's answers in the order of the questions; samples without
    one are left out. A row gathers as many answers as questions were asked."""
    return (answers.where(F.col(answer).isNotNull()).groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(order, answer))).alias("_a"))
            .select(key, F.transform("_a", lambda a: a[answer]).alias("answers")))


def orphans(samples: DataFrame, captions: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only: ``(side, key)`` with side 'sample'
    (no caption) or 'caption' (no sample). Two anti joins."""
    s = samples.select(key).join(captions.select(key), key, "left_anti").select(F.lit("sample").alias("side"), key)
    c = captions.select(key).join(samples.select(key), key, "left_anti").select(F.lit("caption").alias("side"), key)
    return s.unionByName(c)
