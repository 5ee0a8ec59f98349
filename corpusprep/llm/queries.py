"""One query for each training-data operator, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, fingerprints, hyperminhash, language, manifest, mixing, passages, quality_rules, ranking, sharding, simhash, toxicity
from .common import n_words, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"))
    mixed = mixing.mix_sources(docs, F.col("size"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", "copies", "taken")


ORACLES["op1_mix_sources"] = mixing.ORACLE


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query
def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLES["op8_passages"] = passages.ORACLE


@query
def op9_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs)


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read(spark, sf_dir, "documents"), changed=manifest.tampered_text(), proofs=False)


ORACLES["op11_merkle"] = manifest.ORACLE


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(turns), turns.select("conv_id"))


@query
def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op13_hyperminhash"] = hyperminhash.ORACLE
