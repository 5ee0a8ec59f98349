"""Every stage of the pipeline on its own input, against the operators' plain forms."""

from collections import Counter

import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corpusprep.llm import bpe, toxicity

from .test_operators import plain_components, plain_fingerprint, plain_passages


def test_stages(spark, smoke_dir, tmp_path):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    columns, inputs = docs.columns, []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        stage(spark, docs, smoke_dir).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        if at < 4:
            assert docs.columns == columns
    start, clean, single, cut, mixed = ([(r.doc_id, r.text) for r in x.collect()] for x in inputs)
    labels = spark.read.parquet(f"{smoke_dir}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.scores(inputs[0], labels).where("predicted = 1").collect()}
    assert Counter(clean) == Counter(r for r in start if r[0] not in toxic)
    heads = plain_components({i: plain_fingerprint(t) for i, t in clean}, 2)
    assert Counter(single) == Counter(r for r in clean if heads[r[0]] == r[0])
    removed = {i: n for i, _, n, _, _ in plain_passages(single)}
    assert {i: len(t.encode()) for i, t in cut}.keys() == removed.keys()
    whole = dict(single)
    for i, t in cut:
        lost = len(whole[i].encode()) - len(t.encode())
        assert removed[i] <= lost <= removed[i] + 200  # parts of characters go too
    assert all(r.n_chars == len(r.text) for r in inputs[3].collect())
    assert set(mixed) <= set(cut) and max(Counter(mixed).values()) <= 2
    library = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS_FILE), special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in docs.collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in mixed)


def test_run_is_registered(spark, smoke_dir):
    out = entry.queries()["pipeline"](spark, smoke_dir)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.where(F.col("ids").isNull()).count() == 0
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()}


def test_stages_on_odd_rows(spark, smoke_dir, edge, empty):
    """Nulls, empty and long texts, repeated rows, null and repeated ids, clashing names, and no rows at all."""
    odd, none = (d.withColumn("n_chars", F.length("text")) for d in (edge, empty))
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none, smoke_dir).count() == 0, name
        out = stage(spark, odd, smoke_dir)
        rows = out.collect()
        if at < 4:
            assert out.columns == odd.columns, name
        asked, got = (Counter(r.doc_id for r in x) for x in (odd.collect(), rows))
        if at == 0:
            assert got == asked  # no label in reach: nothing is rejected
        elif at == 1:
            assert got.keys() <= asked.keys() and all(n <= asked[i] for i, n in got.items()) and sum(got.values()) < sum(asked.values())
            assert len({r.text for r in rows if r.text and r.text.startswith("one two")}) == 1
        elif at == 2:
            assert got == asked and sum(r.text is None for r in rows) <= 2
        elif at == 3:
            assert all(n <= 2 * asked[i] for i, n in got.items())
        else:
            assert got == asked and Counter(bytes(r.decoded) for r in rows) == Counter((r.text or "").encode() for r in odd.collect())
