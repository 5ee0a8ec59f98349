"""Sources, sinks and sums on inputs that are large, cut in odd places, damaged or out of order."""

import hashlib
import io
import json
import math
import os
import random
import tarfile
from fractions import Fraction
from unittest import mock

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusprep.functions import constants as K
from corpusprep.operators import exact, metrics, tokens
from corpusprep.operators.ordering import running_sum
from corpusprep.sources import blocks, files, shards, tar
from corpusprep.streaming import feeds, sinks

# ------------------------------------------------------------- exact sums


def test_exact_sums_any_partitioning(spark):
    rng = random.Random(1)
    values = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(2000)] + [1e300, -1e300, 5e-324, 0.0, -0.0]
    values += [9e19] * 500 + [1.23456789012e-6] * 500
    rows = [("all", v) for v in values] + [("cancel", 1e300), ("cancel", 3.0), ("cancel", -1e300), ("small", 1e-300), ("small", 2e-300),
                                           ("nan", 1.0), ("nan", math.nan), ("inf", math.inf), ("inf", 5.0), ("both", math.inf), ("both", -math.inf),
                                           ("none", None), ("some", None), ("some", 2.5), ("zero", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = [{r.g: r["sum"] for r in exact.exact_sums(df.repartition(n), ["g"], F.col("v")).collect()} for n in (1, 3, 8)]
    assert [repr(x) for x in got[1:]] == [repr(dict(got[i])) for i in (1, 2)]
    assert all(sorted(map(repr, x.items())) == sorted(map(repr, got[0].items())) for x in got)
    one = got[0]
    true = float(sum(map(Fraction, values)))
    assert one["all"] == pytest.approx(true, rel=1e-15) and one["cancel"] == 3.0 and one["small"] == pytest.approx(3e-300, rel=1e-15)
    assert math.isnan(one["nan"]) and one["inf"] == math.inf and math.isnan(one["both"])
    assert one["none"] is None and one["some"] == 2.5 and one["zero"] == 0.0


def test_meter_does_not_overflow(spark):
    df = spark.range(300_000).select(F.lit("a").alias("g"), F.lit(9e19).alias("v"), F.col("id").alias("step"))
    r = metrics.meter(df, ["g"], "v", None, "step").first()
    assert r["sum"] == 9e19 * 300_000 and r["count"] == 300_000 and r["last"] == 9e19


def test_scan_has_no_python(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.random(), rng.random()) for s, n in (("a", 700), ("b", 1), ("c", 130)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i long, a double, b double")
    out = metrics.affine_scan(df, "s", "i", "a", "b", chunk=8)
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
    got, want, x = {(r.s, r.i): r._in for r in out.collect()}, {}, {}
    for s, i, a, b in rows:
        want[s, i] = x.get(s, 0.0)
        x[s] = a * x.get(s, 0.0) + b
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


# ------------------------------------------------------- vocabulary lookup


def test_vocabulary_beyond_a_broadcast(spark):
    words = [f"w{i}" for i in range(400)]
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [(t, i) for t, i in K.SPECIAL_TOKENS.items()], "token string, id int")
    rng = random.Random(5)
    marker = next(iter(K.SPECIAL_TOKENS))
    rows = [(i, rng.choice(words[:20] * 20 + words + ["unheard", None, marker])) for i in range(3000)]
    df = spark.createDataFrame(rows, "pos long, token string").repartition(5)
    plans, results = [], []
    for limit in (tokens.BROADCAST_BYTES, 3_000, 0):
        out = tokens.encode_long(df, vocab, broadcast_bytes=limit)
        plans.append(out._jdf.queryExecution().toString())
        results.append(sorted(map(tuple, out.select("pos", F.coalesce("token", F.lit("")), "token_id").collect())))
        back = tokens.decode_long(out.select("pos", "token_id"), vocab, out="word", skip_special=False, broadcast_bytes=limit)
        assert {r.pos: r.word for r in back.where(F.col("token_id") < 400).collect()} == {p: t for p, t in rows if t in set(words)}
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    assert tokens.broadcast_share(vocab, 3_000)[0] < 400 and tokens.broadcast_share(vocab, tokens.BROADCAST_BYTES)[0] is None
    dense = [sorted(map(str, tokens.encode(df.groupBy((F.col("pos") % 9).alias("k")).agg(F.array_sort(F.collect_list("token")).alias("tokens")), vocab, "k",
                                           broadcast_bytes=n).collect())) for n in (tokens.BROADCAST_BYTES, 3_000)]
    assert dense[0] == dense[1]


# ------------------------------------------------------------- CSV and JSON


CSV_SCHEMA = files.RAW_MOLECULE_SCHEMA


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_blocks_equal_the_whole_file_reader(spark, tmp_path, newline):
    rng = random.Random(7)
    pieces = ["a", "b,c", 'say ""hi""', "line\nbreak", "\n\n", "ä\U0001F600", '""', "long " * 40, ""]
    text = "cid,smiles,Description" + newline
    for i in range(400):
        text += f'{i},[C],"{"".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))}"' + newline
        if rng.random() < 0.1:
            text += f"{i},plain,{rng.choice(['x', '', 'y z'])}" + newline
    text += "last,row,without end"
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_bytes(b"cid,smiles,Description\n1,2,3\n")
    (tmp_path / "c.csv").write_bytes(b"")
    want = sorted(map(str, files.read_raw_csv(spark, str(tmp_path)).collect()))
    for size in (64, 1000, 1 << 20):
        got = files.read_csv_blocks(spark, str(tmp_path / "*.csv"), block_bytes=size)
        assert sorted(map(str, got.collect())) == want, size


def test_csv_records_belong_to_one_block(tmp_path):
    text = b'h\n"a\n\n""b",1\n\nc\n"' + b"x\n" * 50 + b'"\nend'
    path = tmp_path / "x.csv"
    path.write_bytes(text)
    whole = [x for x in blocks.csv_records_of(f"file:{path}", 0, len(text), 0, len(text))]
    for size in range(1, len(text) + 1):
        got = []
        for at in range(0, len(text), size):
            inside = text[:at].count(b'"') % 2
            got += blocks.csv_records_of(f"file:{path}", at, min(at + size, len(text)), inside, len(text))
        assert got == whole, size


def test_json_array_blocks(spark, tmp_path):
    rng = random.Random(2)
    odd = ["[", "]", "{", "}", ",", '"', "\\", "\\\\", '\\"', "\n", "ä", "\U0001F600", "a" * 30]
    items = [{"file_name": f"f{i}", "messages": [{"role": rng.choice(odd), "content": "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))}
                                                 for _ in range(rng.randint(0, 3))]} for i in range(120)]
    for n, (indent, ascii_) in enumerate([(None, True), (2, False)]):
        (tmp_path / f"{n}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=ascii_))
    (tmp_path / "none.json").write_text(" [ ] ")
    want = sorted(str((f"f{i}", t, m["role"], m["content"])) for i, x in enumerate(items) for t, m in enumerate(x["messages"]))
    for size in (7, 64, 1 << 20):
        turns, bad = files.read_chat_array(spark, str(tmp_path / "*.json"), block_bytes=size)
        assert sorted(str(tuple(r)) for r in turns.collect()) == sorted(want * 2), size
        assert bad.count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('[{"file_name": "a", "messages": []}, {"file_name": oops}, {"file_name": "b", "messages": [{"role": "u", "content": "c"}]}]')
    turns, bad = files.read_chat_array(spark, str(tmp_path / "bad" / "*.json"), block_bytes=16)
    assert [tuple(r) for r in turns.collect()] == [("b", 0, "u", "c")] and bad.count() == 1


def test_json_scan_in_any_pieces():
    rng = random.Random(4)
    text = json.dumps([{"a\\\"": ["x]\\", {"b": "}"}]}, "\\\\", '"', [1, [2]]] * 20).encode()
    whole = blocks.json_scan(text, blocks.OUT)
    for _ in range(200):
        state, change, outside = blocks.OUT, [], []
        at = 0
        while at < len(text):
            end = min(len(text), at + rng.randint(1, 9))
            c, o, state = blocks.json_scan(text[at:end], state)
            change += c.tolist()
            outside += o.tolist()
            at = end
        assert change == whole[0].tolist() and outside == whole[1].tolist() and state == whole[2] == blocks.OUT


# ------------------------------------------------------------------- shards


def test_quarantine(spark, tmp_path):
    d = spark.range(1000).select("id", F.md5(F.col("id").cast("string")).alias("x"))
    path = str(tmp_path / "t")
    d.repartition(4).write.parquet(path)
    names = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    cut, flipped = (os.path.join(path, n) for n in names[:2])
    lost = [set(r.id for r in spark.read.parquet(f).collect()) for f in (cut, flipped)]
    data = open(cut, "rb").read()
    open(cut, "wb").write(data[:len(data) // 2])
    data = bytearray(open(flipped, "rb").read())
    data[20:400] = bytes(380)
    open(flipped, "wb").write(bytes(data))
    open(os.path.join(path, "part-empty.parquet"), "wb").close()
    for f in os.listdir(path):
        if f.endswith(".crc"):
            os.remove(os.path.join(path, f))
    rows, rejects = shards.quarantine(spark, path, pages=True)
    assert {os.path.basename(r.file) for r in rejects.collect()} == {names[0], names[1], "part-empty.parquet"}
    assert {r.id for r in rows.collect()} == set(range(1000)) - lost[0] - lost[1]
    footers = {os.path.basename(r.file) for r in shards.quarantine(spark, path)[1].collect()}
    assert footers == {names[0], "part-empty.parquet"}
    none, rejects = shards.quarantine(spark, cut, schema="id long")
    assert none.count() == 0 and rejects.count() == 1


def test_sized_files(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "x" * rng.choice([0, 5, 80, 900]) if i % 50 else "y" * 4000) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    target = 40_000
    planned = {r.file: r for r in shards.write_sized(df, str(tmp_path / "out"), ["id"], target_bytes=target, size=F.octet_length("text")).collect()}
    written = [f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]
    assert len(written) == len(planned) == -(-sum(len(t) for _, t in rows) // target)
    last = max(planned)
    assert all(abs(r.bytes - target) <= 0.1 * target for f, r in planned.items() if f != last)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == rows
    spans = sorted((r[0], r[1]) for r in back.groupBy(F.input_file_name()).agg(F.min("id"), F.max("id")).select("min(id)", "max(id)").collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_running_sum(spark):
    rows = [("a" if i % 3 else "b", i, (i * 7) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(6)
    got = {r.i: r.before for r in running_sum(df, ["i"], F.col("n"), group_by=["g"]).collect()}
    total: dict = {}
    for g, i, n in rows:
        assert got[i] == total.get(g, 0)
        total[g] = total.get(g, 0) + n
    whole, so_far = {r.i: r.before for r in running_sum(df, ["i"], F.col("n")).collect()}, 0
    for _, i, n in rows:
        assert whole[i] == so_far
        so_far += n


def test_report_parts(spark, tmp_path):
    rows = [("hot" if i % 3 else f"g{i % 4}", i, f"<p>{i}{'z' * (i % 90)}</p>") for i in range(900)]
    df = spark.createDataFrame(rows, "grp string, n long, fragment string").repartition(5)
    files.write_report_parts(df, str(tmp_path / "r"), "grp", "n", part_bytes=2_000)
    parts = files.read_report_parts(spark, str(tmp_path / "r"), "grp").collect()
    manifest = {r.grp: r for r in spark.read.parquet(str(tmp_path / "r" / "manifest")).collect()}
    for g in {r[0] for r in rows}:
        mine = [p for p in parts if p.grp == g]
        text = "".join(f for x, _, f in rows if x == g)
        assert "".join(p.report for p in mine) == text and all(len(p.report) < 2_200 for p in mine)
        assert (manifest[g].parts, manifest[g].bytes, manifest[g].n) == (len(mine), len(text), sum(x == g for x, _, _ in rows))


# ---------------------------------------------------------------------- tar


def _tar(path, members, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_ranged_tar(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    members = [(f"{'d' * 120 if i // 3 % 3 == 0 else 'dir'}/k{i // 3}.{s}", rng.randbytes(rng.choice([0, 10, 3000]))) for i, s in
               enumerate(["jpg", "TXT", "json"] * 40)]
    _tar(tmp_path / "a.tar", members)
    _tar(tmp_path / "b.tar.gz", members[:30], "w:gz")
    _tar(tmp_path / "cut.tar", members)
    whole = (tmp_path / "cut.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[:len(whole) // 2])
    monkeypatch.setattr(tar, "STRETCH_BYTES", 4096)
    got = tar.read_members(spark, [str(tmp_path / n) for n in ("a.tar", "b.tar.gz")]).collect()
    for name, want in (("a.tar", members), ("b.tar.gz", members[:30])):
        mine = sorted((r.idx, r.fname, bytes(r.data)) for r in got if r.url.endswith(name))
        assert mine == [(i, n, d) for i, (n, d) in enumerate(want)]
    index = tar.index_members(spark, str(tmp_path / "a.tar"))
    assert all(whole[r.offset:r.offset + r.size] == members[r.idx][1] for r in index.collect())
    assert index.repartition(8, F.floor(F.col("offset") / 4096)).where("NOT damaged").count() == len(members)
    samples = tar.read_tar_samples(spark, str(tmp_path / "a.tar")).orderBy("sample_no").collect()
    assert [(r.key, r.suffixes) for r in samples] == [(members[3 * i][0].rsplit(".", 1)[0], ["jpg", "txt", "json"]) for i in range(40)]
    assert all(bytes(r.data[s]) == members[3 * i + k][1] for i, r in enumerate(samples) for k, s in enumerate(["jpg", "txt", "json"]))
    damaged = tar.index_members(spark, str(tmp_path / "cut.tar")).collect()
    assert [r.damaged for r in damaged].count(True) == 1 and damaged[-1].damaged and 0 < len(damaged) < len(members)


# ---------------------------------------------------------------- streaming


def test_batch_that_fails_half_way(spark, smoke_dir, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{smoke_dir}/documents.parquet").repartition(3).write.parquet(src)
    stream = lambda: feeds.read_shard_stream(spark, src, feeds.DOCUMENT_SCHEMA, max_bytes_per_trigger=1)
    calls = []

    def failing(step, batch):
        def hook(batch_id, at):
            calls.append((batch_id, at))
            if (batch_id, at) == (batch, step):
                raise RuntimeError("planned")
        return hook

    sink, out, ckpt = sinks.CommittedBatches(str(tmp_path / "out")), str(tmp_path / "out"), str(tmp_path / "ckpt")
    for hook in (failing("rows", 0), failing("commit", 1), None):
        q = sinks.start_committed(stream(), out, ckpt, hook=hook)
        if hook:
            with pytest.raises(StreamingQueryException):
                q.awaitTermination()
        else:
            q.awaitTermination()
    ids = [r.doc_id for r in sink.read(spark, "rows").collect()]
    want = [r.doc_id for r in spark.read.parquet(src).collect()]
    assert sorted(ids) == sorted(want) and sink.records(spark).count() == 3
    # rows without a record do not count
    spark.range(5).select(F.col("id").alias("doc_id")).write.parquet(f"{out}/rows/batch_id=99")
    assert sink.read(spark, "rows").count() == len(want)
    assert not sink.write(spark, 0, {"rows": spark.range(3)}) and sink.read(spark, "rows").count() == len(want)


def test_meters_are_complete_in_any_order(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", 0, "ab"[i % 2], v, "{}") for i, (h, m, v) in enumerate(
        [(23, 59, 1.5), (0, 1, 3.0), (0, 2, math.nan), (5, 0, 1e19), (5, 1, -1e19), (5, 2, 0.25), (12, 0, None), (0, 0, 2.0), (23, 58, 7.0), (0, 3, 4.0)])]
    df = spark.createDataFrame(rows, "event_id long, s string, user_id long, event_type string, value double, props string") \
        .select("event_id", F.col("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for i, *_ in rows:  # one row a shard, written newest first and oldest last in turn
        df.where(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(src)
    feeds.start_windowed_meters(spark, src, out, ckpt, max_bytes_per_trigger=1).awaitTermination()
    meters, key = sinks.WindowedMeters(out), lambda r: (r.series, r.window_start)
    current = sorted(meters.current(spark).collect(), key=key)
    assert list(map(str, current)) == list(map(str, sorted(feeds.windowed_meters(df).collect(), key=key)))
    assert sum(r.n for r in current) == len(rows) and any(r["sum"] is not None and math.isnan(r["sum"]) for r in current)
    assert 0 < meters.closed(spark).count() < len(current)
    assert meters.late(spark).count() > 0
    meters.finish(spark)
    assert list(map(str, sorted(meters.closed(spark).collect(), key=key))) == list(map(str, current))
    assert sinks.compact(meters.sink, spark).count() <= meters.sink.read(spark, "parts").count()


def test_ensure_id_splits_a_hot_content(spark):
    """One content holds most rows, some as copies in every column: every row gets an id of its own,
    numbered from 1 in the order of the other columns, whether the table of later rows is broadcast or not."""
    from corpusprep.operators import clean as C
    rows = [("hot", i // 2) for i in range(400)] + [("hot", None)] * 3 + [(f"one {i}", i) for i in range(50)] + [(None, 1), ("", 1)]
    df = spark.createDataFrame(rows, "text string, other int").repartition(5)
    seen = []
    for limit in (C.BROADCAST_BYTES, 0):
        with mock.patch.object(C, "BROADCAST_BYTES", limit):
            found = C.ensure_id(df, ["text"]).collect()
        ids = [r.id for r in found]
        assert len(ids) == len(rows) == len(set(ids))
        assert sorted((r.text, r.other) for r in found if r.text and r.other is not None) == sorted(x for x in rows if x[0] and x[1] is not None)
        hot = hashlib.sha256(b"hot").hexdigest()
        assert {i for i in ids if i.startswith(hot)} == {f"{hot}#{n}" for n in range(1, 404)}
        seen.append(sorted((r.id, str(r.text), str(r.other)) for r in found))
    assert seen[0] == seen[1]


def test_answer_length_known_before_the_explode(spark):
    """The diffusion mask gives the same rows with the count that the sequence knew, and asks for no exchange."""
    from corpusprep.operators import masking as N
    rows = spark.createDataFrame([(k, p, 100 + p, int(p < k), 6 - k) for k in range(4) for p in range(6)],
                                 "key int, pos int, token_id int, prompt_mask int, n int")
    plain = N.diffusion_mask(rows, "key", prompt_mask="prompt_mask", clamp_min=False)
    known = N.diffusion_mask(rows, "key", prompt_mask="prompt_mask", clamp_min=False, n_col="n")
    assert sorted(plain.collect()) == sorted(known.collect())
    assert "Exchange" not in known._jdf.queryExecution().executedPlan().toString()


def test_feed_shuffles_records_not_tokens(spark, smoke_dir):
    """The training feed numbers exactly the molecules it returns, and no exchange carries token rows."""
    from corpusprep.plans.jobs import molecule_training_feed
    records = spark.createDataFrame([(str(i), "" if i == 3 else "[C][O]", None, '["C","O"]', "[[0,0,0],[1,0,0]]") for i in range(9)],
                                    "id string, selfies_string string, text_description string, atom_vec_str string, coordinates_str string")
    vocab = spark.createDataFrame([("[C]", 1), ("[O]", 2)], "token string, id int")
    feed = molecule_training_feed(records, vocab, max_atoms=4, max_selfies_len=8)
    found = feed.collect()
    assert {r.id for r in found} == {str(i) for i in range(9) if i != 3}
    assert sorted(r.idx for r in found) == list(range(8))
    plan = feed._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert exchanges and not any("REPARTITION" not in x and "token" in x for x in exchanges), plan


def test_blocks_are_dealt_to_all_tasks(spark, tmp_path):
    """The few bytes of the blocks' rows do not put all reading into one task, and no block reads far past its end."""
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("".join(f'"{i}","a ""b""\n{i}"\n' for i in range(200)))
        (tmp_path / f"{k}.json").write_text(json.dumps([{"a": [i, "x\\\"]"]} for i in range(200)]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for records in (blocks.csv_records(spark, str(tmp_path / "*.csv"), 256), blocks.json_items(spark, str(tmp_path / "*.json"), 256)):
        assert records.rdd.getNumPartitions() == parts and records.count() == 600
    long = tmp_path / "long.csv"
    long.write_bytes(b'"' + b"x" * 400_000 + b'"\n1\n')
    read = []
    chunks = blocks._chunks

    def counted(*args):
        for at, got in chunks(*args):
            read.append(len(got))
            yield at, got

    with mock.patch.object(blocks, "_chunks", counted):
        size = os.path.getsize(long)
        got = [r for at in range(0, size, 1000) for r in blocks.csv_records_of(f"file:{long}", at, min(at + 1000, size), int(0 < at), size)]
    assert [len(r) for _, r in got] == [400_002, 1] and sum(read) < 3 * size


def test_shards_do_not_make_a_task_each(spark, tmp_path):
    """Many small shards are read by the tasks there are; partitions do not grow with them one for one."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = spark.range(400).select((F.col("id") / 2).cast("long").alias("shard"), F.col("id").alias("idx"), F.concat(F.lit("k"), F.col("id"), F.lit(".txt")).alias("fname"),
                                      F.col("id").cast("string").cast("binary").alias("data"))
    assert tar.write_tar_shards(members, str(tmp_path)).count() == 200
    samples = tar.read_tar_samples(spark, str(tmp_path / "*.tar"))
    assert samples.rdd.getNumPartitions() == parts
    assert sorted(int(r.data["txt"]) for r in samples.collect()) == list(range(400))


def test_tokens_leave_the_tokenizer_in_slices(spark):
    from corpusprep.functions import udf
    fn = udf.tokenizer_udf(lambda: str.split).func
    import pandas as pd
    texts = pd.Series(["a b"] * 1000 + [None])
    out = list(fn(iter([texts, texts[:0]])))
    assert max(map(len, out)) <= udf.SLICE and [t for s in out for t in s] == [["a", "b"]] * 1000 + [[]]


def test_one_shard_is_featurised_by_all_tasks(spark, tmp_path):
    """A stream's shard of one row group is read in one task; its documents are dealt before they become rows."""
    spark.range(64).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
                           F.lit(5).cast("bigint").alias("n_chars")).coalesce(1).write.parquet(str(tmp_path / "in"))
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    q = feeds.start_featurise(spark, str(tmp_path / "in"), vocab, str(tmp_path / "out"), str(tmp_path / "ckpt"), seq_len=8)
    q.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 64 * 8 and len(written.inputFiles()) > 1
    once = feeds.featurise(spark.read.parquet(str(tmp_path / "in")), vocab, seq_len=8)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftrightunsigned" in plan[plan.index("Generate"):]  # the probability is found below the explode, once a document
    assert once.select("doc_id", "pos", "p_mask").distinct().count() == 64 * 8
