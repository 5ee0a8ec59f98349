"""Hand-written edge rows: text, molecules, sources."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from corpusprep.functions import constants as K
from corpusprep.functions import text as T
from corpusprep.operators import clean as C
from corpusprep.operators import molecules as M
from corpusprep.operators import tokens as TK
from corpusprep.sources import files as FS
from corpusprep.sources.shards import expand_pattern, read_shards


def test_tokens_edges(spark):
    df = spark.createDataFrame([("",), ("one",), ("  a\tb\n<|eot_id|>c  ",), (None,)], "text string")
    got = [r[0] for r in df.select(T.tokens(F.col("text"))).collect()]
    assert got == [[], ["one"], ["a", "b", "<|eot_id|>", "c"], []]


def test_tokenise_truncates_and_masks(spark):
    df = spark.createDataFrame([("a b c d",)], "text string")
    r = TK.tokenise(df, "text", max_len=3, mask_out="m").first()
    assert r["tokens"] == ["a", "b", "c"] and r["m"] == [1, 1, 1]


def test_person_scrub(spark):
    df = spark.createDataFrame([(1, "Hi <person>, <PERSON> and <Person> went. <person> stayed"),
                                (2, "no tags")], "k long, text string")
    out = {r["k"]: r["t"] for r in df.select("k", T.scrub_person_tags(F.col("text"), F.col("k")).alias("t")).collect()}
    assert out[2] == "no tags"
    assert out[1].startswith("Hi  people  went. ")
    assert "<person>" not in out[1].lower()
    assert any(w in out[1] for w in K.PERSON_WORDS)


def test_html_escape(spark):
    df = spark.createDataFrame([("""<a href="x">Tom & 'Jerry'</a>""",)], "s string")
    got = df.select(T.html_escape(F.col("s"))).first()[0]
    assert got == "&lt;a href=&quot;x&quot;&gt;Tom &amp; &#x27;Jerry&#x27;&lt;/a&gt;"


def test_atom_numbers_symbols_digits_unknown(spark):
    df = spark.createDataFrame([("C",), ("N",), ("Cl",), ("8",), ("Xx",), ("R",)], "symbol string")
    got = [r["atomic_num"] for r in M.atom_numbers(df).collect()]
    assert sorted(got) == sorted([6, 7, 17, 8, 0, 0])


def test_validity_reasons(spark):
    rows = [
        ("[]", "[]"),                                     # no atoms
        ("[", "[[0,0,0]]"),                               # malformed JSON
        ('["C","O"]', "[[0,0,0],[1,1]]"),                 # ragged coordinates
        ('["C","O"]', "[[0,0,0]]"),                       # coordinate count != atom count
        (json.dumps(["C"] * 256), json.dumps([[0, 0, 0]] * 256)),   # exactly the limit
        (json.dumps(["C"] * 257), json.dumps([[0, 0, 0]] * 257)),   # one over
        ('[6,8]', "[[0,0,0],[1,1,1]]"),                   # numbers as written by the converter
    ]
    df = spark.createDataFrame(rows, "atom_vec_str string, coordinates_str string")
    p = M.parse_record(df)
    got = [r[0] for r in p.select(C.validity(F.col("atom_vec"), F.col("coordinates"), 256)).collect()]
    assert got == ["no_atoms", "parse_error", "shape_mismatch", "shape_mismatch", "ok", "too_many_atoms", "ok"]


def test_distance_matrix_and_padding(spark):
    df = spark.createDataFrame([([6, 8], [[0.0, 0.0, 0.0], [3.0, 4.0, 0.0]])], "atom_vec array<int>, coords array<array<double>>")
    d = df.select(M.distance_matrix(F.col("coords")).alias("d")).first()["d"]
    assert d == [[0.0, 5.0], [5.0, 0.0]]
    ids, xyz, mask = M.pad_atoms(F.col("atom_vec"), F.col("coords"), 4)
    r = df.select(ids.alias("i"), xyz.alias("x"), mask.alias("m")).first()
    assert r["i"] == [6, 8, 0, 0] and r["m"] == [True, True, False, False] and r["x"][3] == [0.0, 0.0, 0.0]


def test_bond_edges_symmetric(spark):
    b = spark.createDataFrame([(1, 0, 1, "DOUBLE"), (1, 1, 2, "WEIRD")], "mol long, i int, j int, bond string")
    e = {(r["i"], r["j"]): r["bond_type"] for r in M.bond_edges(b).collect()}
    assert e == {(0, 1): 2, (1, 0): 2, (1, 2): 0, (2, 1): 0}
    dense = M.densify(M.bond_edges(b), "bond_type", 3).first()["bond_type"]
    assert dense == [[0, 2, 0], [2, 0, 0], [0, 0, 0]]


def test_tar_grouping_edges(spark):
    from corpusprep.sources import tar as TR
    names = ["a.jpg", "a.txt", "a.JPG", "a.json", "a.json", "b.jpg", "noext", "a.txt", "dir/c.tar.gz"]
    df = spark.createDataFrame([("u", i, n, n.encode()) for i, n in enumerate(names)],
                               "url string, idx long, fname string, data binary")
    samples = lambda **kw: [(r["key"], r["suffixes"]) for r in TR.group_samples(df, **kw).orderBy("sample_no").collect()]
    got = samples()
    assert got == [("a", ["jpg", "txt"]),        # upper-case JPG repeats jpg -> new sample
                   ("a", ["jpg", "json"]),
                   ("a", ["json"]),              # json repeated inside the key run
                   ("b", ["jpg"]),               # name without extension skipped
                   ("a", ["txt"]),               # key re-appearing after another key
                   ("dir/c", ["tar.gz"])]
    only = samples(suffixes={"txt"})
    assert only[0] == ("a", ["txt"]) and len(only) == 4   # ignored suffixes never split a sample
    assert samples(lcase=False)[0] == ("a", ["jpg", "txt", "JPG", "json"])


def test_tars_are_read_apart(spark, tmp_path, monkeypatch):
    """A file is a partition, a large shard comes in several batches, a damaged one ends early."""
    from corpusprep.sources import tar as TR
    monkeypatch.setattr(TR, "BATCH_BYTES", 3000)
    rows = [(s, i, f"k{i // 2}.{'a' if i % 2 else 'b'}", bytes(500)) for s in range(16) for i in range(40)]
    df = spark.createDataFrame(rows, "shard long, idx long, fname string, data binary")
    assert TR.write_tar_shards(df, f"{tmp_path}/t").agg(F.sum("members")).first()[0] == 640
    got = TR.read_members(spark, f"{tmp_path}/t/*.tar")
    assert got.count() == 640 and got.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert TR.read_tar_samples(spark, f"{tmp_path}/t/*.tar").count() == 320
    with open(f"{tmp_path}/t/shard-00000.tar", "r+b") as f:
        f.truncate(5000)
    again = TR.read_members(spark, f"{tmp_path}/t/*.tar")
    assert again.where("damaged").count() == 1 and 600 <= again.where("NOT damaged").count() < 640


def test_brace_ranges():
    assert expand_pattern("/d/shard-{00..02}.parquet") == ["/d/shard-00.parquet", "/d/shard-01.parquet",
                                                          "/d/shard-02.parquet"]
    assert expand_pattern("/d/{8..10}/x") == ["/d/8/x", "/d/9/x", "/d/10/x"]


def test_read_shards_range(spark):
    d = tempfile.mkdtemp(prefix="corpusprep-shards-", dir="/tmp")
    for i in range(3):
        spark.createDataFrame([(i, f"t{i}")], "doc_id long, text string").write.parquet(f"{d}/shard-{i:03d}")
    got = read_shards(spark, f"{d}/shard-{{000..002}}", with_file=True)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2]
    assert got.where(F.col("source_file").contains("shard-001")).count() == 1


def test_read_shards_corrupt_file_and_missing_pattern(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="corpusprep-bad-", dir="/tmp")
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{d}/shard-000")
    with open(f"{d}/shard-001.parquet", "wb") as f:
        f.write(b"not a parquet file")
    schema = "doc_id long, text string"
    got = read_shards(spark, [f"{d}/shard-000", f"{d}/shard-001.parquet"], schema=schema, ignore_corrupt=True)
    assert [r["doc_id"] for r in got.collect()] == [1]                     # unreadable shard skipped
    with pytest.raises(Exception):
        read_shards(spark, [f"{d}/shard-000", f"{d}/shard-001.parquet"], schema=schema).collect()
    with pytest.raises(Exception):
        read_shards(spark, f"{d}/nothing-{{0..3}}", schema=schema).collect()  # nothing matches


def test_limit_rows_needs_an_order(spark):
    import pytest
    from corpusprep.sources.shards import limit_rows
    df = spark.range(10)
    with pytest.raises(ValueError):
        limit_rows(df, 3, [])
    assert [r[0] for r in limit_rows(df, 3, [F.desc("id")]).collect()] == [9, 8, 7]


def test_read_chat_json(spark):
    d = tempfile.mkdtemp(prefix="corpusprep-chat-", dir="/tmp")
    items = [{"file_name": "a.jpg", "messages": [{"role": "user", "content": "<image>\nWhat is it?"},
                                                 {"role": "assistant", "content": "A cat."}]},
             {"file_name": "b.jpg", "messages": [{"role": "user", "content": "Color?"}]}]
    with open(os.path.join(d, "prompts.json"), "w") as f:
        json.dump(items, f)
    rows = FS.read_chat_json(spark, d).orderBy("file_name", "turn").collect()
    assert [(r["file_name"], r["turn"], r["role"]) for r in rows] == [
        ("a.jpg", 0, "user"), ("a.jpg", 1, "assistant"), ("b.jpg", 0, "user")]


def test_read_questions_keeps_corrupt(spark):
    d = tempfile.mkdtemp(prefix="corpusprep-q-", dir="/tmp")
    with open(os.path.join(d, "q.jsonl"), "w") as f:
        f.write('{"question": "Why?"}\n{"question": broken\n')
    rows = FS.read_questions(spark, d).collect()
    assert sum(r["question"] == "Why?" for r in rows) == 1
    assert sum(r["_corrupt_record"] is not None for r in rows) == 1


def test_convert_job_writes_and_counts(spark, smoke_dir):
    from corpusprep.plans import inputs as I
    from corpusprep.plans.jobs import convert_molecules
    from corpusprep.session import table
    li = table(spark, smoke_dir, "lineitem").select(
        F.col("l_orderkey").alias("mol"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    atoms = I.atom_index(li, 64)
    out = tempfile.mkdtemp(prefix="corpusprep-convert-", dir="/tmp") + "/records"
    records, counts, written = convert_molecules(atoms, max_atoms=4, out=out)
    by_reason = {r["reason"]: r["n"] for r in counts.collect()}
    back = spark.read.parquet(out)
    assert written.get["written"] == back.count() == by_reason["ok"]
    assert by_reason.get("too_many_atoms", 0) > 0
    row = back.first()
    assert len(json.loads(row["dist_str"])) == len(json.loads(row["atom_vec_str"]))


def test_report_sink_groups_in_order(spark):
    d = tempfile.mkdtemp(prefix="corpusprep-report-", dir="/tmp") + "/r"
    df = spark.createDataFrame([("a", i, f"q{i} <x>", f"r{i}") for i in range(30)] + [("b", 0, "only", None)],
                               "grp string, ord int, prompt string, response string")
    FS.write_report(FS.report_rows(df, "grp", "ord", "prompt", "response"), d, "grp", "ord")
    got = spark.read.text(d + "/grp=a").collect()
    assert len(got) == 30 and "q0 &lt;x&gt;" in got[0]["value"]
    lines = [r["value"] for r in spark.read.text(d + "/grp=a").collect()]
    assert lines == sorted(lines, key=lambda s: int(s.split("<p>q")[1].split(" ")[0]))
    assert spark.read.text(d + "/grp=b").count() == 1
    raw = FS.report_rows(df, "grp", "ord", "prompt", "response", escape=False).where("ord = 0 AND grp = 'a'")
    assert "q0 <x>" in raw.first()["fragment"]


def test_ensure_id_keeps_existing_and_numbers_copies(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "text string")
    ids = sorted(r["id"] for r in C.ensure_id(df, ["text"]).collect())
    assert len(set(ids)) == 3 and sum(i.endswith("#2") for i in ids) == 1
    with_id = spark.createDataFrame([("a", "x")], "id string, text string")
    assert C.ensure_id(with_id, ["text"]).first()["id"] == "a"


def test_inputs_that_used_to_lose_data(spark):
    from corpusprep.operators import batching as B
    from corpusprep.operators import metrics as A
    from corpusprep.operators import select as K
    from corpusprep.operators import tokens as TK
    from corpusprep.sources.files import report_rows
    p = spark.createDataFrame([(["C", "O"], [[0.0, 0.0, 0.0], None]), (["C", "O"], [[0.0, 0.0, 0.0], [0.0, None, 1.0]])],
                              "a array<string>, c array<array<double>>")
    assert {r[0] for r in p.select(C.validity(F.col("a"), F.col("c"), 9)).collect()} == {"shape_mismatch"}
    atoms = spark.createDataFrame([("99999999999",), ("7",), ("N",), (None,)], "symbol string")
    assert [r.atomic_num for r in M.atom_numbers(atoms).collect()] == [0, 7, 7, 0]
    assert [r[0] for r in atoms.select(M._number_of(F.col("symbol"))).collect()] == [0, 7, 7, 0]
    row = spark.createDataFrame([(1, k, float(k)) for k in range(5)], "id int, k int, x double")
    assert K.top_k_top_p(row, "id", top_k=9).count() == 5
    losses = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 1e-13, 3), ("b", float("nan"), 1), ("b", 1.0, 2),
                                    ("c", float("inf"), 1), ("c", 1.0, 2)], "s string, v double, step int")
    got = {r.s: r for r in A.meter(losses, ["s"], "v", None, "step").collect()}
    assert got["a"].sum == 4.0000000000001 and got["b"].sum != got["b"].sum and got["c"].sum == float("inf")
    one, none = spark.range(3).withColumnRenamed("id", "batch_id"), spark.range(0).withColumnRenamed("id", "batch_id")
    assert B.combine(one, {"x": none}).count() == 3 and B.combine(one, {"x": none}, mode="min_size").count() == 0
    assert B.combine(none, {"x": none}).count() == 0
    said = spark.createDataFrame([("g", 1, None, "yes")], "g string, o int, p string, r string")
    assert "yes" in report_rows(said, "g", "o", "p", "r").first().fragment
    twice = spark.createDataFrame([(1, 0, 1, "SINGLE"), (1, 0, 1, "TRIPLE")], "mol int, i int, j int, bond string")
    assert {r.bond_type for r in M.bond_edges(twice).collect()} == {3}
    words = spark.createDataFrame([(w,) for w in "a b b c c c".split()], "token string")
    assert TK.build_vocab(words, max_size=None).count() == 3 and TK.build_vocab(words, max_size=2).count() == 2
    import pytest
    with pytest.raises(ValueError):
        TK.build_vocab(words, max_size=3, id_space=2)


def test_ids_of_copies_do_not_depend_on_partitions(spark):
    rows = [("x", i % 3) for i in range(12)] + [("y", 1)]
    ids = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "text string, extra int").repartition(parts)
        ids.append(sorted((r.id, r.text, r.extra) for r in C.ensure_id(df, ["text"]).collect()))
    assert ids[0] == ids[1] and len({i for i, _, _ in ids[0]}) == 13


def test_molecules_over_the_gate(spark):
    from corpusprep.plans.jobs import convert_molecules
    atoms = spark.createDataFrame([(1, i, "C", 0.0, float(i), 0.0) for i in range(9)] + [(2, 0, "N", 1.0, 1.0, 1.0)]
                                  + [(3, i, "O", 0.0, 0.0, float(i)) for i in range(3)], "mol int, atom_idx int, symbol string, x double, y double, z double")
    text = spark.createDataFrame([(2, "nitrogen")], "mol int, text_description string")
    records, counts, _ = convert_molecules(atoms, descriptions=text, max_atoms=4)
    got = {r.id: r for r in records.collect()}
    assert set(got) == {"2", "3"} and {r.reason: r.n for r in counts.collect()} == {"ok": 2, "too_many_atoms": 1}
    assert got["2"].text_description == "nitrogen" and got["3"].text_description == ""
    assert got["2"].edge_type_str == "[[0]]" and got["3"].bond_type_str == "[[0,1,0],[1,0,2],[0,2,0]]"
    edges = M.bond_edges(M.chain_bonds(atoms.where("mol <> 1")))
    dense = {r.mol: r.bond_type for r in M.densify(edges, "bond_type", 3, molecules=atoms.where("mol <> 1").select("mol")).collect()}
    assert dense == {2: [[0, 0, 0]] * 3, 3: [[0, 1, 0], [1, 0, 2], [0, 2, 0]]}


def test_matrices_fit_both_limits(spark):
    df = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],), ([],), (None,)], "m array<array<int>>")
    got = [r[0] for r in df.select(M.fit_matrix(F.col("m"), 3, 2)).collect()]
    assert got == [[[1, 2], [4, 5], [0, 0]], [[0, 0]] * 3, [[0, 0]] * 3]
    assert df.select(M.fit_matrix(F.col("m"), 1, 4)).first()[0] == [[1, 2, 3, 0]]


def test_questions_reach_molecules_of_any_size(spark, smoke_dir, tmp_path):
    """An order holding a third of the lines is asked every question."""
    import duckdb

    from corpusprep.plans import inputs as I
    from corpusprep.plans import queries_mol as Q
    spark.read.parquet(f"{smoke_dir}/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    lines = spark.read.parquet(f"{smoke_dir}/lineitem.parquet")
    hot = F.when(F.pmod(F.xxhash64("l_partkey", "l_suppkey", "l_extendedprice"), F.lit(3)) == 0, F.lit(7)).otherwise(F.col("l_orderkey"))
    lines.withColumn("l_orderkey", hot.cast(lines.schema["l_orderkey"].dataType)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.mol, r.q_idx): r.ids for r in Q.j1_molecule_questions(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    for t in ("documents", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = {(m, q): ids for m, q, ids in db.execute(Q.J1_SQL.replace(I.MOL_SQL, I.MOL_ALL_SQL)).fetchall()}
    assert len(got[7, 0].split(",")) > Q.PIECE and got == want
