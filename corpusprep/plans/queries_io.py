"""Source/sink, join and loader-combination queries: S3, S4, S6, S9, S11,
J7, B7. File-format sources first write a file derived from the driver
tables into the shared scratch folder, then read it back with the source
under test; the oracle computes the expected rows from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching as B
from ..session import table
from ..sources import files as FS
from ..sources.shards import quarantine, read_shards, write_records, write_sized
from .registry import register


def _raw_molecules(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("cid"),
        F.concat(F.lit("["), F.col("l_returnflag"), F.lit("][="), F.col("l_linestatus"), F.lit("]")).alias("smiles"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("flag "), F.col("l_returnflag"), F.lit(', status "'), F.col("l_linestatus"),
                            F.lit('"'))).alias("Description"))


@register("s3_read_raw_csv", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS cid, '[' || l_returnflag || '][=' || l_linestatus || ']' AS smiles,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'flag ' || l_returnflag || ', status "' || l_linestatus || '"' END AS Description
FROM lineitem
""")
def s3_read_raw_csv(spark, sf):
    path = FS.scratch_path(spark, "raw-csv")
    _raw_molecules(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return FS.read_raw_csv(spark, path).select("cid", "smiles", "Description")


def _descriptions(spark, sf):
    """Raw records whose descriptions hold line breaks, commas and quotes: whole texts."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("cid"), F.concat(F.lit("["), "lang", F.lit("]")).alias("smiles"),
                    F.concat(F.lit('say "'), F.translate("text", "\r", " "), F.lit('",\n"end"')).alias("Description"))


@register("s3_csv_blocks", """
SELECT CAST(doc_id AS VARCHAR) AS cid, '[' || lang || ']' AS smiles,
       'say "' || replace(text, chr(13), ' ') || '",' || chr(10) || '"end"' AS Description
FROM documents
""")
def s3_csv_blocks(spark, sf):
    """Quoted line breaks, each file cut to blocks that many tasks read."""
    path = FS.scratch_path(spark, "csv-blocks")
    _descriptions(spark, sf).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return FS.read_csv_blocks(spark, path + "/*.csv", block_bytes=1 << 16).select("cid", "smiles", "Description")


@register("s4_read_questions", "SELECT text AS question FROM conversations WHERE role = 'user'")
def s4_read_questions(spark, sf):
    path = FS.scratch_path(spark, "questions")
    c = table(spark, sf, "conversations")
    c.where(F.col("role") == "user").select(F.col("text").alias("question")).write.json(path)
    return FS.read_questions(spark, path).select("question")


@register("s6_read_prompt_lines",
          "SELECT replace(replace(text, chr(13), ' '), chr(10), ' ') AS prompt FROM documents")
def s6_read_prompt_lines(spark, sf):
    path = FS.scratch_path(spark, "prompts")
    d = table(spark, sf, "documents")
    d.select(F.translate("text", "\r\n", "  ").alias("value")).write.text(path)
    return FS.read_prompt_lines(spark, path)


S5_SQL = """
SELECT CAST(page_id AS VARCHAR) || '.html' AS file_name, CAST(0 AS BIGINT) AS turn, 'user' AS role, url AS text FROM pages
UNION ALL
SELECT CAST(page_id AS VARCHAR) || '.html' AS file_name, CAST(1 AS BIGINT) AS turn, 'assistant' AS role, html AS text FROM pages
"""


@register("s5_read_chat_json", S5_SQL)
def s5_read_chat_json(spark, sf):
    """Each page becomes one chat item (file name + two messages built from
    that row alone), written as JSON and read back as turns."""
    path = FS.scratch_path(spark, "chat-json")
    p = table(spark, sf, "pages")
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("url").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("html").alias("content")))
    p.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"),
             msgs.alias("messages")).write.json(path)
    r = FS.read_chat_json(spark, path, multi_line=False)
    return r.select("file_name", F.col("turn").cast("bigint"), "role", "text")


@register("s5_json_array", S5_SQL)
def s5_json_array(spark, sf):
    """The same items as one JSON array a file, each file cut to blocks that many tasks read."""
    path = FS.scratch_path(spark, "json-array")
    p = table(spark, sf, "pages")
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("url").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("html").alias("content")))
    items = p.select(F.col("page_id"), F.to_json(F.struct(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"),
                                                          msgs.alias("messages"))).alias("item"))
    # a line an item; the first of a file opens the array, the others follow a comma, a last line closes it
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.repartition(parts, "page_id").withColumn("_p", F.spark_partition_id()).sortWithinPartitions("page_id")
    lines = dealt.select("_p", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("n"), "item")
    ends = lines.select("_p").distinct().select("_p", F.lit(1 << 40).alias("n"), F.lit("]").alias("item"))
    text = F.when(F.col("item") == "]", F.col("item")).when(F.col("n") == 0, F.concat(F.lit("["), "item")).otherwise(F.concat(F.lit(","), "item"))
    (lines.select("_p", "n", text.alias("value")).unionByName(ends.select("_p", "n", F.col("item").alias("value")))
     .repartitionById(parts, "_p").sortWithinPartitions("n").select("value").write.text(path))
    turns, _ = FS.read_chat_array(spark, path + "/*.txt", block_bytes=1 << 16)
    return turns.select("file_name", F.col("turn").cast("bigint"), "role", "text")


@register("s9_sized_files", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, text FROM documents
""")
def s9_sized_files(spark, sf):
    """Files of about a quarter of a megabyte of row bytes each, read back."""
    path = FS.scratch_path(spark, "sized")
    write_sized(table(spark, sf, "documents").select("doc_id", "lang", "text"), path, ["doc_id"], target_bytes=1 << 18)
    return read_shards(spark, [path]).select(F.col("doc_id").cast("bigint"), "lang", "text")


@register("s9_file_plan", """
WITH b AS (SELECT doc_id, strlen(text) AS w FROM documents),
f AS (SELECT w, (sum(w) OVER (ORDER BY doc_id) - w) // 262144 AS file FROM b)
SELECT CAST(file AS BIGINT) AS file, CAST(count(*) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS bytes FROM f GROUP BY file
""")
def s9_file_plan(spark, sf):
    """Which file every row goes to, from a running sum of its text's bytes."""
    path = FS.scratch_path(spark, "sized-plan")
    files = write_sized(table(spark, sf, "documents").select("doc_id", "text"), path, ["doc_id"], target_bytes=1 << 18, size=F.octet_length("text"))
    return files.select(F.col("file").cast("bigint"), F.col("rows").alias("n"), F.col("bytes").cast("bigint"))


@register("s1_quarantine", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, n_chars, text FROM documents
""")
def s1_quarantine(spark, sf):
    """Good shards beside one that is no Parquet file: all rows of the former, the latter a reject."""
    path = FS.scratch_path(spark, "quarantine")
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    d.write.parquet(f"{path}/good")
    spark.range(1).select(F.lit("PAR1 cut short").alias("value")).coalesce(1).write.text(f"{path}/text")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    broken = next(s.getPath() for s in fs.listStatus(hadoop(f"{path}/text")) if s.getPath().getName().endswith(".txt"))
    fs.rename(broken, hadoop(f"{path}/good/part-broken.parquet"))
    rows, rejects = quarantine(spark, f"{path}/good", pages=True)
    if rejects.count() != 1:
        raise ValueError("one shard is broken")
    return rows.select(F.col("doc_id").cast("bigint"), "n_chars", "text")


@register("s9_write_records", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents
""")
def s9_write_records(spark, sf):
    path = FS.scratch_path(spark, "records")
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    write_records(d, path, partition_by=["lang"], max_records_per_file=100_000)
    back = read_shards(spark, [path])
    return back.select(F.col("doc_id").cast("bigint"), "lang", F.col("n_chars").cast("bigint"))


def _esc_sql(c: str) -> str:
    return (f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


HOST_RE = r"^https?://([^/?#]+)"


@register("s11_report_rows", f"""
SELECT regexp_extract(url, '{HOST_RE}', 1) AS host, CAST(page_id AS BIGINT) AS page_id,
       '<div><h4>Prompt</h4><p>' || {_esc_sql('url')} || '</p><h4>Response</h4><p>' || {_esc_sql("coalesce(html, '')")}
       || '</p></div>' AS fragment
FROM pages
""")
def s11_report_rows(spark, sf):
    p = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", HOST_RE, 1))
    r = FS.report_rows(p, "host", "page_id", "url", "html")
    return r.select("host", F.col("page_id").cast("bigint"), "fragment")


_FRAGMENT = (f"'<div><h4>Prompt</h4><p>' || {_esc_sql('url')} || '</p><h4>Response</h4><p>' || "
             f"""{_esc_sql("coalesce(html, '')")} || '</p></div>'""")


@register("s11_reports", f"""
SELECT host, CAST(count(*) AS BIGINT) AS n, string_agg(fragment, '' ORDER BY page_id) AS report
FROM (SELECT regexp_extract(url, '{HOST_RE}', 1) || '/' || (page_id // 8) AS host, page_id, {_FRAGMENT} AS fragment FROM pages) f GROUP BY host
""")
def s11_reports(spark, sf):
    """One report for each host and run of eight pages."""
    host = F.concat(F.regexp_extract("url", HOST_RE, 1), F.lit("/"), F.floor(F.col("page_id") / 8).cast("string"))
    rows = FS.report_rows(table(spark, sf, "pages").withColumn("host", host), "host", "page_id", "url", "html")
    return FS.reports(rows, "host", "page_id")


@register("s11_report_parts", f"""
WITH f AS (SELECT regexp_extract(url, '{HOST_RE}', 1) AS host, page_id, {_FRAGMENT} AS fragment FROM pages),
p AS (SELECT *, (sum(strlen(fragment)) OVER (PARTITION BY host ORDER BY page_id) - strlen(fragment)) // 65536 AS part FROM f)
SELECT host, CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n, string_agg(fragment, '' ORDER BY page_id) AS report FROM p GROUP BY host, part
""")
def s11_report_parts(spark, sf):
    """One report for each host, in numbered parts; read back in order."""
    path = FS.scratch_path(spark, "report-parts")
    rows = FS.report_rows(table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", HOST_RE, 1)), "host", "page_id", "url", "html")
    FS.write_report_parts(rows, path, "host", "page_id", part_bytes=1 << 16)
    return FS.read_report_parts(spark, path, "host").select("host", F.col("part").cast("bigint"), F.col("n").cast("bigint"), "report")


@register("s11_report_manifest", f"""
WITH f AS (SELECT regexp_extract(url, '{HOST_RE}', 1) AS host, page_id, {_FRAGMENT} AS fragment FROM pages),
p AS (SELECT *, (sum(strlen(fragment)) OVER (PARTITION BY host ORDER BY page_id) - strlen(fragment)) // 65536 AS part FROM f)
SELECT host, CAST(count(DISTINCT part) AS BIGINT) AS parts, CAST(count(*) AS BIGINT) AS n, CAST(sum(strlen(fragment)) AS BIGINT) AS bytes FROM p GROUP BY host
""")
def s11_report_manifest(spark, sf):
    rows = FS.report_rows(table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", HOST_RE, 1)), "host", "page_id", "url", "html")
    return FS.report_manifest(FS.report_parts(rows, "host", "page_id", part_bytes=1 << 16), "host")


@register("j1_answers", """
WITH q AS (SELECT * FROM (VALUES (0, 'quality'), (1, 'toxic')) v(q_idx, question)),
a AS (SELECT l.doc_id, q.q_idx, CASE q.question WHEN 'quality' THEN l.quality ELSE nullif(l.toxic, 0) END AS answer FROM labels l, q)
SELECT CAST(doc_id AS BIGINT) AS doc_id, string_agg(CAST(answer AS VARCHAR), ',' ORDER BY q_idx) AS answers
FROM a WHERE answer IS NOT NULL GROUP BY doc_id
""")
def j1_answers(spark, sf):
    """Two questions for every labelled document; answers regrouped, those without any left out."""
    from ..operators.joins import answers_by_sample, ask_questions
    asked = ask_questions(table(spark, sf, "labels"), ["quality", "toxic"])
    answer = F.when(F.col("question") == "quality", F.col("quality")).otherwise(F.nullif(F.col("toxic"), F.lit(0)))
    got = answers_by_sample(asked.withColumn("answer", answer.cast("string")), "doc_id")
    return got.select(F.col("doc_id").cast("bigint"), F.array_join("answers", ",").alias("answers"))


# ---------------------------------------------------------------- J7 ----
@register("j7_caption_join", """
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, d.lang, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def j7_caption_join(spark, sf):
    from ..operators.joins import attach_captions
    d = table(spark, sf, "documents").select("doc_id", "lang")
    j = attach_captions(d, table(spark, sf, "labels"), "doc_id")
    return j.select(F.col("doc_id").cast("bigint"), "lang", F.col("quality").cast("bigint"),
                    F.col("toxic").cast("bigint"))


@register("j7_orphans", """
SELECT 'sample' AS side, CAST(doc_id AS BIGINT) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL
SELECT 'caption' AS side, CAST(doc_id AS BIGINT) AS doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def j7_orphans(spark, sf):
    from ..operators.joins import orphans
    o = orphans(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")
    return o.select("side", F.col("doc_id").cast("bigint"))


# ---------------------------------------------------------------- B7 ----
B7_SQL = """
WITH d AS (SELECT count(*) AS n FROM documents),
c AS (SELECT count(DISTINCT conv_id) AS n FROM conversations),
nb AS (SELECT CAST(ceil(d.n / 8.0) AS BIGINT) AS nd, CAST(ceil(c.n / 8.0) AS BIGINT) AS nc FROM d, c),
steps AS (SELECT unnest(range(nd)) AS step FROM nb)
SELECT CAST(step AS BIGINT) AS step, 'primary' AS source, CAST(step % nd AS BIGINT) AS batch_id FROM steps, nb
UNION ALL
SELECT CAST(step AS BIGINT) AS step, 'chat' AS source, CAST(step % nc AS BIGINT) AS batch_id FROM steps, nb
"""


_NB = B7_SQL[:B7_SQL.index("steps AS")].rstrip().rstrip(",")


def _b7(spark, sf, mode, rng):
    docs = B.batch_id(B.shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", rng=rng), 8)
    chats = B.batch_id(B.shuffle(table(spark, sf, "conversations").select("conv_id").distinct(), "conv_id",
                                 rng=rng), 8)
    out = B.combine(docs.select("batch_id").distinct(), {"chat": chats.select("batch_id").distinct()}, mode=mode)
    return out.select(F.col("step").cast("bigint"), "source", F.col("batch_id").cast("bigint"))


@register("b7_combined_loader", B7_SQL)
def b7_combined_loader(spark, sf, rng="portable"):
    return _b7(spark, sf, "max_size_cycle", rng)


@register("b7_min_size", f"""{_NB},
steps AS (SELECT unnest(range(least(nd, nc))) AS step FROM nb)
SELECT CAST(step AS BIGINT) AS step, s.source, CAST(step AS BIGINT) AS batch_id
FROM steps, (VALUES ('primary'), ('chat')) s(source)
""")
def b7_min_size(spark, sf, rng="portable"):
    return _b7(spark, sf, "min_size", rng)


@register("b7_sequential", f"""{_NB}
SELECT CAST(i AS BIGINT) AS step, 'primary' AS source, CAST(i AS BIGINT) AS batch_id FROM (SELECT unnest(range(nd)) AS i FROM nb)
UNION ALL
SELECT CAST(nd + i AS BIGINT) AS step, 'chat' AS source, CAST(i AS BIGINT) AS batch_id FROM (SELECT nd, unnest(range(nc)) AS i FROM nb)
""")
def b7_sequential(spark, sf, rng="portable"):
    return _b7(spark, sf, "sequential", rng)


@register("b7_updates_per_epoch", f"""{_NB}
SELECT CAST(nd + nc AS BIGINT) AS batches, CAST(ceil((nd + nc) / 4.0) AS BIGINT) AS updates FROM nb
""")
def b7_updates_per_epoch(spark, sf, rng="portable"):
    steps = _b7(spark, sf, "sequential", rng).agg(F.count(F.lit(1)).alias("batches"))
    return steps.select("batches", B.updates_per_epoch(F.col("batches"), 4).cast("bigint").alias("updates"))
