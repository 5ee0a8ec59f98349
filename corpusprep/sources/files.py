"""Text-format sources and the report sink.

Every reader takes an explicit schema: no inference pass over the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordering import running_sum
from ..session import ensure_checkpoint_dir
from . import blocks

RAW_MOLECULE_SCHEMA = "cid string, smiles string, Description string, _corrupt_record string"
QUESTION_SCHEMA = "question string, _corrupt_record string"
CHAT_JSON_SCHEMA = "file_name string, messages array<struct<role:string,content:string>>"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex}"


def read_raw_csv(spark: SparkSession, path: str, *, header: bool = True, multi_line: bool = True) -> DataFrame:
    """S3: raw molecule records ``(cid, smiles, Description)``; malformed
    lines kept in ``_corrupt_record`` (quarantined by the caller, C6). Files
    without line breaks inside quotes can be split with ``multi_line=False``."""
    return (spark.read.schema(RAW_MOLECULE_SCHEMA).option("header", header)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("multiLine", multi_line).option("escape", '"').csv(path))


def read_csv_blocks(spark: SparkSession, path: str | list[str], *, header: bool = True, schema: str = RAW_MOLECULE_SCHEMA,
                    block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """S3 in many tasks a file: the rows of ``read_raw_csv`` with line breaks
    inside quotes, without reading a file in one task. Records are found by quote
    parity (``blocks``), then parsed one by one."""
    records = blocks.csv_records(spark, path, block_bytes)
    if header:
        records = records.where("at > 0")
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")


def read_json_array(spark: SparkSession, path: str | list[str], schema: str, *, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Items of files that are one JSON array each, in many tasks a file. An
    item that is no valid JSON is kept in ``_corrupt_record``, its neighbours are read."""
    items = blocks.json_items(spark, path, block_bytes)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return items.select(F.from_json("record", schema + ", _corrupt_record string", options).alias("r")).select("r.*")


def read_chat_array(spark: SparkSession, path: str | list[str], *, block_bytes: int = blocks.BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """S5 for array files of any size: (turns as ``read_chat_json`` gives them, items that could not be read)."""
    d = read_json_array(spark, path, CHAT_JSON_SCHEMA, block_bytes=block_bytes)
    turns = d.where("_corrupt_record IS NULL").select("file_name", F.posexplode("messages").alias("turn", "m"))
    return (turns.select("file_name", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text")),
            d.where("_corrupt_record IS NOT NULL").select("_corrupt_record"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one ``{"question": ...}`` per line."""
    return (spark.read.schema(QUESTION_SCHEMA).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def read_chat_json(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Nested multimodal chat items ``{file_name, messages[]}`` (a JSON
    array file, or JSON lines) -> one row per turn ``(file_name, turn, role,
    text)``."""
    d = spark.read.schema(CHAT_JSON_SCHEMA).option("multiLine", multi_line).json(path)
    return d.select("file_name", F.posexplode("messages").alias("turn", "m")).select(
        "file_name", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def read_prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """One prompt per line."""
    return spark.read.text(path).withColumnRenamed("value", "prompt")


def report_rows(df: DataFrame, group: str, order: str, prompt: str, response: str, *,
                escape: bool = True) -> DataFrame:
    """prompt/response fragments (HTML-escaped unless ``escape=False``),
    one row per item, keyed by ``(group, order)``; a group's report is its
    fragments in order."""
    esc = T.html_escape if escape else (lambda c: c)
    frag = F.concat(F.lit("<div><h4>Prompt</h4><p>"), esc(F.coalesce(F.col(prompt), F.lit(""))),
                    F.lit("</p><h4>Response</h4><p>"), esc(F.coalesce(F.col(response), F.lit(""))),
                    F.lit("</p></div>"))
    return df.select(group, order, frag.alias("fragment"))


def reports(rows: DataFrame, group: str, order: str) -> DataFrame:
    """One report per group ``(group, n, report)``, its fragments in
    order. For groups that fit a row; ``write_report`` has no such bound."""
    return (rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "fragment"))).alias("_f"))
            .select(group, F.size("_f").cast("bigint").alias("n"), F.array_join(F.transform("_f", lambda f: f["fragment"]), "").alias("report")))


def write_report(rows: DataFrame, path: str, group: str, order: str) -> None:
    """S11 sink: one folder per group, fragments written in order; the data
    is range-partitioned, never collected."""
    (rows.repartitionByRange(group, order).sortWithinPartitions(group, order)
     .select(group, "fragment").write.mode("overwrite").partitionBy(group).text(path))


#: Bytes of a report part.
PART_BYTES = 1 << 20


def report_parts(rows: DataFrame, group: str, order: str, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """S11 for groups of any size: (group, part, n, report), a report's numbered
    parts of about ``part_bytes`` each; put together in order of part they are the
    group's report. A fragment is never cut. The part a fragment belongs to comes
    from a running sum over keys and sizes, so a large group is spread over tasks."""
    sized = rows.select(group, order, F.octet_length("fragment").alias("_bytes"))
    placed = running_sum(sized, [order], F.col("_bytes"), group_by=[group], out="_before")
    part = F.floor(F.col("_before") / int(part_bytes)).alias("part")
    parts = rows.join(placed.select(group, order, part), [group, order])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "fragment"))), lambda f: f["fragment"]), "")
    return parts.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), text.alias("report"))


def report_manifest(parts: DataFrame, group: str) -> DataFrame:
    """(group, parts, n, bytes): what a group's report consists of."""
    return parts.groupBy(group).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum(F.octet_length("report")).cast("long").alias("bytes"))


def write_report_parts(rows: DataFrame, path: str, group: str, order: str, *, part_bytes: int = PART_BYTES) -> None:
    """Parts under ``<path>/parts``, the manifest under ``<path>/manifest``."""
    report_parts(rows, group, order, part_bytes=part_bytes).write.parquet(f"{path}/parts")
    report_manifest(rows.sparkSession.read.parquet(f"{path}/parts"), group).write.parquet(f"{path}/manifest")


def read_report_parts(spark: SparkSession, path: str, group: str) -> DataFrame:
    """The parts in reading order: a sorted table, no group in one task."""
    return spark.read.parquet(f"{path}/parts").orderBy(group, "part")
