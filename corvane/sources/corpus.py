"""Source files as tables: (file, source, n_bytes) and (file, line, text, start_byte)."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import paths
from corvane.query import table

MOST_BYTES, MOST_CONTEXT_BYTES = 1 << 20, 2 << 20


def read_tree(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files below ``root`` that are not in vendor folders and not too large, with mtime."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + re.sub("^[a-z]+:/*", "", root).strip("/") + "/"
    rel = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, -1)
    rows = raw.where(F.col("length") <= most_bytes).select(rel.alias("file"), F.expr("decode(content, 'UTF-8')").alias("source"), F.col("length").alias("n_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"))
    return rows.where(~paths.in_vendor_folder(F.col("file")) & paths.safe_relative(F.col("file")).isNotNull())


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as source files."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    return docs.select(name.alias("file"), F.col("text").alias("source"), F.octet_length("text").cast("long").alias("n_bytes"))


#: the same table in SQL
FILES_SQL = "(SELECT concat_ws('/', source, lang, 'doc_' || doc_id || '.txt') AS file, text AS source, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents)"
LINES_SQL = f"""(SELECT file, CAST(i AS BIGINT) AS line, parts[i] AS text FROM
    (SELECT file, string_split(source, chr(10)) AS parts FROM {FILES_SQL}), unnest(range(1, len(parts) + 1)) AS r(i))"""


def lines(files: DataFrame) -> DataFrame:
    """One row per physical line, from 1, without its end; ``start_byte`` is its place in the file."""
    rows = files.select("file", F.posexplode(F.split("source", "\n")).alias("p", "raw"))
    w = Window.partitionBy("file").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw") + 1).over(w), F.lit(0)).cast("long")
    return rows.select("file", (F.col("p") + 1).cast("long").alias("line"), F.regexp_replace("raw", r"\r$", "").alias("text"), start.alias("start_byte"))


def plain_lines(files: DataFrame) -> DataFrame:
    """lines() without byte places: no window, so no shuffle."""
    rows = files.select("file", F.posexplode(F.split("source", "\n")).alias("p", "raw"))
    return rows.select("file", (F.col("p") + 1).cast("long").alias("line"), F.regexp_replace("raw", r"\r$", "").alias("text"))


def context_lines(files: DataFrame, wanted: DataFrame, most_bytes: int = MOST_CONTEXT_BYTES) -> DataFrame:
    """Lines of the ranges (file, start, end) of files that are inside the root and not too large."""
    ok = files.where((F.col("n_bytes") <= most_bytes) & paths.safe_relative(F.col("file")).isNotNull())
    return plain_lines(ok).join(wanted, "file").where("line between start and end").select("file", "line", "text").distinct()


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(paths.extension(F.col("file")).alias("extension")).agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder that all executors see."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, root: str) -> list[dict]:
    """What was published, oldest first; each has its number."""
    fs, folder = _folder(spark, f"{root}/pointers")
    if not fs.exists(folder):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json"))
    out = []
    for name in names:
        stream = fs.open(_folder(spark, f"{root}/pointers/{name}")[1])
        out.append(json.loads(bytes(stream.readAllBytes()).decode()))
        stream.close()
    return out


def publish(spark: SparkSession, root: str, version: str, parts: dict[str, str], epoch: int = -1, keep: int = 2) -> None:
    """Point to a new set of data folders; the pointer appears whole, under the next number, or not at all.

    Of older versions ``keep`` - 1 stay for readers that are under way; data that no pointer names is deleted.
    """
    known = _pointers(spark, root)
    n = known[-1]["n"] + 1 if known else 0
    now = {"n": n, "version": version, "epoch": epoch, "parts": parts}
    fs, draft = _folder(spark, f"{root}/pointers/.{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(json.dumps(now).encode()))
    stream.close()
    if not fs.rename(draft, _folder(spark, f"{root}/pointers/{n:012d}.json")[1]):
        raise ValueError("another writer published at the same time")
    staying = [*known, now][-keep:]
    used = {name for x in staying for name in x["parts"].values()}
    for old in known[: -(keep - 1) or None]:
        for name in set(old["parts"].values()) - used:
            fs.delete(_folder(spark, f"{root}/data/{name}")[1], True)
        fs.delete(_folder(spark, f"{root}/pointers/{old['n']:012d}.json")[1], False)


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Write a new version beside the old ones, then point to it; readers never see half a table."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{name}")
    publish(df.sparkSession, root, version, {"all": name})
    return name


def latest(spark: SparkSession, root: str, version: str) -> dict | None:
    return next((x for x in reversed(_pointers(spark, root)) if x["version"] == version), None)


def read_snapshot(spark: SparkSession, root: str, version: str) -> DataFrame | None:
    """The newest snapshot of this version; None if there is none."""
    now = latest(spark, root, version)
    return read_parts(spark, root, now["parts"]) if now else None


def read_parts(spark: SparkSession, root: str, parts: dict[str, str]) -> DataFrame | None:
    """The rows of data folders; a part named by a number is that bucket of its folder."""
    folders = [f"{root}/data/{name}" + ("" if key == "all" else f"/__bucket={key}") for key, name in sorted(parts.items())]
    return spark.read.parquet(*folders) if folders else None


def append_trace(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
