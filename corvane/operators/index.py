"""The import index, kept up to date by the buckets that an edit touches.

Resolved imports lie in buckets by importer; the paths that each import may mean
lie in buckets by path. So a file that comes or goes leads to the imports that
may mean it without a look at the others. An update parses changed files only,
resolves their imports and those so found anew, rewrites the buckets of these
importers and paths, and publishes one new list of buckets; all others stay
where they are and are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import imports, paths
from corvane.operators import graph
from corvane.scratch import kept
from corvane.sources import corpus

BUCKETS = 64
IMPORTS = "file string, line bigint, kind string, spec string, local array<string>, source array<string>, target string, status string"
TRIES = "path string, file string"


def bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, parts: dict[str, str], kind: str, schema: str, only: set[int] | None = None) -> DataFrame:
    """The rows of one kind, of all buckets or some."""
    folders = [f"{root}/data/{name}/__bucket={key[1:]}" for key, name in sorted(parts.items()) if key[0] == kind and (only is None or int(key[1:]) in only)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _write(df: DataFrame, root: str, kind: str, by: str, buckets: int) -> dict[str, str]:
    """Rows written by bucket: the buckets that have any, and their folder."""
    name = uuid.uuid4().hex
    rows = kept(df.withColumn("__bucket", bucket(F.col(by), buckets)))
    rows.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{root}/data/{name}")
    return {f"{kind}{r[0]}": name for r in rows.select("__bucket").distinct().collect()}  # at most ``buckets`` rows


def _buckets_of(df: DataFrame, column: str, buckets: int) -> set[int]:
    return {r[0] for r in df.select(bucket(F.col(column), buckets).alias("b")).distinct().collect()}  # at most ``buckets`` rows


def _tries(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(paths.targets(F.col("kind"), F.col("file"), F.col("spec"))).alias("path"), "file").distinct()


def _resolved(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    return graph.resolved(rows, inventory).select(*(x.split()[0] for x in IMPORTS.split(", ")))


def build(files: DataFrame, root: str, version: str, buckets: int = BUCKETS) -> None:
    """Index (file, source, ...) from nothing."""
    rows = kept(imports.all_imports(files, corpus.plain_lines(files)))
    parts = _write(_resolved(rows, files), root, "i", "file", buckets) | _write(_tries(rows), root, "t", "path", buckets)
    corpus.publish(files.sparkSession, root, version, parts)


def read(spark: SparkSession, root: str, version: str) -> DataFrame | None:
    """The resolved imports of the newest index; None if there is none."""
    now = corpus.latest(spark, root, version)
    return _read(spark, root, now["parts"], "i", IMPORTS) if now else None


def update(old: DataFrame, files: DataFrame, root: str, version: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Bring the index of ``old`` (file, n_bytes, mtime_ms) to ``files`` (file, n_bytes, mtime_ms, source).

    Returns how many files were parsed and how many buckets of each kind were
    rewritten. An index that does not exist is built.
    """
    spark = files.sparkSession
    now = corpus.latest(spark, root, version)
    if now is None:
        build(files, root, version, buckets)
        return {"parsed": files.count(), "imports": buckets, "paths": buckets}
    parts = now["parts"]
    plan = kept(graph.refresh_plan(old, files))
    changed, removed = plan.where("action = 'reindex'").select("file"), plan.where("action = 'remove'").select("file")
    added = changed.join(old.select("file"), "file", "left_anti")
    moved = kept(added.union(removed).select(F.col("file").alias("path")))
    may = _read(spark, root, parts, "t", TRIES, _buckets_of(moved, "path", buckets))
    again = kept(may.join(moved, "path", "left_semi").select("file").distinct().join(changed.union(removed), "file", "left_anti"))
    fresh = kept(imports.all_imports(x := files.join(changed, "file", "left_semi"), corpus.plain_lines(x)))
    # importers: those that changed, and those that may mean a file that came or went
    dirty = kept(reduce(DataFrame.union, (changed, removed, again)).distinct())
    here = _buckets_of(dirty, "file", buckets)
    before = _read(spark, root, parts, "i", IMPORTS, here)
    redo = before.join(again, "file", "left_semi").drop("target", "status").unionByName(fresh)
    rows = before.join(dirty, "file", "left_anti").unionByName(_resolved(redo, files.select("file")))
    # paths: those of the imports that changed files had, and have now
    mine = changed.union(removed)
    there = _buckets_of(kept(_tries(before.join(mine, "file", "left_semi")).union(_tries(fresh))), "path", buckets)
    tries = _read(spark, root, parts, "t", TRIES, there).join(mine, "file", "left_anti").unionByName(_tries(fresh))
    touched = {f"i{b}" for b in here} | {f"t{b}" for b in there}
    new = {k: v for k, v in parts.items() if k not in touched} | _write(rows, root, "i", "file", buckets) | _write(tries, root, "t", "path", buckets)
    corpus.publish(spark, root, version, new)
    return {"parsed": changed.count(), "imports": len(here), "paths": len(there)}
