"""Shared scratch tables: the only way the operators cut lineage.

Every intermediate that is read more than once, or whose row order matters, is
written as Parquet below ``spark.checkpoint.dir`` (a folder all executors
share), so a lost executor costs a task and never the whole job. A ``span``
lists what is written inside it; ``tidy`` functions delete all that their
result does not read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_open: ContextVar[list[str] | None] = ContextVar("scratch folders of the open span", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only if the setting is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        root = _own[context.applicationId]
    return root.rstrip("/")


@contextmanager
def span() -> Iterator[list[str]]:
    """The scratch folders written inside; those left at its end also belong to the span around it."""
    made: list[str] = []
    token = _open.set(made)
    try:
        yield made
    finally:
        _open.reset(token)
        around = _open.get()
        if around is not None:
            around += made


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/corvane/{uuid.uuid4().hex}/{name}"
    made = _open.get()
    if made is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, folders: list[str], used_by: DataFrame | None = None) -> None:
    """Delete scratch folders, but for those that ``used_by`` reads; only these stay in the list."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    needed = {x.split("/corvane/")[1].split("/")[0] for x in (used_by.inputFiles() if used_by is not None else ()) if "/corvane/" in x}
    for path in list(folders):
        if path.split("/corvane/")[1].split("/")[0] not in needed:
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(conf).delete(folder, True)
            folders.remove(path)


def tidy(f):
    """Make a function (spark, ...) -> DataFrame delete the scratch tables its result does not read."""

    @wraps(f)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        with span() as made:
            out = f(spark, *args, **options)
            released(spark, made, used_by=out)
        return out

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
