"""Python modules made from the part table: every part is a small file that imports others.

The expressions below are SQL that Spark and DuckDB read alike, so a query and
its SQL start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.query import table
from corvane.scratch import dealt, large

_NL = "chr(10)"
_N = "p_partkey"
_HALF = f"CAST(floor({_N} / 2) AS BIGINT)"
#: modules in blocks of 32, of which the first 15 pass ``shared`` on, each to two others
_GIVER = f"({_N} - {_N} % 32 + CAST(floor({_N} % 32 / 2) AS BIGINT))"
#: which file a part is
FILE = f"concat('pkg/m', {_N}, '.py')"
#: a module imports from the module of half its number, under an alias if divisible by 3, and a class from one of
#: ten; some names do not exist; every 13th does not parse
SOURCE = f"""concat(
    'from pkg.m', {_HALF}, ' import f', {_HALF}, CASE WHEN {_N} % 3 = 0 THEN concat(' as g', {_HALF}) ELSE '' END, {_NL},
    CASE WHEN {_N} % 11 = 0 THEN concat('from .gone', {_N}, ' import lost') ELSE concat('from .m', {_N} % 10, ' import C', {_N} % 10) END, {_NL},
    CASE WHEN {_N} % 32 BETWEEN 1 AND 14 THEN concat('from pkg.m', {_GIVER}, ' import shared', CASE WHEN {_N} % 5 = 4 THEN ' as mine' ELSE '' END, {_NL}) ELSE '' END,
    'import os', {_NL}, {_NL}, '# module ', {_N}, {_NL},
    'def f', {_N}, '(x, y):', {_NL}, '    if x > ', {_N} % 5, ':', {_NL},
    '        return ', CASE WHEN {_N} % 3 = 0 THEN 'g' ELSE 'f' END, {_HALF}, '(x, y)', {_NL},
    CASE WHEN {_N} % 2 = 0 THEN concat('    for i in range(y):', {_NL}, '        x = i', {_NL}) ELSE '' END,
    '    return C', {_N} % 10, '(y)', {_NL}, {_NL},
    'class C', {_N}, ':', {_NL}, '    def run(self):', {_NL}, '        return f', {_N}, '(1, 2)', {_NL}, {_NL},
    'K', {_N}, ' = ', {_N}, {_NL}, CASE WHEN {_N} % 13 = 0 THEN concat('def broken(:', {_NL}) ELSE '' END)"""

#: the same tables in SQL: (n, file, source) and (n, file, line, text)
MODULES_SQL = f"(SELECT {_N} AS n, {FILE} AS file, {SOURCE} AS source FROM part)"
LINES_SQL = f"(SELECT n, file, CAST(i AS BIGINT) AS line, parts[i] AS text FROM (SELECT n, file, string_split(source, chr(10)) AS parts FROM {MODULES_SQL}), unnest(range(1, len(parts) + 1)) AS r(i))"


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, file, source, n_bytes), dealt by file: the part table is small, the texts and what is read of them are not."""
    rows = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey"), F.expr(FILE).alias("file")), "file")
    rows = rows.select(F.col("p_partkey").alias("n"), "file", F.expr(SOURCE).alias("source"))
    return large(rows.withColumn("n_bytes", F.octet_length("source").cast("long")))
