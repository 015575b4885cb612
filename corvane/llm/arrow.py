"""Row-wise Python over Arrow batches, with the input's columns carried along."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from corvane.ship import ship

#: texts of one Arrow batch worked on at once, in bytes, unless one text is longer
SLICE_BYTES = 1 << 20


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fields(ddl: str) -> list[StructField]:
    return list(_parse_datatype_string(ddl))


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], list[list] | tuple[list[list], list[bool]]]],
    ddl: str,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    only: bool = False,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """``keep`` columns of ``df`` with columns computed from whole texts.

    ``make()`` runs once a task and returns a function from a list of texts
    (bytes or None) to one list per column of ``ddl``. With ``only``, that
    function also returns which rows stay. The ``extra`` columns are passed to it
    as further lists. An input column with the name of a
    computed one is superseded by it.
    """
    ship(df.sparkSession)
    new = fields(ddl) if ddl else []
    names = {f.name for f in new}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = StructType([df.schema[c] for c in keep] + new)
    need = list(dict.fromkeys([*keep, text, *extra]))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        work, kinds = make(), [to_arrow_type(f.dataType) for f in new]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for part, values in slices(batch, texts):
                out = work(values, *(part.column(part.schema.get_field_index(c)).to_pylist() for c in extra))
                out, stay = out if only else (out, None)
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                cols += [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
                done = pa.RecordBatch.from_arrays(cols, names=[*keep, *(f.name for f in new)])
                yield done if stay is None else done.filter(pa.array(stay, pa.bool_()))

    return df.select(*(f"`{c}`" for c in need)).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, texts: pa.Array):
    """Parts of a batch whose texts have about SLICE_BYTES together."""
    binary = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    at, size, values = 0, 0, []
    for i, x in enumerate(binary):
        x = x.as_py()
        values.append(x)
        size += len(x or b"")
        if size >= SLICE_BYTES:
            yield batch.slice(at, i + 1 - at), values
            at, size, values = i + 1, 0, []
    if values:
        yield batch.slice(at), values
