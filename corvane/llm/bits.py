"""Bitmaps of fixed size over 64-bit keys: a bounded broadcast that spares rows a shuffle.

A clear bit proves that a key is absent; a set bit proves nothing, so every use
is followed by an exact join. However many keys there are, the bitmap has
2**BITS bits; with many more keys it spares less, and results stay the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


def bitmap(df: DataFrame, key: Column, bits: int = BITS) -> np.ndarray:
    """Words of the bitmap of ``key``; at most 2**(bits - 6) rows come to the driver."""
    place = key.bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = df.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def test(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def hit(words_broadcast, key: Column) -> Column:
    """Whether the bit of ``key`` is set, on the executors."""
    import pandas as pd

    def probe(keys):
        return pd.Series(test(words_broadcast.value, keys.to_numpy(np.int64)))

    probe.__annotations__ = {"keys": pd.Series, "return": pd.Series}
    return F.pandas_udf(probe, "boolean")(key)
