"""A bitmap of fixed size that says which rows can't have one of a set of ids, so that only the others need a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bitmap has so many bits however many ids there are. With very many ids most bits are set, and more rows than
#: need be go through the join; the result is the same.
BITS = 1 << 25


def _bit(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def sieve(ids: DataFrame) -> np.ndarray:
    """The bitmap of a table with one column; 4 MB go to the driver at most."""
    bit = _bit(F.col(ids.columns[0]))
    words = (
        ids.select(bit.alias("b"))
        .groupBy(F.shiftright("b", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits"))
    )
    found = words.toPandas()
    bitmap = np.zeros(BITS // 64, np.uint64)
    bitmap[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def possible(bitmap: np.ndarray, column: Column) -> Column:
    """Whether the id may be one of those of the bitmap; False is certain."""

    @F.pandas_udf("boolean")
    def test(bit: pd.Series) -> pd.Series:
        b = bit.to_numpy(np.int64)
        return pd.Series((bitmap[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return test(_bit(column))
