"""Bounded samples of tables, the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, id_col: str, rows: int, n: int | None = None) -> DataFrame:
    """At most ``rows`` rows, in the order of a hash of the id; all of a smaller table.

    A threshold on the hash first thins the table to about twice as many, so that tasks don't each offer ``rows`` rows.
    """
    n = df.count() if n is None else n
    if n > 4 * rows:
        df = df.filter(F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(n // (2 * rows))) == 0)
    return df.orderBy(F.xxhash64(id_col), id_col).limit(rows)
