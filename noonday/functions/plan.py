"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed exactly once.

    Filters are pushed below projections by copying the definitions of the columns they test.  For long definitions
    (dozens of patterns and casts) the copies cost more than the filter saves and can grow past what Spark compiles.
    A one-row generator keeps the definitions below it; it moves no data.
    """
    row = F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.select(row.alias("__row")).select("__row.*")
