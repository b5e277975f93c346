"""One-row results beside the rows of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("one")).scalar()
    wide = df.withColumn("one_row", packed)
    return wide.select(*df.columns, *[F.col(f"one_row.{c}").alias(c) for c in one_row.columns])
