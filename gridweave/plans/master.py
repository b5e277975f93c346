"""Master dataset refresh and training-set preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.clean import deduplicate, union_sources, valid_forecasts
from gridweave.operators.weights import split_by_time, step_weights, weighted_sample
from gridweave.sources.files import latest_forecasts


def refresh_master(
    history: DataFrame, increment: DataFrame, keys: Sequence[str] = ("timestamp", "zone", "resource_name")
) -> DataFrame:
    """History and increment in one table; the last arrival of a key stays."""
    both = union_sources(history, increment)
    return deduplicate(both, keys, ["source_rank", "seq"]).drop("source_rank")


def weighted_training_sets(df: DataFrame, zones: Sequence[str], tie: str, cap: int | None = None, val: float = 0.2) -> DataFrame:
    """Rows of the zones with step weights, split in time order; all of them, or a weighted sample of ``cap`` a zone."""
    rows = step_weights(df.where(F.col("zone").isin(list(zones))).dropna(subset=["zone", "load"]))
    if cap is not None:
        rows = weighted_sample(rows, F.col(tie), tie, cap)
    return split_by_time(rows, 1 - val, tie)


def land_forecasts(rows: DataFrame) -> DataFrame:
    """Parsed forecast rows, validated, latest issue per zone and time."""
    return latest_forecasts(valid_forecasts(rows))
