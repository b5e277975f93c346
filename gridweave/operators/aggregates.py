"""Resampling, weighted averages, profiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.catalog import LOAD_WEIGHTS, lookup
from gridweave.core.scalars import beside
from gridweave.core.quantiles import group_quantiles, with_quantiles
from gridweave.core.series import join_keys
from gridweave.functions.expr import flag
from gridweave.operators.windows import STATS, gap_report
from gridweave.session import stored


def hourly_spine(df: DataFrame, keys: Sequence[str] = ("zone",), ts: str = "timestamp") -> DataFrame:
    """Every hour between the first and last row of a series, spread day by day."""
    hour = F.date_trunc("hour", ts)
    span = stored(df.groupBy(*keys).agg(F.min(hour).alias("_a"), F.max(hour).alias("_b")))
    days = span.withColumn(
        "_day", F.explode(F.sequence(F.date_trunc("day", "_a"), F.date_trunc("day", "_b"), F.expr("interval 1 day")))
    )
    hours = days.withColumn(
        ts,
        F.explode(F.sequence("_day", F.col("_day") + F.expr("interval 23 hours"), F.expr("interval 1 hour"))),
    )
    return hours.where((F.col(ts) >= F.col("_a")) & (F.col(ts) <= F.col("_b"))).select(*keys, ts)


def hourly_mean(df: DataFrame, value: str = "load", keys: Sequence[str] = ("zone",), ts: str = "timestamp") -> DataFrame:
    """Mean per series and hour; empty hours are rows with null."""
    means = df.groupBy(*keys, F.date_trunc("hour", ts).alias(ts)).agg(F.avg(value).alias(value))
    return join_keys(hourly_spine(df, keys, ts), means, [*keys, ts], "left")


def weighted_average(
    df: DataFrame, weights: DataFrame, values: Sequence[str], by: Sequence[str] = ("timestamp",), strict: bool = True
) -> DataFrame:
    """Weighted mean over zones, renormalised over those present; ``strict`` rejects unknown zones."""
    joined = df.join(stored(weights), "zone", "left")
    w = F.col("weight")
    if strict:
        w = F.when(w.isNotNull(), w).otherwise(
            F.raise_error(F.concat(F.lit("unknown zone "), F.coalesce("zone", F.lit("null")))).cast("double")
        )
    aggs = []
    for c in values:
        present = F.when(F.col(c).isNotNull(), w)
        aggs.append(F.try_divide(F.sum(F.col(c) * w), F.sum(present)).alias(c))
    return joined.groupBy(*by).agg(*aggs)


def simple_average(df: DataFrame, values: Sequence[str], by: Sequence[str] = ("timestamp",)) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in values])


def dataset_profile(df: DataFrame, value: str = "load", ts: str = "timestamp") -> DataFrame:
    """One row: size, span, zones, nulls and the description of the value."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    base = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.countDistinct("zone").alias("n_zones"),
        F.count(value).alias("value_count"),
        F.avg(value).alias("value_mean"),
        F.stddev_samp(value).alias("value_std"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        *nulls,
    )
    quarts = group_quantiles(df, [], {"value_p25": (value, 0.25), "value_p50": (value, 0.5), "value_p75": (value, 0.75)})
    return beside(base, quarts)


def zone_shares(df: DataFrame) -> DataFrame:
    """Rows per zone and their share."""
    counts = stored(df.groupBy("zone").agg(F.count(F.lit(1)).alias("n_rows")))
    total = counts.agg(F.sum("n_rows").alias("_all"))
    return beside(counts, total).select("zone", "n_rows", (F.col("n_rows") / F.col("_all")).alias("share"))


def zone_summary(df: DataFrame, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Latest, mean and peak load, weight (0.1 where none) and the 1.05 x current guess."""
    return (
        df.groupBy("zone")
        .agg(
            F.max_by("load", F.struct(*order)).alias("current_load"),
            F.avg("load").alias("avg_load"),
            F.max("load").alias("peak_load"),
        )
        .withColumns(
            {
                "predicted_load": F.col("current_load") * 1.05,
                "load_weight": lookup(LOAD_WEIGHTS, F.col("zone"), 0.1),
            }
        )
    )


def seasonal_profile(df: DataFrame) -> DataFrame:
    """Months and years covered and the spread of monthly means per zone."""
    monthly = df.groupBy("zone", F.month("timestamp").alias("month")).agg(
        F.avg("load").alias("m"), F.collect_set(F.year("timestamp")).alias("years")
    )
    return monthly.groupBy("zone").agg(
        F.count("month").alias("months_covered"),
        F.size(F.array_distinct(F.flatten(F.collect_list("years")))).alias("years_covered"),
        ((F.max("m") - F.min("m")) / F.avg("m") * 100).alias("seasonal_variation_pct"),
    )


def load_profile(df: DataFrame, part: Column, name: str, value: str = "load") -> DataFrame:
    """Mean value per zone and part of the day or week."""
    return df.groupBy("zone", part.alias(name)).agg(F.avg(value).alias(f"mean_{value}"))


def peak_and_valley(df: DataFrame) -> DataFrame:
    """Hour of the highest and lowest mean load per zone."""
    hourly = load_profile(df, F.hour("timestamp"), "hour")
    return hourly.groupBy("zone").agg(
        F.max_by("hour", F.struct("mean_load", -F.col("hour"))).alias("peak_hour"),
        F.min_by("hour", F.struct("mean_load", "hour")).alias("valley_hour"),
    )


def temperature_response(df: DataFrame, bins: int = 15) -> DataFrame:
    """Mean load and degree hours per equal-width temperature bin (right-closed, lowest included)."""
    span = stored(df.agg(F.min("temp_c").alias("_lo"), F.max("temp_c").alias("_hi")))
    t = F.col("temp_c")
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = beside(df, span).withColumn(
        "temp_bin", F.greatest(F.ceil(F.try_divide(t - F.col("_lo"), width)) - 1, F.lit(0)).cast("int")
    )
    return binned.where(t.isNotNull()).groupBy("temp_bin").agg(
        F.avg(t).alias("mean_temp"),
        F.avg("load").alias("mean_load"),
        F.avg(F.greatest(t - 18, F.lit(0.0))).alias("mean_cooling"),
        F.avg(F.greatest(18 - t, F.lit(0.0))).alias("mean_heating"),
    )


def balance_temperature(df: DataFrame, bins: int = 15) -> DataFrame:
    """Bin with the lowest mean load, and mean load on hot, mild and cold rows."""
    best = temperature_response(df, bins).agg(
        F.min_by("mean_temp", F.struct("mean_load", "temp_bin")).alias("balance_temp"),
        F.min("mean_load").alias("min_mean_load"),
    )
    t = F.col("temp_c")
    bands = df.agg(
        F.avg(F.when(t > 25, F.col("load"))).alias("hot_load"),
        F.avg(F.when(t < 10, F.col("load"))).alias("cold_load"),
        F.avg(F.when(t.between(15, 20), F.col("load"))).alias("mild_load"),
    )
    return beside(best, bands)


def collection_summary(expected: DataFrame, collected: DataFrame) -> DataFrame:
    """Zones that delivered, zones that did not, rows and longest horizon."""
    per_zone = collected.groupBy("zone").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("forecast_horizon_hours").alias("_h")
    )
    return expected.join(per_zone, "zone", "left").agg(
        F.count(F.lit(1)).alias("zones_attempted"),
        F.count("_rows").alias("zones_successful"),
        F.count_if(F.col("_rows").isNull()).alias("zones_failed"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_forecasts"),
        F.coalesce(F.max("_h"), F.lit(0)).alias("forecast_horizon_hours"),
    )


def zone_extremes(df: DataFrame) -> DataFrame:
    """Peak, minimum, mean and spread of the load per zone."""
    return df.groupBy("zone").agg(
        F.max("load").alias("peak_load"),
        F.min("load").alias("min_load"),
        F.avg("load").alias("avg_load"),
        F.stddev_samp("load").alias("load_std"),
    )


def duplicate_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier row, as whole rows and by key; copies combine before the shuffle."""
    total = F.sum(F.col("_c") - 1)
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c")).agg(total.alias("duplicate_rows"))
    by_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).agg(total.alias("duplicate_keys"))
    return beside(whole, by_key)
