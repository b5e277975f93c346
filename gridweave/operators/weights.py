"""Sample weights, splits and samples for training."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.core.series import join_keys, series, with_position
from gridweave.functions.expr import flag
from gridweave.session import stored


def with_latest(df: DataFrame, keys: Sequence[str] = ("zone",), ts: str = "timestamp") -> DataFrame:
    latest = stored(df.groupBy(*keys).agg(F.max(ts).alias("latest_ts")))
    return join_keys(df, latest, list(keys), "left")


def _since(days: int) -> Column:
    return F.col("timestamp") >= F.col("latest_ts") - F.make_dt_interval(days=F.lit(days))


def step_weights(df: DataFrame) -> DataFrame:
    """Recency steps 3 / 2 / 1.5 / 1 at 30 / 90 / 180 days times time of day 2.5 / 1.5 / 1."""
    df = with_latest(df)
    hour = F.hour("timestamp")
    recency = F.when(_since(30), 3.0).when(_since(90), 2.0).when(_since(180), 1.5).otherwise(1.0)
    part = F.when(hour.between(17, 21), 2.5).when(hour.between(14, 16), 1.5).otherwise(1.0)
    return df.withColumns(
        {"temporal_weight": recency, "time_of_day_weight": part, "sample_weight": recency * part}
    ).drop("latest_ts")


def decay_weights(df: DataFrame, recent: float = 5.0, evening: float = 3.0, factor: float = 1.0) -> DataFrame:
    """exp(-days / 365) x evening factor, scaled to mean 1 per zone."""
    df = with_latest(df)
    days = F.floor((F.unix_micros("latest_ts") - F.unix_micros("timestamp")) / 86_400_000_000)
    df = df.withColumns(
        {
            "days_from_latest": days,
            "recency_weight": F.exp(-days / 365.0) * recent,
            "evening_weight": F.when(F.hour("timestamp").between(17, 21), evening).otherwise(1.0),
        }
    )
    df = df.withColumn("raw_weight", F.col("recency_weight") * F.col("evening_weight") * factor)
    mean = stored(df.groupBy("zone").agg(F.avg("raw_weight").alias("mean_weight")))
    df = join_keys(df, mean, ["zone"], "left")
    return df.withColumn("sample_weight", F.col("raw_weight") / F.col("mean_weight")).drop(
        "raw_weight", "mean_weight", "latest_ts"
    )


def two_level_weights(df: DataFrame, days: int = 60, recent: float = 2.0, evening: float = 2.0) -> DataFrame:
    """Last days x 2, evening hours x 2."""
    df = with_latest(df)
    r = F.when(_since(days), recent).otherwise(1.0)
    e = F.when(F.hour("timestamp").between(17, 21), evening).otherwise(1.0)
    return df.withColumns({"recency_weight": r, "evening_weight": e, "sample_weight": r * e}).drop("latest_ts")


def weighting_impact(df: DataFrame) -> DataFrame:
    """Share of evening and recent rows, and of their weight, per zone."""
    df = with_latest(df)
    evening, late, w = F.hour("timestamp").between(17, 21), _since(30), F.col("sample_weight")
    share = lambda c: F.avg(flag(c).cast("double")) * 100
    weight = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0)) / F.sum(w) * 100
    return df.groupBy("zone").agg(
        share(evening).alias("evening_samples_pct"),
        weight(evening).alias("evening_weight_pct"),
        share(late).alias("recent_samples_pct"),
        weight(late).alias("recent_weight_pct"),
        (F.max(w) / F.min(w)).alias("weight_amplification"),
    )


def hybrid_training_rows(
    df: DataFrame, core_days: int = 24 * 30, fallback_days: int = 365, recent_days: int = 6 * 30, recent_weight: float = 2.0
) -> DataFrame:
    """Rows of the core window; zones covering fewer than 12 months take the fallback window."""
    df = with_latest(df)
    months = stored(
        df.where(_since(core_days)).groupBy("zone").agg(F.countDistinct(F.month("timestamp")).alias("months"))
    )
    df = join_keys(df, months, ["zone"], "left")
    kept = df.where(F.when(F.col("months") < 12, _since(fallback_days)).otherwise(_since(core_days)))
    weight = F.when(_since(recent_days), recent_weight).otherwise(1.0)
    return kept.withColumn("sample_weight", weight).drop("latest_ts", "months")


def hash_order(key: Column, seed: int) -> Column:
    """A repeatable random order: the hash of the row's key and the seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_share(key: Column, seed: int) -> Column:
    """Uniform number in (0, 1] from the same hash."""
    head = F.conv(F.substring(hash_order(key, seed), 1, 12), 16, 10).cast("double")
    return (head + 1) / float(16**12)


def ranked_by_hash(df: DataFrame, key: Column, seed: int, keys: Sequence[str], tie: str) -> DataFrame:
    """Position of each row in the hash order of its group (``hash_pos``) and the group size."""
    df = df.withColumn("hash_key", hash_order(key, seed))
    return with_position(df, "hash_pos", "hash_n", keys=keys, order=("hash_key", tie)).drop("hash_key")


def month_split(df: DataFrame, key: Column, tie: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Validation label for int(share x n) random rows of each zone and month."""
    df = df.withColumn("split_month", F.month("timestamp"))
    df = ranked_by_hash(df, key, seed, ["zone", "split_month"], tie)
    val = F.col("hash_pos") < F.floor(F.col("hash_n") * share + 1e-9)
    return df.withColumn("split", F.when(val, "val").otherwise("train")).drop("hash_pos", "hash_n", "split_month")


def shuffled_split(df: DataFrame, key: Column, tie: str, test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Random train / validation / test rows per zone: test first, then validation from the rest."""
    df = ranked_by_hash(df, key, seed, ["zone"], tie)
    n, at = F.col("hash_n"), F.col("hash_pos")
    n_test = F.ceil(n * test - 1e-9)
    n_val = F.ceil((n - n_test) * val - 1e-9)
    label = F.when(at < n_test, "test").when(at < n_test + n_val, "val").otherwise("train")
    return df.withColumn("split", label).drop("hash_pos", "hash_n")


def weighted_sample(
    df: DataFrame, key: Column, tie: str, cap: int, weight: str = "sample_weight", seed: int = 42
) -> DataFrame:
    """At most ``cap`` rows per zone drawn without replacement by weight: smallest -ln(u) / w."""
    df = df.withColumn("draw", -F.log(hash_share(key, seed)) / F.col(weight))
    df = with_position(df, "draw_pos", None, keys=["zone"], order=("draw", tie))
    return df.where(F.col("draw_pos") < cap).drop("draw", "draw_pos")


def recent_evening_counts(df: DataFrame, days: int = 60) -> DataFrame:
    """Rows of the last days in evening hours per zone."""
    df = with_latest(df)
    hit = _since(days) & F.hour("timestamp").between(17, 21)
    return df.groupBy("zone").agg(F.count_if(hit).alias("recent_evening_rows"))


def split_by_time(df: DataFrame, share: float, tie: str) -> DataFrame:
    """First int(share x n) rows of a zone are train, the rest val."""
    df = with_position(df, "time_pos", "time_n", order=("timestamp", tie))
    train = F.col("time_pos") < F.floor(F.col("time_n") * share + 1e-9)
    return df.withColumn("split", F.when(train, "train").otherwise("val")).drop("time_pos", "time_n")
