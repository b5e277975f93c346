"""Forecast errors, bounded forecasts, ensembles and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.catalog import SCALE_FACTOR, lookup
from gridweave.operators.joins import asof_join
from gridweave.session import stored

HORIZONS = (1, 6, 12, 24)


def historical_errors(
    history: DataFrame, forecast: DataFrame, horizons: Sequence[int] = HORIZONS, default: float = 20.0, cap: float = 50.0
) -> DataFrame:
    """MAPE per zone and horizon of the forecast in force (at most 1 h old), capped at 50.

    Zones and horizons with ten or fewer complete matches get the default.
    """
    want = history.select("zone", "timestamp", F.col("temp_c").alias("actual")).withColumn(
        "forecast_horizon_hours", F.explode(F.array(*[F.lit(h) for h in horizons]))
    )
    have = forecast.select("zone", "forecast_horizon_hours", "timestamp", F.col("temp_c").alias("predicted"))
    hit = asof_join(want, have, keys=("zone", "forecast_horizon_hours"), tolerance_seconds=3600)
    ape = F.abs(F.try_divide(F.col("actual") - F.col("predicted"), F.col("actual"))) * 100
    complete = F.col("actual").isNotNull() & F.col("predicted").isNotNull()
    out = hit.groupBy("zone", "forecast_horizon_hours").agg(F.count_if(complete).alias("n_matches"), F.avg(ape).alias("m"))
    error = F.when(F.col("n_matches") > 10, F.least(F.col("m"), F.lit(cap))).otherwise(F.lit(default))
    return out.select("zone", "forecast_horizon_hours", "n_matches", error.alias("error_pct"))


def bounded_forecasts(forecast: DataFrame, errors: DataFrame, buffer: float = 0.15) -> DataFrame:
    """Forecast rows with lower and upper value from the historical error, and the confidence."""
    out = forecast.join(stored(errors), ["zone", "forecast_horizon_hours"], "left")
    error = F.coalesce("error_pct", F.lit(20.0))
    half = F.col("temp_c") * error / 100 * buffer
    return out.withColumns(
        {
            "temp_lower": F.col("temp_c") - half,
            "temp_upper": F.col("temp_c") + half,
            "confidence": F.greatest(1 - error / 100, F.lit(0.0)),
            "uncertainty": error,
        }
    )


def safe_forecast_features(
    history: DataFrame,
    forecast: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    buffer: float = 0.15,
    max_weight: float = 0.3,
) -> DataFrame:
    """History with the blended forecast, confidence and uncertainty of each horizon as columns.

    One row per zone and time: the latest forecast at or before the row counts.
    """
    errors = stored(historical_errors(history, forecast, horizons))
    fc = bounded_forecasts(forecast, errors, buffer)
    aggs = []
    for h in horizons:
        at = F.col("forecast_horizon_hours") == h
        for src, name in (("temp_c", "temp_forecast"), ("confidence", "forecast_confidence"), ("uncertainty", "forecast_uncertainty")):
            aggs.append(F.max(F.when(at, F.col(src))).alias(f"{name}_{h}h"))
    wide = fc.groupBy("zone", "timestamp").agg(*aggs)
    out = asof_join(history, wide)
    blend = {
        f"temp_forecast_weighted_{h}h": (1 - max_weight) * F.col("temp_c") + max_weight * F.col(f"temp_forecast_{h}h")
        for h in horizons
    }
    return out.withColumns(blend)


# Ensemble weights over (baseline, enhanced, third model) or two models.
ENSEMBLES = {
    "service": {"baseline": 0.25, "enhanced": 0.35, "third": 0.40},
    "refresh": {"baseline": 0.20, "enhanced": 0.40, "third": 0.40},
    "production": {"enhanced": 0.60, "third": 0.40},
    "strong_evening": {"enhanced": 0.45, "third": 0.55},
    "better_enhanced": {"enhanced": 0.65, "third": 0.35},
}


def ensemble(weights: dict[str, float], clip_to: tuple[float, float] | None = None) -> Column:
    """Weighted mean over the models that have a prediction."""
    total = sum((F.when(F.col(m).isNotNull(), F.lit(w)).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in weights.items()), F.lit(0.0))
    out = F.when(total > 0, value / total)
    if clip_to:
        out = F.when(out.isNotNull(), F.least(F.greatest(out, F.lit(float(clip_to[0]))), F.lit(float(clip_to[1]))))
    return out


def chosen_ensemble(evening_errors: DataFrame) -> DataFrame:
    """0.65 / 0.35 where the enhanced model has the lower evening MAPE, else 0.45 / 0.55."""
    better = F.col("enhanced_mape") < F.col("third_mape")
    return evening_errors.withColumns(
        {"enhanced_weight": F.when(better, 0.65).otherwise(0.45), "third_weight": F.when(better, 0.35).otherwise(0.55)}
    )


def pick_model(choice: str) -> Column:
    """Prediction of the chosen model with its fallback chain."""
    chains = {"baseline": ["baseline"], "enhanced": ["enhanced", "baseline"], "third": ["third", "enhanced", "baseline"]}
    return F.coalesce(*[F.col(c) for c in chains.get(choice, chains["enhanced"])])


def fixed_band(df: DataFrame, value: str, error: float = 400.0) -> DataFrame:
    """± 400 MW band and the demand level (high above 35 GW, moderate above 30 GW)."""
    v = F.col(value)
    return df.withColumns(
        {
            "lower_bound": v - error,
            "upper_bound": v + error,
            "share_lower": v - v * 0.05,
            "share_upper": v + v * 0.05,
            "demand_level": F.when(v > 35000, "high").when(v > 30000, "moderate").otherwise("normal"),
        }
    )


def level_bands(df: DataFrame, value: str, levels: Sequence[float] = (0.68, 0.95)) -> DataFrame:
    """One row per confidence level with ± 10 % x level / 0.95."""
    out = df.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    half = F.col(value) * 0.10 * (F.col("level") / 0.95)
    return out.withColumns({"lower": F.col(value) - half, "upper": F.col(value) + half})


def improvement_pct(enhanced: str = "enhanced", baseline: str = "baseline") -> Column:
    return F.try_divide(F.col(enhanced) - F.col(baseline), F.col(baseline)) * 100


def scaled_chart(df: DataFrame, zones: Sequence[str]) -> DataFrame:
    """System chart scaled to each zone by its share of the load."""
    out = df.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in zones])))
    f = lookup(SCALE_FACTOR, F.col("zone"), 0.1)
    return out.withColumns({"actual_load": F.col("actual_load") * f, "predicted_load": F.col("predicted_load") * f})
