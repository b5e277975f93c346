"""Weather features and forecast features that need no window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.expr import above, flag, hour_in

BASE_C = 18.0


def _have(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def degree_days(temp: str = "temp_c", base: float = BASE_C, unit: str = "days") -> dict[str, Column]:
    t = F.col(temp)
    return {
        f"cooling_degree_{unit}": above(t - base, 0.0),
        f"heating_degree_{unit}": above(F.lit(base) - t, 0.0),
    }


def weather_features(df: DataFrame) -> DataFrame:
    """temp squared, degree days, temp x humidity / 100, wind chill; only what the inputs allow."""
    t = F.col("temp_c")
    cols: dict[str, Column] = {}
    if _have(df, "temp_c"):
        cols |= {"temp_c_squared": t * t, **degree_days()}
    if _have(df, "temp_c", "humidity"):
        cols["temp_humidity_interaction"] = t * F.col("humidity") / 100
    if _have(df, "temp_c", "wind_speed"):
        cols["wind_chill_effect"] = t - F.col("wind_speed") * 0.5
    return df.withColumns(cols) if cols else df


def historical_weather_features(df: DataFrame) -> DataFrame:
    """Squares of temperature, humidity and wind, degree days."""
    cols: dict[str, Column] = {}
    if _have(df, "temp_c"):
        cols |= {"temp_c_squared": F.col("temp_c") * F.col("temp_c"), **degree_days()}
    if _have(df, "humidity"):
        cols["humidity_squared"] = F.col("humidity") * F.col("humidity")
    if _have(df, "wind_speed_kmh"):
        cols["wind_speed_squared"] = F.col("wind_speed_kmh") * F.col("wind_speed_kmh")
    return df.withColumns(cols) if cols else df


def weather_interactions(df: DataFrame) -> DataFrame:
    """Weather x weather, weather x time of day, weather x cycle and weather x weekend."""
    t = F.col("temp_c")
    cols: dict[str, Column] = {}
    if _have(df, "temp_c", "humidity"):
        cols["temp_humidity_interaction"] = t * F.col("humidity")
        cols["heat_index_approx"] = t + 0.5 * F.col("humidity")
    if _have(df, "temp_c", "wind_speed_kmh"):
        cols["temp_wind_interaction"] = t * F.col("wind_speed_kmh")
        cols["wind_chill_approx"] = t - 0.1 * F.col("wind_speed_kmh")
    if _have(df, "temp_c", "hour"):
        cols["afternoon_heat_load"] = t * flag(hour_in(14, 18))
        cols["evening_temp_relief"] = t * flag(hour_in(19, 23))
        cols["morning_temp_baseline"] = t * flag(hour_in(0, 10))
        cols["peak_heat_stress"] = flag(hour_in(16, 20) & (t >= 35))
    if _have(df, "temp_c", "hour_sin", "hour_cos"):
        cols["temp_hour_sin_interaction"] = t * F.col("hour_sin")
        cols["temp_hour_cos_interaction"] = t * F.col("hour_cos")
    if _have(df, "temp_c", "is_weekend"):
        cols["weekend_temp_load"] = t * F.col("is_weekend")
    return df.withColumns(cols) if cols else df


def advanced_weather(df: DataFrame) -> DataFrame:
    """Cube, wind product, extreme heat and cold, degree hours."""
    t = F.col("temp_c")
    return df.withColumns(
        {
            "temp_squared": t * t,
            "temp_cubed": t * t * t,
            "temp_humidity_interaction": t * F.col("humidity"),
            "temp_wind_interaction": t * F.col("wind_speed"),
            "extreme_heat": flag(t > 30),
            "extreme_cold": flag(t < 5),
            **degree_days(unit="hours"),
        }
    )


def evening_weather(df: DataFrame, base_f: float = 75.0) -> DataFrame:
    """Evening cooling demand from a Fahrenheit ``temperature`` column; no column, no change."""
    if not _have(df, "temperature"):
        return df
    t, evening = F.col("temperature"), F.col("is_evening_peak")
    cooling = above(t - base_f, 0.0)
    cols = {
        "temp_evening_interaction": t * evening,
        "cooling_degree_hour": cooling,
        "evening_cooling_demand": F.when((evening == 1) & (t > 85), t * F.exp((t - 85) / 20)).otherwise(t),
    }
    if _have(df, "humidity"):
        factor = 1 + (F.col("humidity") - 50) / 100
        cols["humidity_cooling_factor"] = factor
        cols["humidity_cooling_demand"] = cooling * factor
    return df.withColumns(cols)


def fill_weather(df: DataFrame, temp: float = 20.0, humidity: float = 65.0, wind: float = 5.0) -> DataFrame:
    """Add default weather columns where the column is absent; cells are not filled."""
    defaults = {"temp_c": temp, "humidity": humidity, "wind_speed": wind}
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def uncertainty_features(df: DataFrame) -> DataFrame:
    """Horizon share of 48 h, pattern stability and forecast confidence."""
    cols: dict[str, Column] = {}
    if _have(df, "forecast_horizon_hours"):
        cols["forecast_uncertainty_score"] = F.least(F.col("forecast_horizon_hours") / 48.0, F.lit(1.0))
    if _have(df, "weather_volatility_6h"):
        cols["weather_pattern_stability"] = 1.0 / (1.0 + F.col("weather_volatility_6h"))
    if _have(df, "temp_forecast_stability"):
        cols["forecast_confidence"] = 1.0 / (1.0 + F.col("temp_forecast_stability"))
    return df.withColumns(cols) if cols else df
