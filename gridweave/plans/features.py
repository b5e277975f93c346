"""Feature tables composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.core.series import Series, over_series
from gridweave.functions import calendar as cal
from gridweave.functions import weather as wx
from gridweave.functions.expr import wave
from gridweave.operators.aggregates import hourly_mean
from gridweave.operators.clean import deduplicate
from gridweave.operators.joins import lag_by_time, merge
from gridweave.operators.windows import (
    extreme_weather_features,
    forecast_by_horizon,
    change_column,
    lag_columns,
    padded,
    proxies_and_changes,
    rolling_columns,
    weather_change_features,
)


@dataclass(frozen=True)
class ForecastConfig:
    horizons: tuple[int, ...] = (1, 6, 12, 24)
    base: float = 18.0
    hot: float = 35.0
    cold: float = 5.0
    rapid: float = 10.0
    volatility_window: int = 6


@dataclass(frozen=True)
class UnifiedConfig:
    forecast: ForecastConfig = field(default_factory=ForecastConfig)
    lags: tuple[int, ...] = (1, 24)
    lag_mode: str = "rows"
    order: tuple[str, ...] = ("timestamp",)
    temporal: bool = True
    interactions: bool = True


def build_features(
    power: DataFrame,
    weather: DataFrame,
    horizon: int = 1,
    lags: Sequence[int] = (1, 2, 3, 6, 12, 24),
    windows: Sequence[int] = (3, 6, 12, 24),
    on: Sequence[str] = ("timestamp",),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Inner join, lags, rolling statistics, calendar, weather and lead target; complete rows only.

    Lags, rolling columns and the target share one pass over the series.
    """
    df = merge(power, weather, on)

    def build(s: Series) -> dict[str, Column]:
        return {
            **lag_columns(s, "load", lags),
            **rolling_columns(s, "load", windows, ("mean", "std", "min", "max"), "load_rolling_{n}h_{stat}"),
            f"load_target_{horizon}h": s.lead("load", horizon),
        }

    back = max(*lags, *(w - 1 for w in windows))
    df = over_series(df, build, keys=keys, order=("timestamp",), back=back, ahead=horizon)
    df = wx.weather_features(cal.temporal_features(df))
    loose = ("timestamp", "region_power", "region_weather", "data_source_power", "data_source_weather")
    return df.dropna(subset=[c for c in df.columns if c not in loose])


def forecast_features(
    df: DataFrame, config: ForecastConfig = ForecastConfig(), mode: str = "proxy", order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """Forecast values per horizon, change and volatility, extremes, uncertainty."""
    if mode == "proxy":
        out = proxies_and_changes(df, config.horizons, config.base, config.volatility_window, order=order)
    else:
        own = df.where(F.col("forecast_horizon_hours") == min(config.horizons))
        out = own.join(forecast_by_horizon(df, config.horizons, config.base), ["zone", "timestamp"])
        out = weather_change_features(out, config.volatility_window, order=order)
    out = extreme_weather_features(out, config.hot, config.cold, config.rapid)
    return wx.uncertainty_features(out)


def forecast_feature_names(config: ForecastConfig = ForecastConfig()) -> list[str]:
    names = []
    for h in config.horizons:
        names += [f"{n}_forecast_{h}h" for n in ("temp", "humidity", "wind", "cooling", "heating")]
    names += [f"temp_change_rate_{h}h" for h in (6, 12, 24)] + [f"humidity_change_rate_{h}h" for h in (6, 12)]
    names += ["weather_volatility_6h", "temp_forecast_stability", "heat_wave_incoming", "cold_snap_incoming"]
    names += ["rapid_temp_change", "extreme_temp_probability"]
    return names + ["forecast_uncertainty_score", "weather_pattern_stability", "forecast_confidence"]


def one_forecast(forecast: DataFrame) -> DataFrame:
    """One row for each zone and time: the latest issue, and of one issue the nearest horizon."""
    rank = []
    if "forecast_issued" in forecast.columns:
        rank.append("forecast_issued")
    if "forecast_horizon_hours" in forecast.columns:
        forecast = forecast.withColumn("_near", -F.col("forecast_horizon_hours"))
        rank.append("_near")
    return deduplicate(forecast, ["zone", "timestamp"], rank).drop("_near") if rank else forecast


def merge_all(power: DataFrame, weather: DataFrame | None, forecast: DataFrame | None, config: UnifiedConfig) -> DataFrame:
    """Load left-joined with weather and with forecast features on time and zone."""
    df = power
    if weather is not None:
        df = merge(df, weather, ["timestamp", "zone"], "left", ("", "_weather"))
    if forecast is not None:
        feats = forecast_features(one_forecast(forecast), config.forecast)
        cols = [c for c in forecast_feature_names(config.forecast) if c in feats.columns]
        df = merge(df, feats.select("timestamp", "zone", *cols), ["timestamp", "zone"], "left", ("", "_forecast"))
    return df


def unified_features(
    power: DataFrame, weather: DataFrame | None = None, forecast: DataFrame | None = None, config: UnifiedConfig = UnifiedConfig()
) -> DataFrame:
    """Multi-zone feature table of load, weather, forecasts, calendar, lags and interactions."""
    df = merge_all(power, weather, forecast, config)
    # Lags first: the shuffle then moves the merged columns only, not the derived ones.
    if config.lags:
        if config.lag_mode == "time":
            df = lag_by_time(df, "load", config.lags)
        else:
            df = over_series(df, lambda s: lag_columns(s, "load", config.lags), back=max(config.lags), order=config.order)
    if config.temporal:
        df = cal.cyclic_parts(cal.calendar_parts(df))
    if weather is not None:
        df = wx.historical_weather_features(df)
    return wx.weather_interactions(df) if config.interactions else df


def evening_peak_features(df: DataFrame) -> DataFrame:
    """All evening-peak features of all zones at once; complete rows only."""
    df = padded(df, "load")

    def build(s: Series) -> dict[str, Column]:
        out = {
            "load_daily_change": change_column(s, "padded_value", 24),
            "load_day_over_day": change_column(s, "padded_value", 24),
            **lag_columns(s, "load", (1, 2)),
            **rolling_columns(s, "load", (4, 8), ("mean",), "load_ma_{n}h", least=1),
        }
        if "temperature" in df.columns:
            out |= lag_columns(s, "temperature", (1, 2), "temp")
        return out

    df = over_series(df, build, back=24).drop("padded_value")
    df = wx.evening_weather(cal.evening_features(cal.evening_cycle(df)))
    df = cal.days_since_start(cal.demand_pattern_flags(df)).drop("days_from_latest")
    return cal.zone_factors(df).dropna()


def hourly_model_table(load: DataFrame, weather: DataFrame, advanced: bool = False) -> DataFrame:
    """Hourly mean load with weather, calendar, degree hours and 1/24 row lags.

    Lags run over the joined rows, as the model scripts do; ``advanced`` adds the cubic
    and extreme weather terms, the temperature step and the 365-day cycle.
    """
    df = hourly_mean(load).join(weather, ["zone", "timestamp"], "inner")

    def build(s: Series) -> dict[str, Column]:
        out = lag_columns(s, "load", (1, 24))
        if advanced:
            out["temp_lag_1h"] = s.lag("temp_c")
            out["temp_change_1h"] = F.col("temp_c") - s.lag("temp_c")
        return out

    df = over_series(df, build, back=24)
    df = cal.business_hours(cal.calendar_parts(df), 8, 18)
    t = F.col("temp_c")
    if advanced:
        df = wx.advanced_weather(df)
        cols = {f"{k}_{n}": wave(F.col(n), p, k) for n, p in (("hour", 24), ("day_of_year", 365)) for k in ("sin", "cos")}
        return df.withColumns(cols).dropna()
    squares = {"temp_squared": t * t, "temp_humidity_interaction": t * F.col("humidity")}
    return df.withColumns({**squares, **wx.degree_days(unit="hours")}).dropna()
