"""Lags, leads, rolling statistics and other series windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.core.quantiles import with_quantiles
from gridweave.core.series import Series, over_series, series, with_position
from gridweave.functions.expr import above, flag

STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_columns(s: Series, value: str, lags: Sequence[int], name: str | None = None) -> dict[str, Column]:
    return {f"{name or value}_lag_{k}h": s.lag(value, k) for k in lags}


def rolling_columns(
    s: Series, value: str, windows: Sequence[int], stats: Sequence[str], pattern: str, least: int | None = None
) -> dict[str, Column]:
    """Trailing statistics; null until ``least`` values are in the frame (default: a full window)."""
    out = {}
    for n in windows:
        frame = s.rows(n - 1)
        enough = F.count(value).over(frame) >= (n if least is None else least)
        for stat in stats:
            calc = STATS[stat](value).over(frame)
            out[pattern.format(n=n, stat=stat)] = calc if least == 1 else F.when(enough, calc)
    return out


def lag_features(df: DataFrame, value: str = "load", lags: Sequence[int] = (1, 2, 3, 6, 12, 24), **layout) -> DataFrame:
    """Value k rows earlier in the same series."""
    return over_series(df, lambda s: lag_columns(s, value, lags), back=max(lags), **layout)


def target_feature(df: DataFrame, value: str = "load", horizon: int = 1, **layout) -> DataFrame:
    """Value ``horizon`` rows later."""
    return over_series(df, lambda s: {f"{value}_target_{horizon}h": s.lead(value, horizon)}, ahead=horizon, **layout)


def rolling_features(
    df: DataFrame,
    value: str = "load",
    windows: Sequence[int] = (3, 6, 12, 24),
    stats: Sequence[str] = ("mean", "std", "min", "max"),
    least: int | None = None,
    pattern: str | None = None,
    **layout,
) -> DataFrame:
    """Trailing mean, std, min and max."""
    pattern = pattern or f"{value}_rolling_{{n}}h_{{stat}}"
    build = lambda s: rolling_columns(s, value, windows, stats, pattern, least)
    return over_series(df, build, back=max(windows) - 1, **layout)


def padded(df: DataFrame, value: str, name: str = "padded_value", **layout) -> DataFrame:
    """The value with missing cells replaced by the last known one."""
    s = series(df, **layout).carrying(value)
    return s.finish(s.df.withColumn(name, s.last_known(value)))


def change_column(s: Series, filled: str, periods: int) -> Column:
    return F.try_divide(F.col(filled), s.lag(filled, periods)) - 1


def percent_change(df: DataFrame, value: str = "load", periods: int = 24, name: str | None = None, **layout) -> DataFrame:
    """Change against the value ``periods`` rows earlier; a missing value takes the last known one."""
    df = padded(df, value, **layout)
    build = lambda s: {name or f"{value}_daily_change": change_column(s, "padded_value", periods)}
    return over_series(df, build, back=periods, **layout).drop("padded_value")


# Trailing rows that stand for the forecast of each variable.
PROXY_ROWS = {"temp": ("temp_c", 24), "humidity": ("humidity", 12), "wind": ("wind_speed_kmh", 6)}
PROXY_BACK = 23


def with_proxies(s: Series, df: DataFrame, horizons: Sequence[int], base: float) -> DataFrame:
    used = {n: (c, k) for n, (c, k) in PROXY_ROWS.items() if c in df.columns}
    once = df.withColumns({f"proxy_{n}": F.avg(c).over(s.rows(k - 1)) for n, (c, k) in used.items()})
    cols: dict[str, Column] = {}
    for h in horizons:
        for n in used:
            cols[f"{n}_forecast_{h}h"] = F.col(f"proxy_{n}")
        cols[f"cooling_forecast_{h}h"] = above(F.col("proxy_temp") - base, 0.0)
        cols[f"heating_forecast_{h}h"] = above(base - F.col("proxy_temp"), 0.0)
    return once.withColumns(cols).drop(*[f"proxy_{n}" for n in used])


def forecast_proxies(df: DataFrame, horizons: Sequence[int], base: float = 18.0, **layout) -> DataFrame:
    """Trailing means (24, 12 and 6 rows) as the forecast of every horizon, with degree versions."""
    return over_series(df, lambda s: with_proxies(s, s.df, horizons, base), back=PROXY_BACK, **layout)


def forecast_by_horizon(df: DataFrame, horizons: Sequence[int], base: float = 18.0) -> DataFrame:
    """The real forecast rows pivoted to one column per horizon."""
    aggs = []
    for h in horizons:
        at = F.col("forecast_horizon_hours") == h
        aggs.append(F.max_by("temp_c", F.when(at, F.col("forecast_issued"))).alias(f"temp_forecast_{h}h"))
        aggs.append(F.max_by("humidity", F.when(at, F.col("forecast_issued"))).alias(f"humidity_forecast_{h}h"))
        aggs.append(F.max_by("wind_speed_kmh", F.when(at, F.col("forecast_issued"))).alias(f"wind_forecast_{h}h"))
    out = df.groupBy("zone", "timestamp").agg(*aggs)
    cols = {}
    for h in horizons:
        cols[f"cooling_forecast_{h}h"] = above(F.col(f"temp_forecast_{h}h") - base, 0.0)
        cols[f"heating_forecast_{h}h"] = above(base - F.col(f"temp_forecast_{h}h"), 0.0)
    return out.withColumns(cols)


def with_changes(s: Series, df: DataFrame, volatility_window: int) -> DataFrame:
    have = set(df.columns)
    cols: dict[str, Column] = {}
    for h in (6, 12, 24):
        if f"temp_forecast_{h}h" in have:
            cols[f"temp_change_rate_{h}h"] = (F.col(f"temp_forecast_{h}h") - F.col("temp_c")) / h
    for h in (6, 12):
        if {f"humidity_forecast_{h}h", "humidity"} <= have:
            cols[f"humidity_change_rate_{h}h"] = (F.col(f"humidity_forecast_{h}h") - F.col("humidity")) / h
    if f"temp_forecast_{volatility_window}h" in have:
        window = [volatility_window]
        cols |= rolling_columns(s, f"temp_forecast_{volatility_window}h", window, ["std"], "weather_volatility_6h", least=3)
    if "temp_forecast_24h" in have:
        cols |= rolling_columns(s, "temp_forecast_24h", [6], ["std"], "temp_forecast_stability", least=3)
    return df.withColumns(cols) if cols else df


def weather_change_features(df: DataFrame, volatility_window: int = 6, **layout) -> DataFrame:
    """Change rate to the forecast value, and rolling spread of the 6 h and 24 h forecast."""
    back = max(volatility_window, 6) - 1
    return over_series(df, lambda s: with_changes(s, s.df, volatility_window), back=back, **layout)


def proxies_and_changes(df: DataFrame, horizons: Sequence[int], base: float, volatility_window: int, **layout) -> DataFrame:
    """Both of the above in one pass over the series."""
    back = PROXY_BACK + max(volatility_window, 6) - 1
    build = lambda s: with_changes(s, with_proxies(s, s.df, horizons, base), volatility_window)
    return over_series(df, build, back=back, **layout)


def extreme_weather_features(
    df: DataFrame, hot: float = 35.0, cold: float = 5.0, rapid: float = 10.0, keys: Sequence[str] = ("zone",)
) -> DataFrame:
    """Heat wave and cold snap (24, 48 and 72 h must be configured), rapid change, outside p05-p95."""
    have = set(df.columns)
    three = [f"temp_forecast_{h}h" for h in (24, 48, 72)]
    cols: dict[str, Column] = {}
    if set(three) <= have:
        a, b, c = (F.col(x) for x in three)
        cols["heat_wave_incoming"] = flag((a > hot) & (b > hot) & (c > hot))
        cols["cold_snap_incoming"] = flag((a < cold) & (b < cold) & (c < cold))
    if "temp_change_rate_6h" in have:
        cols["rapid_temp_change"] = flag(F.abs(F.col("temp_change_rate_6h") * 6) > rapid)
    if "temp_forecast_24h" in have:
        df = with_quantiles(df, list(keys), {"t_p95": ("temp_c", 0.95), "t_p05": ("temp_c", 0.05)})
        f24 = F.col("temp_forecast_24h")
        cols["extreme_temp_probability"] = flag((f24 > F.col("t_p95")) | (f24 < F.col("t_p05")))
    return df.withColumns(cols).drop("t_p95", "t_p05") if cols else df


def quantile_flags(
    df: DataFrame,
    value: str = "load",
    rules: dict[str, tuple[str, float]] | None = None,
    keys: Sequence[str] = ("zone",),
) -> DataFrame:
    """Flags for values above or below a quantile of their series."""
    rules = rules or {
        "extreme_peak_indicator": (">", 0.95),
        "peak_demand_indicator": (">", 0.9),
        "off_peak_indicator": ("<", 0.3),
    }
    df = with_quantiles(df, list(keys), {f"cut_{n}": (value, q) for n, (_, q) in rules.items()})
    cols = {
        n: flag(F.col(value) > F.col(f"cut_{n}") if op == ">" else F.col(value) < F.col(f"cut_{n}"))
        for n, (op, _) in rules.items()
    }
    return df.withColumns(cols).drop(*[f"cut_{n}" for n in rules])


def volatility(df: DataFrame, columns: Sequence[str], spike: float, **layout) -> DataFrame:
    """Per series mean and largest absolute step of each column, steps above ``spike``, ratio of the first two."""
    keys = list(layout.get("keys", ("zone",)))
    steps = over_series(
        df, lambda s: {f"step_{c}": F.abs(F.col(c) - s.lag(c)) for c in columns}, back=1, **layout
    )
    aggs = []
    for c in columns:
        aggs += [
            F.avg(f"step_{c}").alias(f"{c}_volatility"),
            F.max(f"step_{c}").alias(f"{c}_max_step"),
            F.count_if(F.col(f"step_{c}") > spike).alias(f"{c}_spikes"),
        ]
    out = steps.groupBy(*keys).agg(*aggs)
    if len(columns) > 1:
        ratio = F.try_divide(F.col(f"{columns[0]}_volatility"), F.col(f"{columns[1]}_volatility"))
        out = out.withColumn("volatility_ratio", ratio)
    return out


def gap_report(df: DataFrame, limit_seconds: float, keys: Sequence[str] = ("zone",), ts: str = "timestamp") -> DataFrame:
    """Per series the number of time gaps above the limit and the largest gap in seconds."""

    def build(s: Series) -> dict[str, Column]:
        return {"gap_us": F.unix_micros(ts) - F.lag(F.unix_micros(ts), 1).over(s.w)}

    gaps = over_series(df.select(*keys, ts), build, keys=keys, order=(ts,), back=1)
    over = F.col("gap_us") > int(limit_seconds * 1_000_000)
    return gaps.groupBy(*keys).agg(
        F.count_if(over).alias("gap_count"),
        (F.max(F.when(over, F.col("gap_us"))) / 1e6).alias("largest_gap_seconds"),
    )


def fill_zeros(df: DataFrame, value: str = "load", **layout) -> DataFrame:
    """Zero readings replaced on the line between their neighbours (by row position).

    Trailing zeros take the last value; leading ones stay null.
    """
    known = F.when(F.col(value) != 0, F.col(value))
    s = series(df, **layout)
    rows = s.df.withColumn("row_at", s.pos)
    point = F.struct(F.col("row_at").alias("at"), known.alias("v"))
    s = replace(s, df=rows.withColumn("known_point", F.when(known.isNotNull(), point))).carrying("known_point")
    out = s.df.withColumns({"left_point": s.last_known("known_point"), "right_point": s.next_known("known_point")})
    a, b, at = F.col("left_point"), F.col("right_point"), F.col("row_at")
    line = a["v"] + (b["v"] - a["v"]) * (at - a["at"]) / (b["at"] - a["at"])
    filled = F.when(known.isNotNull(), F.col(value)).otherwise(F.when(b.isNull(), a["v"]).otherwise(line))
    out = out.withColumn(value, filled)
    return s.finish(out).drop("row_at", "known_point", "left_point", "right_point")


def light_smoothing(df: DataFrame, value: str = "load", own: float = 0.7, **layout) -> DataFrame:
    """0.7 x value + 0.3 x centred mean of three rows."""
    return over_series(
        df,
        lambda s: {value: own * F.col(value) + (1 - own) * F.avg(value).over(s.rows(1, 1))},
        back=1,
        ahead=1,
        **layout,
    )


def split_by_position(df: DataFrame, shares: Sequence[tuple[str, float]], name: str = "split", **layout) -> DataFrame:
    """Label rows by their place in the series: ``shares`` are (label, upper share) in time order."""
    out = with_position(df, "split_pos", "split_n", **layout)
    label = F.lit(shares[-1][0])
    for part, upto in reversed(list(shares[:-1])):
        label = F.when(F.col("split_pos") < F.floor(F.col("split_n") * upto + 1e-9), F.lit(part)).otherwise(label)
    return out.withColumn(name, label).drop("split_pos", "split_n")


def last_rows(df: DataFrame, n: int, **layout) -> DataFrame:
    """The last n rows of every series."""
    out = with_position(df, "tail_pos", "tail_n", **layout)
    return out.where(F.col("tail_pos") >= F.col("tail_n") - n).drop("tail_pos", "tail_n")


def demand_trend(df: DataFrame, as_of: Column, recent: int = 4, **layout) -> DataFrame:
    """Mean of the last rows against the rows before them, next peak and peak-hour flag."""
    order = list(layout.get("order", ("timestamp",)))
    out = with_position(df, "trend_pos", "trend_n", **layout)
    back = F.col("trend_n") - F.col("trend_pos")
    out = out.where(back <= 2 * recent).groupBy("zone").agg(
        F.max_by("load", F.struct(*order)).alias("current_load"),
        F.avg(F.when(back <= recent, F.col("load"))).alias("recent_mean"),
        F.avg(F.when(back > recent, F.col("load"))).alias("previous_mean"),
    )
    change = F.try_divide(F.col("recent_mean") - F.col("previous_mean"), F.col("previous_mean")) * 100
    hour = F.hour(as_of)
    peak = hour.between(16, 21)
    ahead = F.when(hour < 16, 18 - hour).otherwise(24 + 18 - hour)
    return out.withColumn("trend_change_pct", F.coalesce(change, F.lit(0.0))).select(
        "zone",
        "current_load",
        "recent_mean",
        "previous_mean",
        "trend_change_pct",
        F.when(F.abs("trend_change_pct") < 0.5, "stable")
        .when(F.col("trend_change_pct") > 0, "rising")
        .otherwise("falling")
        .alias("trend_direction"),
        flag(peak).alias("is_peak_hours"),
        ahead.cast("int").alias("hours_to_peak"),
        (F.date_trunc("day", as_of) + F.make_dt_interval(hours=F.when(hour < 16, F.lit(18)).otherwise(F.lit(42)))).alias(
            "next_peak_time"
        ),
    )


def running_abs_error(df: DataFrame, actual: str, predicted: str, **layout) -> DataFrame:
    """Running sum of the absolute error in series order."""
    df = df.withColumn("abs_error", F.abs(F.col(predicted) - F.col(actual)))
    s = series(df, **layout).carrying(sums=["abs_error"])
    return s.finish(s.df.withColumn("cumulative_abs_error", s.running_sum("abs_error")))


def downsample(df: DataFrame, points: int, rounding: str = "floor", **layout) -> DataFrame:
    """About ``points`` rows per series: every k-th row with k = n // points (or rounded up)."""
    out = with_position(df, "down_pos", "down_n", **layout)
    ratio = F.col("down_n") / points
    step = F.greatest(F.floor(ratio) if rounding == "floor" else F.ceil(ratio), F.lit(1))
    return out.where(F.col("down_pos") % step == 0).drop("down_pos", "down_n")
