"""Calendar, cyclic and day-pattern features from the timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.catalog import EVENING_MULTIPLIER, GROWTH_FACTOR, HOLIDAYS, lookup
from gridweave.core.series import join_keys
from gridweave.functions.expr import flag, hour_in, wave
from gridweave.session import stored

SUMMER, WINTER = [6, 7, 8], [12, 1, 2]


def _new(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add only the columns the table lacks."""
    return df.withColumns({k: v for k, v in cols.items() if k not in df.columns})


def calendar_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """hour, day_of_week (Monday 0), day_of_year, month, quarter, is_weekend."""
    day = F.weekday(ts)
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": day,
            "day_of_year": F.dayofyear(ts),
            "month": F.month(ts),
            "quarter": F.quarter(ts),
            "is_weekend": flag(day >= 5),
        }
    )


def cyclic_parts(df: DataFrame, year: float = 365.25) -> DataFrame:
    """Sine and cosine of hour, weekday and day of year."""
    out = {}
    for c, period in (("hour", 24), ("day_of_week", 7), ("day_of_year", year)):
        for kind in ("sin", "cos"):
            out[f"{c}_{kind}"] = wave(F.col(c), period, kind)
    return df.withColumns(out)


def temporal_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Calendar parts, business hours (6-18 on weekdays) and cyclic parts."""
    df = business_hours(calendar_parts(df, ts), 6, 18, "is_business_hours")
    return cyclic_parts(df)


def business_hours(df: DataFrame, first: int = 8, last: int = 18, name: str = "is_business_hour") -> DataFrame:
    return df.withColumn(name, flag(hour_in(first, last) & (F.col("day_of_week") < 5)))


def month_cycle(df: DataFrame) -> DataFrame:
    return df.withColumns({f"month_{k}": wave(F.col("month"), 12, k) for k in ("sin", "cos")})


def evening_cycle(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Cyclic set of the evening features: hour, weekday and month."""
    df = _new(df, {"hour": F.hour(ts), "weekday": F.weekday(ts), "month": F.month(ts)})
    out = {}
    for name, c, period in (("hour", "hour", 24), ("day_of_week", "weekday", 7), ("month", "month", 12)):
        for kind in ("sin", "cos"):
            out[f"{name}_{kind}"] = wave(F.col(c), period, kind)
    return df.withColumns(out)


def evening_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Evening peak flag (17-21), its intensity, distance to 18:00, ramp and decline."""
    df = _new(df, {"hour": F.hour(ts)})
    hour = F.col("hour")
    return df.withColumns(
        {
            "is_evening_peak": flag(hour_in(17, 21)),
            "evening_hour_intensity": F.when(hour_in(17, 21), (hour - 17) / 4).otherwise(0.0),
            "hours_from_peak": F.abs(hour - 18) / 24,
            "evening_ramp": F.when(hour_in(15, 19), (hour - 15) / 4).otherwise(0.0),
            "post_peak_decline": F.when(hour_in(21, 23), (23 - hour) / 2).otherwise(0.0),
        }
    )


def demand_pattern_flags(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Weekend, holiday, summer and work-evening flags."""
    df = _new(df, {"hour": F.hour(ts), "weekday": F.weekday(ts)})
    return df.withColumns(
        {
            "weekend_flag": flag(F.col("weekday") >= 5),
            "month_day": F.date_format(ts, "MM-dd"),
            "near_holiday": flag(F.date_format(ts, "MM-dd").isin(HOLIDAYS)),
            "is_summer_month": flag(F.month(ts).isin(6, 7, 8, 9)),
            "work_evening_overlap": flag(hour_in(17, 19) & (F.col("weekday") < 5)),
        }
    )


def days_since_start(df: DataFrame, keys: list[str] = ["zone"], ts: str = "timestamp") -> DataFrame:
    """Days from the first row of the series, and days back from its latest row."""
    span = stored(df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last")))
    df = join_keys(df, span, keys, "left")
    seconds = F.unix_micros(ts) / 1e6
    return df.withColumns(
        {
            "days_since_start": (seconds - F.unix_micros("_first") / 1e6) / 86400,
            "days_from_latest": F.floor((F.unix_micros("_last") / 1e6 - seconds) / 86400),
        }
    ).drop("_first", "_last")


def zone_factors(df: DataFrame) -> DataFrame:
    """Evening multiplier, growth factor and their effects for the row's zone."""
    zone = F.col("zone")
    df = df.withColumns(
        {
            "zone_evening_multiplier": lookup(EVENING_MULTIPLIER, zone, 1.0),
            "zone_growth_factor": lookup(GROWTH_FACTOR, zone, 0.0),
        }
    )
    return df.withColumns(
        {
            "zone_adjusted_evening": F.col("is_evening_peak") * F.col("zone_evening_multiplier"),
            "zone_growth_effect": F.col("days_since_start") * F.col("zone_growth_factor") / 365,
        }
    )


def strong_evening_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Evening set with its peak at 19:00, industrial hours, season and interactions."""
    df = _new(df, {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts)})
    df = _new(df, {"is_weekend": flag(F.col("day_of_week") >= 5)})
    hour, weekend, month = F.col("hour"), F.col("is_weekend"), F.col("month")
    evening, season, industry = flag(hour_in(17, 21)), flag(month.between(6, 9)), flag(hour_in(10, 15))
    cycles = {
        f"{n}_{k}": wave(F.col(c), p, k)
        for n, c, p in (("hour", "hour", 24), ("dow", "day_of_week", 7), ("month", "month", 12))
        for k in ("sin", "cos")
    }
    return df.withColumns(
        {
            "is_evening_peak": evening,
            "evening_hour_intensity": F.when(hour_in(17, 21), 1 - F.abs(hour - 19) / 3).otherwise(0.0),
            "hours_from_peak": F.abs(hour - 19),
            "sce_evening_multiplier": F.when(hour_in(17, 21), 1.2).otherwise(1.0),
            "work_evening_overlap": evening * (1 - weekend),
            "extended_evening": flag(hour_in(16, 22)),
            "pre_evening_ramp": flag(hour_in(15, 17)),
            "post_evening_decline": flag(hour_in(20, 23)),
            "business_hours": flag(hour_in(8, 18)),
            "industrial_peak": industry,
            "weekend_evening_different": evening * weekend,
            "high_demand_season": season,
            "evening_weekend_interaction": evening * weekend,
            "evening_month_interaction": evening * month,
            "evening_season_interaction": evening * season,
            "industrial_evening_overlap": industry * evening,
            **cycles,
        }
    )


def extreme_temporal_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour powers and harmonics, day parts, season and workday day parts, cooling hours.

    Its ``morning_ramp`` and ``overnight_low`` replace those of the regional set.
    """
    df = _new(df, {"hour": F.hour(ts), "month": F.month(ts), "day_of_week": F.weekday(ts)})
    hour = F.col("hour")
    cols: dict[str, Column] = {"hour_cubed": F.pow(hour, 3), "hour_quartic": F.pow(hour, 4)}
    for k in (2, 3, 4, 6, 8, 12):
        cols[f"hour_sin_{k}"] = wave(hour * k, 24, "sin")
        cols[f"hour_cos_{k}"] = wave(hour * k, 24, "cos")
    parts = {
        "early_morning": (4, 7),
        "morning_ramp": (8, 11),
        "midday_peak": (12, 15),
        "afternoon_peak": (16, 19),
        "evening_decline": (20, 23),
        "overnight_low": (0, 3),
    }
    part = {name: flag(hour_in(a, b)) for name, (a, b) in parts.items()}
    summer, winter = flag(F.col("month").isin(SUMMER)), flag(F.col("month").isin(WINTER))
    workday = flag(F.col("day_of_week") < 5)
    cols |= part
    cols |= {
        "summer_afternoon": part["midday_peak"] * summer,
        "summer_evening": part["afternoon_peak"] * summer,
        "winter_morning": part["morning_ramp"] * winter,
        "workday_morning": part["morning_ramp"] * workday,
        "workday_afternoon": part["afternoon_peak"] * workday,
        "weekend_midday": part["midday_peak"] * (1 - workday),
    }
    cols |= {f"ac_hour_{h}": flag(hour == h) for h in (14, 15, 16, 17)}
    return df.withColumns(cols)


def enhanced_temporal_features(df: DataFrame) -> DataFrame:
    """Hour powers, peak windows, weekend/season/business interactions, squared cyclic terms."""
    hour, weekend = F.col("hour"), F.col("is_weekend")
    summer, winter = flag(F.col("month").isin(SUMMER)), flag(F.col("month").isin(WINTER))
    business = flag((F.col("day_of_week") < 5) & (weekend == 0))
    return df.withColumns(
        {
            "hour_squared": F.pow(hour, 2),
            "hour_cubed": F.pow(hour, 3),
            "morning_peak": flag(hour_in(7, 9)),
            "afternoon_peak": flag(hour_in(14, 16)),
            "evening_peak": flag(hour_in(17, 19)),
            "night_low": flag(hour_in(1, 5)),
            "weekend_hour": weekend * hour,
            "weekday_hour": (1 - weekend) * hour,
            "summer_indicator": summer,
            "winter_indicator": winter,
            "summer_hour": summer * hour,
            "winter_hour": winter * hour,
            "business_day": business,
            "business_hour": business * flag(hour_in(8, 17)),
            "hour_sin_2": F.pow("hour_sin", F.lit(2)),
            "hour_cos_2": F.pow("hour_cos", F.lit(2)),
            "hour_sin_cos": F.col("hour_sin") * F.col("hour_cos"),
        }
    )


# Day-pattern rules per zone as SQL conditions on h (hour), m (month), d (weekday, Monday 0).
REGIONAL_RULES = {
    "NP15": {
        "tech_peak_hours": "h BETWEEN 9 AND 17 AND d < 5",
        "residential_evening": "h BETWEEN 18 AND 22",
        "winter_heating": "m IN (12, 1, 2) AND h IN (7, 8, 18, 19, 20)",
        "summer_cooling": "m IN (6, 7, 8) AND h IN (14, 15, 16, 17)",
        "high_volatility_hours": "h IN (6, 7, 8, 17, 18, 19) AND d < 5",
        "stable_hours": "h BETWEEN 10 AND 14 AND d < 5",
        "weekend_stability": "d >= 5 AND h BETWEEN 10 AND 16",
    },
    "SCE": {
        "la_metro_peak": "h BETWEEN 8 AND 19 AND d < 5",
        "desert_cooling": "m BETWEEN 5 AND 9 AND h BETWEEN 13 AND 18",
        "coastal_moderate": "m IN (3, 4, 10, 11) AND h BETWEEN 10 AND 13",
        "industrial_shift": "h IN (6, 7, 14, 15, 22, 23) AND d < 5",
        "extreme_demand_hours": "h BETWEEN 14 AND 18 AND m IN (6, 7, 8)",
        "low_demand_stable": "h BETWEEN 2 AND 5 OR (d >= 5 AND h IN (6, 7, 8))",
        "transition_hours": "h IN (6, 7, 8, 17, 18, 19, 20) AND d < 5",
    },
    "SMUD": {
        "sacramento_peak": "h BETWEEN 7 AND 20 AND d < 5",
        "valley_heat": "m BETWEEN 6 AND 9 AND h BETWEEN 14 AND 18",
        "mild_season": "m IN (3, 4, 5, 10, 11) AND h BETWEEN 9 AND 12",
        "weekend_pattern": "d >= 5 AND h BETWEEN 10 AND 14",
        "predictable_hours": "h BETWEEN 10 AND 15 AND d < 5",
        "volatile_transitions": "h IN (6, 7, 8, 18, 19, 20) AND d < 5",
        "stable_weekends": "d >= 5 AND h BETWEEN 9 AND 17",
    },
    "SDGE": {
        "coastal_mild": "m IN (1, 2, 3, 11, 12) AND h BETWEEN 8 AND 12",
        "summer_moderate": "m IN (6, 7, 8) AND h BETWEEN 13 AND 16",
        "evening_residential": "h BETWEEN 18 AND 21 AND d < 5",
        "tourist_season": "m IN (6, 7, 8) AND d >= 5",
    },
    "SP15": {
        "socal_peak": "h BETWEEN 9 AND 18 AND d < 5",
        "extreme_heat": "m IN (7, 8, 9) AND h BETWEEN 14 AND 17",
        "mild_weather": "m IN (4, 5, 10, 11) AND h BETWEEN 10 AND 13",
    },
    "PGE_VALLEY": {
        "valley_agricultural": "m BETWEEN 4 AND 9 AND h IN (6, 7, 8, 17, 18, 19)",
        "irrigation_peak": "m IN (6, 7, 8) AND h BETWEEN 10 AND 14",
        "rural_evening": "h IN (18, 19, 20) AND d < 5",
    },
}
OTHER_ZONE_RULES = {
    "ca_business_hours": "h BETWEEN 8 AND 18 AND d < 5",
    "ca_summer_peak": "m IN (6, 7, 8) AND h BETWEEN 14 AND 18",
    "ca_winter_morning": "m IN (12, 1, 2) AND h IN (7, 8, 9)",
    "ca_evening_ramp": "h BETWEEN 17 AND 20 AND d < 5",
}
SHARED_RULES = {
    "weekend_vs_weekday": "d >= 5",
    "peak_season": "m IN (6, 7, 8, 12, 1, 2)",
    "shoulder_season": "m IN (3, 4, 5, 9, 10, 11)",
    "morning_ramp": "h BETWEEN 6 AND 9",
    "midday_plateau": "h BETWEEN 10 AND 14",
    "evening_peak": "h BETWEEN 17 AND 20",
    "overnight_low": "h >= 22 OR h <= 5",
}


def regional_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Day-pattern flags of the row's zone (null in rows of other zones) and the shared ones."""
    keep = df.columns
    df = df.withColumns({"h": F.hour(ts), "m": F.month(ts), "d": F.weekday(ts)})
    zone = F.col("zone")
    cols: dict[str, Column] = {}
    for z, rules in REGIONAL_RULES.items():
        for name, rule in rules.items():
            cols[name] = F.when(zone == z, flag(F.expr(rule)))
    known = F.coalesce(zone.isin(list(REGIONAL_RULES)), F.lit(False))
    for name, rule in OTHER_ZONE_RULES.items():
        cols[name] = F.when(~known, flag(F.expr(rule)))
    for name, rule in SHARED_RULES.items():
        cols[name] = flag(F.expr(rule))
    return df.withColumns(cols).drop(*[c for c in ("h", "m", "d") if c not in keep])
