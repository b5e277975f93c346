"""Data-quality checks, scores and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.catalog import EXPECTED_ZONES
from gridweave.core.quantiles import group_quantiles
from gridweave.core.scalars import beside
from gridweave.functions.expr import flag
from gridweave.operators.windows import gap_report
from gridweave.session import stored


class DataValidationError(ValueError):
    """Input that cannot be used."""


def null_share(c: str) -> Column:
    return F.avg(flag(F.col(c).isNull()).cast("double")) * 100


def training_gate(df: DataFrame, as_of: Column, least_rows: int = 1000, max_null_pct: float = 10.0) -> DataFrame:
    """One row per zone: size, null share, IQR and age, and whether training may start."""
    facts = df.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_rows"),
        null_share("load").alias("null_pct"),
        F.floor((F.unix_micros(as_of) - F.max(F.unix_micros("timestamp"))) / 86_400_000_000).alias("days_old"),
    )
    q = group_quantiles(df, ["zone"], {"q1": ("load", 0.25), "q3": ("load", 0.75)})
    out = facts.join(q, "zone", "left").withColumn("iqr", F.col("q3") - F.col("q1")).drop("q1", "q3")
    ok = (F.col("n_rows") >= least_rows) & (F.col("null_pct") <= max_null_pct) & (F.coalesce("iqr", F.lit(1.0)) != 0)
    return out.withColumn("passed", flag(ok))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 80, "good").when(score >= 70, "fair").otherwise("poor")


def quality_report(
    df: DataFrame, has_system: bool = True, has_weather: bool = True, expected: Sequence[str] = tuple(EXPECTED_ZONES), years: float = 4.5
) -> DataFrame:
    """Score from 100 down: nulls 10, short history 15, missing zones 20, no system table 5, no weather 10."""
    zone_hits = [F.max(flag(F.col("zone") == z)) for z in expected]
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    seconds = F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))
    out = df.agg(
        sum(nulls[1:], nulls[0]).alias("missing_values"),
        (F.floor(seconds / 86_400_000_000) / 365.25).alias("duration_years"),
        (F.lit(len(expected)) - sum(zone_hits[1:], zone_hits[0])).alias("missing_zones"),
    )
    score = (
        F.lit(100)
        - F.when(F.col("missing_values") > 0, 10).otherwise(0)
        - F.when(F.col("duration_years") < years, 15).otherwise(0)
        - F.when(F.col("missing_zones") > 0, 20).otherwise(0)
        - F.lit(0 if has_system else 5)
        - F.lit(0 if has_weather else 10)
    )
    return out.withColumn("quality_score", score).withColumn("grade", grade(F.col("quality_score")))


def _penalties(facts: DataFrame, rules: Sequence[tuple[str, Column, int]]) -> DataFrame:
    """One row per rule with the penalty it took, from a one-row table of facts."""
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("check"), F.when(cond, F.lit(p)).otherwise(F.lit(0)).alias("penalty"))
                for n, cond, p in rules
            ]
        )
    )
    return facts.select(rows.alias("r")).select("r.check", "r.penalty")


def score(penalties: DataFrame) -> DataFrame:
    return penalties.agg(
        (F.lit(100) - F.coalesce(F.sum("penalty"), F.lit(0))).alias("quality_score"),
        F.count_if(F.col("penalty") > 0).alias("n_issues"),
    ).withColumn("passed", flag(F.col("quality_score") >= 75))


def feature_penalties(df: DataFrame) -> DataFrame:
    """Unified table: critical nulls > 5 %, load and calendar ranges, forecast nulls > 90 %, lag nulls > 50 %."""
    have = df.columns
    aggs, rules = [], []
    for c in [x for x in ("timestamp", "zone", "load", "hour", "day_of_week") if x in have]:
        aggs.append(null_share(c).alias(f"n_{c}"))
        rules.append((f"nulls_{c}", F.col(f"n_{c}") > 5, 15))
    ranges = {"load": (0, 100000, 20), "hour": (0, 23, 10), "day_of_week": (0, 6, 10), "month": (1, 12, 10)}
    for c, (lo, hi, p) in ranges.items():
        if c in have:
            aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
            rules.append((f"range_{c}", (F.col(f"lo_{c}") < lo) | (F.col(f"hi_{c}") > hi), p))
    for c in [x for x in have if "forecast" in x]:
        aggs.append(null_share(c).alias(f"f_{c}"))
        rules.append((f"coverage_{c}", F.col(f"f_{c}") > 90, 5))
    for c in [x for x in have if "lag" in x]:
        aggs.append(null_share(c).alias(f"g_{c}"))
        rules.append((f"lag_nulls_{c}", F.col(f"g_{c}") > 50, 5))
    return _penalties(df.agg(*aggs), rules)


def forecast_table_penalties(df: DataFrame) -> DataFrame:
    """Forecast table: null time 20, null temperature 30, range 15, short horizon 10, gaps above 2 h 10."""
    facts = df.agg(
        F.count_if(F.col("timestamp").isNull()).alias("no_ts"),
        F.count_if(F.col("temp_c").isNull()).alias("no_temp"),
        F.count_if(~F.col("temp_c").between(-10, 50)).alias("far"),
        F.max("forecast_horizon_hours").alias("h"),
    )
    # Gaps of the combined time line: distinct times, so equal times of several zones are one point.
    times = df.where("timestamp is not null").select("timestamp").distinct().withColumn("line", F.lit("all"))
    gaps = gap_report(times, 7200, keys=("line",)).agg(F.coalesce(F.sum("gap_count"), F.lit(0)).alias("gaps"))
    rules = [
        ("null_timestamp", F.col("no_ts") > 0, 20),
        ("null_temperature", F.col("no_temp") > 0, 30),
        ("temperature_range", F.col("far") > 0, 15),
        ("short_horizon", F.col("h") < 12, 10),
        ("time_gaps", F.col("gaps") > 0, 10),
    ]
    return _penalties(beside(facts, gaps), rules)


def forecast_feature_penalties(df: DataFrame) -> DataFrame:
    """Forecast features: any column > 50 % null 20, temperature range 10, negative degrees 15, non-binary flags 10."""
    have = df.columns
    aggs = [null_share(c).alias(f"n_{c}") for c in have]
    many = F.greatest(*[F.col(f"n_{c}") for c in have]) > 50
    rules = [("high_nulls", many, 20)]
    for c in have:
        if "temp_forecast" in c:
            aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
            rules.append((f"range_{c}", (F.col(f"lo_{c}") < -30) | (F.col(f"hi_{c}") > 60), 10))
        if "cooling_forecast" in c or "heating_forecast" in c:
            aggs.append(F.min(c).alias(f"lo_{c}"))
            rules.append((f"negative_{c}", F.col(f"lo_{c}") < 0, 15))
        if any(x in c for x in ("incoming", "rapid_", "extreme_")):
            aggs.append(F.count_if(~F.col(c).isin(0, 1)).alias(f"b_{c}"))
            rules.append((f"binary_{c}", F.col(f"b_{c}") > 0, 10))
    return _penalties(df.agg(*aggs), rules)


def forecast_column_issues(df: DataFrame) -> DataFrame:
    """Per forecast column: values outside -20..60 and null share; an issue where any or above half."""
    cols = [c for c in df.columns if "forecast" in c and "confidence" not in c and c in _numeric(df)]
    aggs = []
    for c in cols:
        aggs += [F.count_if(~F.col(c).between(-20, 60)).alias(f"x_{c}"), null_share(c).alias(f"n_{c}")]
    rows = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(f"x_{c}").alias("n_extreme"), F.col(f"n_{c}").alias("null_pct")) for c in cols]
        )
    )
    out = df.agg(*aggs).select(rows.alias("r")).select("r.*")
    return out.withColumn("has_issue", flag((F.col("n_extreme") > 0) | (F.col("null_pct") > 50)))


def _numeric(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint") or t.startswith("decimal")]


def require(df: DataFrame, columns: Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """The table itself, or a typed error for missing columns, no rows or nulls in critical columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataValidationError(f"missing columns: {missing}")
    facts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in not_null]).first()
    if facts["_n"] == 0:
        raise DataValidationError("no rows")
    bad = [c for c in not_null if facts[c] > 0]
    if bad:
        raise DataValidationError(f"nulls in {bad}")
    return df


def freshness(df: DataFrame, as_of: Column) -> DataFrame:
    """Age of the latest row per zone: fresh below 1 h, aging below 6 h, else stale; alert above 24 h."""
    hours = (F.unix_micros(as_of) - F.max(F.unix_micros("timestamp"))) / 3.6e9
    out = df.groupBy("zone").agg(F.max("timestamp").alias("latest_ts"), hours.alias("age_hours"))
    h = F.col("age_hours")
    return out.withColumns(
        {"freshness": F.when(h < 1, "fresh").when(h < 6, "aging").otherwise("stale"), "alert": flag(h > 24)}
    )


def model_health(models: DataFrame, as_of: Column, expected: DataFrame) -> DataFrame:
    """Status per expected zone: missing, critical (MAPE > 5), degraded (MAPE > 2 or older than 8 h), healthy."""
    age = (F.unix_micros(as_of) - F.unix_micros("trained_at")) / 3.6e9
    out = expected.join(models, "zone", "left").withColumn("age_hours", age)
    status = (
        F.when(F.col("trained_at").isNull(), "missing")
        .when(F.col("mape") > 5, "critical")
        .when((F.col("mape") > 2) | (F.col("age_hours") > 8), "degraded")
        .otherwise("healthy")
    )
    return out.select("zone", "mape", "age_hours", status.alias("status"))


def promotion_gate(
    metrics: DataFrame,
    max_mape: float = 2.0,
    least_variation: float = 3.5,
    max_lag: float = 60.0,
    least_temporal: float = 35.0,
    max_evening: float = 5.0,
    least_r2: float = 0.5,
) -> DataFrame:
    """Accuracy, temporal variation and feature balance of a model, and the deployment test."""
    checks = {
        "accuracy_check": flag(F.col("mape") <= max_mape),
        "temporal_variation_check": flag(F.col("temporal_variation") >= least_variation),
        "feature_balance_check": flag(
            (F.col("lag_share") <= max_lag) & (F.col("temporal_share") >= least_temporal)
        ),
        "deployment_ready": flag((F.col("evening_mape") < max_evening) & (F.col("r2") > least_r2)),
    }
    first3 = list(checks.values())[:3]
    return metrics.withColumns({**checks, "overall_pass": first3[0] * first3[1] * first3[2]})


# Name patterns of the feature classes, tested in this order.
CATALOGUE_CLASSES = [
    ("lag", "lag"),
    ("rolling", "rolling"),
    ("temporal", "^(hour|day_of_week|month|day_of_year|is_weekend|is_business_hours)$"),
    ("temporal_cyclic", "_sin|_cos"),
    ("weather", "temp|humidity|wind|degree_days"),
    ("target", "target"),
]


def feature_class(name: Column) -> Column:
    out = None
    for label, pattern in CATALOGUE_CLASSES:
        out = F.when(name.rlike(pattern), label) if out is None else out.when(name.rlike(pattern), label)
    return out.otherwise("other")


def feature_catalogue(df: DataFrame, exclude: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Each feature column with its class and the percent of rows that have it."""
    cols = [c for c in df.columns if c not in exclude]
    facts = df.agg(*[(F.count(c) / F.count(F.lit(1)) * 100).alias(c) for c in cols])
    long = facts.unpivot([], cols, "feature_name", "non_null_pct")
    return long.withColumn("feature_type", feature_class(F.col("feature_name")))


def coverage_by_class(df: DataFrame, exclude: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Number of features and mean coverage per class."""
    return feature_catalogue(df, exclude).groupBy("feature_type").agg(
        F.count(F.lit(1)).alias("n_features"), F.avg("non_null_pct").alias("mean_coverage_pct")
    )
