"""Forecast error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.core.quantiles import group_quantiles
from gridweave.core.scalars import beside
from gridweave.core.series import join_keys
from gridweave.functions.expr import flag


def _r2(y: Column, e: Column) -> Column:
    """1 - residual / total sum of squares; 0 where y does not vary."""
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - F.sum(e * e) / total).otherwise(0.0)


def core_metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MAE, RMSE, MAPE (|y| at least 1e-6), R², max error, median error, bias and bias %."""
    a, e = F.col(y), F.col(y) - F.col(p)
    df = df.withColumn("abs_error", F.abs(e))
    out = df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(1e-6))) * 100).alias("mape"),
        _r2(a, e).alias("r2"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(-e).alias("bias"),
        F.coalesce(F.try_divide(F.avg(-e), F.avg(a)) * 100, F.lit(0.0)).alias("bias_pct"),
    )
    medians = group_quantiles(df, list(by), {"median_ae": ("abs_error", 0.5)})
    if by:
        return join_keys(out, medians, list(by))
    return beside(out, medians)


def metric_variants(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MSE, MAPE without y = 0, raw MAPE, share within limits, mean and spread of both columns."""
    a, e = F.col(y), F.col(y) - F.col(p)
    return df.groupBy(*by).agg(
        F.avg(e * e).alias("mse"),
        (F.avg(F.when(a != 0, F.abs(e / a))) * 100).alias("mape_nonzero"),
        F.avg(a).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
        F.stddev_samp(a).alias("std_actual"),
        F.stddev_pop(p).alias("std_predicted"),
    )


def within_share(df: DataFrame, share: float = 0.05, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Percent of rows whose prediction is within ± share of the actual."""
    ratio = F.try_divide(F.abs(F.col(y) - F.col(p)), F.abs(F.col(y)))
    return df.groupBy(*by).agg((F.avg(flag(ratio <= share).cast("double")) * 100).alias("accuracy_pct"))


def pinball_loss(df: DataFrame, quantiles: Sequence[float], by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Pinball loss per quantile level."""
    e = F.col(y) - F.col(p)
    losses = [F.avg(F.greatest(q * e, (q - 1) * e)).alias(f"q{i}") for i, q in enumerate(quantiles)]
    wide = df.groupBy(*by).agg(*losses)
    rows = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q{i}").alias("pinball")) for i, q in enumerate(quantiles)]))
    return wide.select(*by, rows.alias("r")).select(*by, "r.quantile", "r.pinball")


def evening_metrics(
    df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred", hour: str = "hour", empty: float | None = None
) -> DataFrame:
    """Overall, evening (17-21) and peak-hour (19-20) metrics.

    An empty slice takes the overall value, or ``empty`` where given.
    """
    a, e = F.col(y), F.col(y) - F.col(p)
    ape = F.abs(F.try_divide(e, a)) * 100
    evening, peak = F.col(hour).between(17, 21), F.col(hour).between(19, 20)
    out = df.groupBy(*by).agg(
        F.avg(ape).alias("overall_mape"),
        F.avg(F.when(evening, ape)).alias("_evening"),
        F.avg(F.when(peak, ape)).alias("_peak"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        _r2(a, e).alias("r2"),
        _r2(F.when(evening, a), F.when(evening, e)).alias("_evening_r2"),
        F.count_if(evening).alias("evening_samples"),
        F.count(F.lit(1)).alias("validation_samples"),
    )
    fallback = F.col("overall_mape") if empty is None else F.lit(empty)
    return out.select(
        *by,
        "overall_mape",
        F.coalesce("_evening", fallback).alias("evening_peak_mape"),
        F.coalesce("_peak", fallback).alias("peak_hour_mape"),
        "rmse",
        "mae",
        "r2",
        F.when(F.col("evening_samples") > 0, F.col("_evening_r2")).otherwise(F.col("r2")).alias("evening_r2"),
        "evening_samples",
        "validation_samples",
    )


def error_slices(df: DataFrame, parts: dict[str, Column], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mean absolute and percent error per value of each slice, all slices in one pass."""
    e = F.abs(F.col(y) - F.col(p))
    work = df.select(
        *[c.cast("string").alias(n) for n, c in parts.items()],
        e.alias("_e"),
        F.try_divide(e, F.abs(F.col(y))).alias("_pe"),
    )
    names = list(parts)
    sliced = work.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.avg("_e").alias("mean_abs_error"),
        (F.avg("_pe") * 100).alias("mean_pct_error"),
        F.count(F.lit(1)).alias("n_rows"),
        F.grouping_id().alias("_g"),
    )
    top = len(names)
    which = F.coalesce(*[F.when(F.col("_g") == (2**top - 1 - 2 ** (top - 1 - i)), F.lit(n)) for i, n in enumerate(names)])
    value = F.coalesce(*[F.when(F.col("_g") == (2**top - 1 - 2 ** (top - 1 - i)), F.col(n)) for i, n in enumerate(names)])
    return sliced.select(
        which.alias("slice"), value.alias("slice_value"), "mean_abs_error", "mean_pct_error", "n_rows"
    )


def compare_models(metrics: DataFrame, names: Sequence[str], models: Sequence[str], digits: int = 3) -> DataFrame:
    """Metric x model table of a (model, metric columns) table."""
    long = metrics.unpivot(["model"], list(names), "metric", "value")
    return long.groupBy("metric").pivot("model", list(models)).agg(F.round(F.first("value"), digits))


def forecast_report(preds: DataFrame, target: float = 5.0) -> DataFrame:
    """Coverage by forecasts and the distribution of the improvement in percent."""
    x = F.col("improvement_pct")
    base = preds.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.countDistinct("zone").alias("n_zones"),
        F.countDistinct("horizon_hours").alias("n_horizons"),
        F.count_if(F.col("forecast_available")).alias("with_forecasts"),
        F.coalesce(F.avg(flag(F.col("forecast_available")).cast("double")) * 100, F.lit(0.0)).alias("coverage_pct"),
        F.avg(x).alias("mean_improvement_pct"),
        F.stddev_pop(x).alias("std_improvement_pct"),
        F.min(x).alias("min_improvement_pct"),
        F.max(x).alias("max_improvement_pct"),
        F.count_if(x > 0).alias("n_improved"),
        flag(F.avg(F.abs(x)) >= target).alias("target_achieved"),
    )
    return beside(base, group_quantiles(preds, [], {"median_improvement_pct": ("improvement_pct", 0.5)}))


def chart_errors(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mean, largest and smallest absolute error."""
    e = F.abs(F.col(y) - F.col(p))
    return df.groupBy(*by).agg(F.avg(e).alias("avg_error"), F.max(e).alias("max_error"), F.min(e).alias("min_error"))


def before_after(df: DataFrame, actual: float | Column) -> DataFrame:
    """Totals of the baseline and improved runs of a composite against the actual load."""
    a = F.lit(actual) if not isinstance(actual, Column) else actual
    out = df.agg(F.sum("baseline").alias("baseline_total"), F.sum("improved").alias("improved_total"))
    b, i = F.col("baseline_total"), F.col("improved_total")
    out = out.withColumns(
        {
            "actual_load": a,
            "baseline_error_pct": (b - a) / a * 100,
            "improved_error_pct": (i - a) / a * 100,
            "accuracy_improvement_ratio": F.when(i > 0, b / i).otherwise(1.0),
        }
    )
    return out.withColumns(
        {
            "error_reduction_pct": F.abs("baseline_error_pct") - F.abs("improved_error_pct"),
            "target_met": flag(F.abs("improved_error_pct") < F.abs("baseline_error_pct")),
        }
    )
