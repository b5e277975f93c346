"""Scoring: recursive and direct forecasts, backtests, batch scoring, model evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.core.series import join_keys
from gridweave.functions import calendar as cal
from gridweave.operators import metrics as mt
from gridweave.operators.joins import expand_horizons, latest_lags, nearest_join
from gridweave.operators.smoothing import recursive_smoothing
from gridweave.operators.windows import downsample
from gridweave.plans.boosting import Forest, model_names
from gridweave.plans.features import ForecastConfig, forecast_feature_names, forecast_features, one_forecast
from gridweave.plans.forecast import ensemble, improvement_pct, pick_model
from gridweave.plans.training import score_zones, score_zones_by


def horizon_features(
    load: DataFrame,
    weather: DataFrame | None,
    horizons: Sequence[int],
    defaults: tuple[float, float] = (20.0, 50.0),
    forecast: DataFrame | None = None,
    config: ForecastConfig = ForecastConfig(),
) -> DataFrame:
    """One row per zone and horizon: calendar of the target time, latest lags, nearest weather, and with ``forecast`` the
    forecast columns of the target time (null where there is no forecast for it)."""
    rows = expand_horizons(latest_lags(load, (1, 24)), horizons).withColumnRenamed("timestamp", "issued_at")
    rows = rows.withColumnRenamed("target_time", "timestamp")
    if weather is not None:
        rows = nearest_join(rows, weather.select("zone", "timestamp", "temp_c", "humidity")).withColumn(
            "forecast_available", F.col("matched_at").isNotNull()
        ).drop("matched_at")
    else:
        rows = rows.withColumns({"temp_c": F.lit(None).cast("double"), "humidity": F.lit(None).cast("double"), "forecast_available": F.lit(False)})
    rows = rows.withColumns({"temp_c": F.coalesce("temp_c", F.lit(defaults[0])), "humidity": F.coalesce("humidity", F.lit(defaults[1]))})
    if forecast is not None:
        feats = forecast_features(one_forecast(forecast), config)
        names = [c for c in forecast_feature_names(config) if c in feats.columns]
        rows = join_keys(rows, feats.select("zone", "timestamp", *names), ["zone", "timestamp"], "left")
    return cal.extreme_temporal_features(cal.cyclic_parts(cal.calendar_parts(rows)))


def direct_forecast(
    rows: DataFrame,
    models: dict[str, dict[str, PipelineModel]] | DataFrame,
    levels: Sequence[float] = (0.68, 0.95),
    choice: str = "enhanced",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Predictions of the baseline, enhanced and third model per zone and horizon, the chosen one, and its intervals.

    ``prediction`` follows the fallback chain of ``choice``, or with ``weights`` is their weighted mean over the models that have
    a prediction. ``metadata`` names the model used, the models that had a prediction, and whether weather was found.
    """
    names = ("baseline", "enhanced", "third")
    out = score_zones_by(rows, models)
    present = model_names(models) if isinstance(models, DataFrame) else list(models)
    absent = [m for m in names if m not in present]
    out = out.withColumns({m: F.lit(None).cast("double") for m in absent})
    main = ensemble(weights) if weights else pick_model(choice)
    chain = F.coalesce(*[F.when(F.col(m) == main, F.lit(m)) for m in (choice, *reversed(names))])
    had = F.array_join(F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in names])), ",")
    available = F.col("forecast_available") if "forecast_available" in rows.columns else F.lit(False)
    meta = F.create_map(
        F.lit("model"), F.when(main.isNotNull(), F.lit("ensemble") if weights else chain),
        F.lit("models"), had,
        F.lit("weather_found"), available.cast("string"),
    )
    bands = F.create_map(
        *[x for l in levels for x in (F.lit(float(l)), F.struct((main - main * 0.10 * (l / 0.95)).alias("lo"), (main + main * 0.10 * (l / 0.95)).alias("hi")))]
    )
    out = out.withColumns({"prediction": main, "intervals": bands, "metadata": meta})
    if {"enhanced", "baseline"} <= set(present):
        out = out.withColumn("improvement_pct", improvement_pct())
    return out.drop(*absent)


def recursive_forecast(latest: DataFrame, models: DataFrame, hours: int = 24, lag: str = "load_lag_1h") -> DataFrame:
    """(zone, timestamp, hour_ahead, predicted_load) hour by hour, the prediction becoming the next ``lag``.

    ``latest`` holds one row per zone with ``issued_at``, its lags and weather, which stay as they are; ``models`` is a table of
    one boosted model for each zone. The rows of all hours get their calendar columns first and meet again by zone, so the hours of
    a zone run inside one task, in one job. A zone without a model has null predictions. Rows that repeat a zone are separate runs.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(hours)))
    rows = latest.withColumn("run__", F.monotonically_increasing_id()).withColumn("hour_ahead", steps)
    rows = rows.withColumn("timestamp", F.col("issued_at") + F.make_dt_interval(hours=F.col("hour_ahead")))
    rows = cal.cyclic_parts(cal.calendar_parts(rows))
    used = sorted({c for r in models.select("columns").distinct().toLocalIterator() for c in r["columns"]})
    numbers = F.transform(F.array(*[F.col(c).cast("double") for c in used]), lambda x: F.coalesce(x, F.lit(float("nan"))))
    runs = rows.groupBy("zone", "run__").agg(F.array_sort(F.collect_list(F.struct("hour_ahead", "timestamp", numbers.alias("x")))).alias("steps"))
    own = models.drop("fold").withColumnRenamed("zone", "of")
    met = runs.join(own, F.col("zone") == F.col("of"), "left").drop("of", "run__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                forest, before = Forest(row) if row["columns"] is not None else None, None
                for step in row["steps"]:
                    x = dict(zip(used, step["x"]))
                    if before is not None and lag in x:
                        x[lag] = before
                    before = float(forest.predict(np.array([[x[c] for c in forest.columns]]))[0]) if forest else None
                    out.append({"zone": row["zone"], "timestamp": step["timestamp"], "hour_ahead": step["hour_ahead"], "predicted_load": before})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("zone", pa.string()), ("timestamp", pa.timestamp("us", "UTC")), ("hour_ahead", pa.int32()), ("predicted_load", pa.float64())]))

    return met.mapInArrow(run, "zone string, timestamp timestamp, hour_ahead int, predicted_load double")


def backtest(rows: DataFrame, models: dict[str, PipelineModel] | DataFrame, points: int = 300) -> DataFrame:
    """One-step predictions of all past rows, smoothed and thinned to chart points."""
    chart = score_zones(rows, models, "predicted_load")
    chart = recursive_smoothing(chart, "predicted_load")
    return downsample(chart, points).withColumn("abs_error", F.abs(F.col("predicted_load_smoothed") - F.col("load")))


def finite(columns: Sequence[str]) -> Column:
    """Whether none of the columns is null, NaN or infinite."""
    ok = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return ok


def score_batch(rows: DataFrame, models: DataFrame, features: Sequence[str]) -> DataFrame:
    """Saved models (a table with one for each zone) over supplied rows; rows with a null, NaN or infinite feature are refused."""
    return score_zones(rows.where(finite(features)), models)


def evaluate(rows: DataFrame, models: dict[str, dict[str, PipelineModel]] | DataFrame, target: str = "load") -> DataFrame:
    """Core metrics of several models over the same rows."""
    names = model_names(models) if isinstance(models, DataFrame) else list(models)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_{n}").alias("prediction")) for n in names]))
    marked = models.withColumn("model", F.concat(F.lit("_"), "model")) if isinstance(models, DataFrame) else {f"_{n}": m for n, m in models.items()}
    both = score_zones_by(rows, marked).select(target, each.alias("_one")).select("_one.model", target, "_one.prediction").where("prediction is not null")
    return mt.core_metrics(both, ["model"], target, "prediction")
