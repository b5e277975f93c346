"""Queries that train or apply models.

The library's own profiles have no SQL form; tests check them. Boosting itself is checked by SQL with trees of one split.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridweave.functions import calendar as cal
from gridweave.operators import aggregates as ag
from gridweave.operators import clean as cl
from gridweave.operators import metrics as mt
from gridweave.operators import quality as dq
from gridweave.operators import weights as wt
from gridweave.operators import windows as wn
from gridweave.operators.joins import latest_lags, latest_per_key
from gridweave.plans import boosting as bo
from gridweave.plans import features as pf
from gridweave.plans import forecast as fc
from gridweave.plans import scoring as sc
from gridweave.plans import training as tr
from gridweave.session import stored
from workload.harness import ORACLES, query

FEATURES = ["hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos", "load_lag_1h", "load_lag_24h"]
ENHANCED = [*FEATURES, "temp_c", "humidity", "hour_cubed", "midday_peak", "afternoon_peak", "overnight_low"]
CALENDAR = ("hour", "day_of_week", "is_weekend")
CONSERVATIVE = bo.PROFILES["conservative"]
LEAF_WISE = replace(bo.PROFILES["leaf_wise"], categories=CALENDAR)
THREE = {"baseline": (FEATURES, CONSERVATIVE), "enhanced": (ENHANCED, CONSERVATIVE), "third": (FEATURES, LEAF_WISE)}

_tables: dict[tuple, tuple] = {}


def training_table(v):
    """Feature rows of all zones with weights and a time-ordered split."""
    df = pf.hourly_model_table(v.load_raw.where("zone is not null"), v.weather_hourly)
    df = cal.extreme_temporal_features(cal.cyclic_parts(df))
    df = wn.split_by_position(wt.step_weights(df), [("train", 0.8), ("val", 1.0)])
    return stored(df.withColumn("is_val", F.col("split") == "val"))


def trained(v):
    """(training table, table of the three models), made once for the queries of a session over the same files."""
    key = (v.spark.sparkContext.applicationId, v.dir)
    if key not in _tables:
        df = training_table(v)
        _tables[key] = df, bo.fit_boosted(df, THREE, "load", "sample_weight", "is_val")
    return _tables[key]


def only(models, name):
    return models.where(F.col("model") == name)


@query("ml04_scaled_features", dbl="scaled_norm")
def _(v):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    df = tr.weigh_lags(training_table(v), FEATURES, 0.3)
    stages, out = tr.scaling_stages(FEATURES, "robust")
    scaled = Pipeline(stages=stages).fit(df.where("not is_val")).transform(df)
    norm = F.aggregate(vector_to_array(out), F.lit(0.0), lambda a, x: a + x * x)
    return scaled.select("zone", "timestamp", F.sqrt(norm).alias("scaled_norm"))


@query(
    "ml04_robust_scale_exact",
    """WITH q AS (SELECT zone, quantile_cont(load, 0.5) AS m, quantile_cont(load, 0.75) - quantile_cont(load, 0.25) AS w FROM load_hourly GROUP BY zone)
        SELECT zone, "timestamp", CASE WHEN w > 0 THEN (load - m) / w END AS load_scaled FROM load_hourly JOIN q USING (zone)""",
    dbl="load_scaled",
)
def _(v):
    return tr.robust_scaled(v.load_hourly, ["load"]).select("zone", "timestamp", "load_scaled")


@query(
    "ml07_linear_one_feature",
    """WITH r AS (SELECT l.zone, l."timestamp", l.load, w.temp_c FROM load_hourly l JOIN weather_hourly w ON l.zone = w.zone AND l."timestamp" = w."timestamp"),
        f AS (SELECT zone, regr_slope(load, temp_c) AS a, regr_intercept(load, temp_c) AS b FROM r GROUP BY zone)
        SELECT zone, "timestamp", round(b + a * temp_c, 3) AS prediction FROM r JOIN f USING (zone)""",
    dbl="prediction",
)
def _(v):
    df = stored(v.load_hourly.join(v.weather_hourly.select("zone", "timestamp", "temp_c"), ["zone", "timestamp"]))
    models = tr.fit_zones(df, lambda z: tr.linear(["temp_c"]), tr.zones_of(df))
    return tr.score_zones(df, models).select("zone", "timestamp", F.round("prediction", 3).alias("prediction"))


@query("ml05_zone_boosting", dbl="load prediction")
def _(v):
    df, models = trained(v)
    return tr.score_zones(df.where("is_val"), only(models, "enhanced")).select("zone", "timestamp", "load", "prediction")


@query("ml06_categorical_boosting", dbl="load prediction")
def _(v):
    df, models = trained(v)
    return tr.score_zones(df.where("is_val"), only(models, "third")).select("zone", "timestamp", "load", "prediction")


@query("ml07_algorithm_comparison", dbl="mae rmse mape r2 max_error bias bias_pct median_ae")
def _(v):
    df, boosted = trained(v)
    zones, train, val = tr.zones_of(df), df.where("not is_val"), df.where("is_val")
    models = {
        "forest": tr.fit_zones(train, lambda z: tr.forest(ENHANCED), zones),
        "linear": tr.fit_zones(train, lambda z: tr.linear(ENHANCED, weight="sample_weight"), zones),
    }
    return sc.evaluate(val, models).unionByName(sc.evaluate(val, only(boosted, "enhanced").withColumn("model", F.lit("boosted"))))


@query("ml08_random_search", dbl="mean_mape rate row_share column_share alpha lam")
def _(v):
    return tr.search(trained(v)[0], FEATURES, tr.random_settings(18), folds=5, weight="sample_weight")


@query("ml11_recursive_forecast", dbl="predicted_load")
def _(v):
    df, _ = trained(v)
    names = ["hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos", "load_lag_1h", "load_lag_24h", "temp_c", "humidity"]
    models = bo.fit_boosted(df, {"hourly": (names, CONSERVATIVE)}, "load", "sample_weight", "is_val")
    lags = latest_lags(v.load_hourly, (1, 24)).withColumnRenamed("timestamp", "issued_at")
    current = latest_per_key(v.weather_hourly, ["zone"], ["timestamp"]).select("zone", "temp_c", "humidity")
    return sc.recursive_forecast(lags.join(current, "zone"), models, 24)


def forecast_rows(v):
    rows = sc.horizon_features(v.load_hourly, v.weather_hourly, (1, 6, 12, 24, 48), forecast=v.forecast_hourly)
    return sc.direct_forecast(rows, trained(v)[1], weights=fc.ENSEMBLES["service"])


@query("ml12_direct_forecast", dbl="baseline enhanced third prediction improvement_pct lo95 hi95 temp_forecast_6h")
def _(v):
    out = forecast_rows(v)
    band = F.col("intervals")[F.lit(0.95)]
    return out.select(
        "zone", "timestamp", "horizon_hours", "baseline", "enhanced", "third", "prediction", "improvement_pct", "temp_forecast_6h",
        F.col("metadata")["model"].alias("model"), F.col("metadata")["models"].alias("models"),
        band["lo"].alias("lo95"), band["hi"].alias("hi95"),
    )


@query(
    "ml12_forecast_arithmetic",
    """WITH l AS (SELECT zone, max("timestamp") AS t FROM load_hourly GROUP BY zone)
        SELECT zone, h AS horizon_hours, t + to_hours(h) AS "timestamp", 'ensemble' AS model, 'baseline,enhanced,third' AS models,
            true AS weighted, true AS improved, true AS banded FROM l, (VALUES (1), (6), (12), (24), (48)) hs(h)""",
    lng="horizon_hours",
)
def _(v):
    out = forecast_rows(v)
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.abs(b) + 1e-9
    mean = 0.25 * F.col("baseline") + 0.35 * F.col("enhanced") + 0.40 * F.col("third")
    gain = (F.col("enhanced") - F.col("baseline")) / F.col("baseline") * 100
    band = F.col("intervals")[F.lit(0.95)]
    return out.select(
        "zone", "horizon_hours", "timestamp", F.col("metadata")["model"].alias("model"), F.col("metadata")["models"].alias("models"),
        near(F.col("prediction"), mean).alias("weighted"), near(F.col("improvement_pct"), gain).alias("improved"),
        (near(band["lo"], F.col("prediction") * 0.9) & near(band["hi"], F.col("prediction") * 1.1)).alias("banded"),
    )


@query("ml13_temporal_sensitivity", dbl="variation_pct")
def _(v):
    df, models = trained(v)
    return tr.temporal_sensitivity(latest_per_key(df, ["zone"], ["timestamp"]), only(models, "enhanced"), ENHANCED, range(24))


@query("ml15_backtest_chart", dbl="load predicted_load predicted_load_smoothed abs_error")
def _(v):
    df, models = trained(v)
    rows = df.select("zone", "timestamp", "load", *FEATURES)
    chart = sc.backtest(rows, only(models, "baseline"), 100)
    return chart.select("zone", "timestamp", "load", "predicted_load", "predicted_load_smoothed", "abs_error")


@query("ml17_batch_scoring", dbl="load prediction")
def _(v):
    df, models = trained(v)
    rows = df.withColumn("load_lag_1h", F.when(F.col("hour") != 3, F.col("load_lag_1h")).otherwise(float("inf")))
    return sc.score_batch(rows, only(models, "baseline"), FEATURES).select("zone", "timestamp", "load", "prediction")


@query(
    "ml17_refused_rows",
    f"""SELECT zone, "timestamp" FROM ({ORACLES['pip06_hourly_model_table']}) WHERE extract(hour FROM "timestamp") = 3""",
)
def _(v):
    df, models = trained(v)
    rows = df.withColumn("load_lag_1h", F.when(F.col("hour") != 3, F.col("load_lag_1h")).otherwise(float("inf")))
    kept = sc.score_batch(rows, only(models, "baseline"), FEATURES).select("zone", "timestamp")
    return rows.select("zone", "timestamp").join(kept, ["zone", "timestamp"], "left_anti")


@query("ml19_feature_importance", dbl="importance")
def _(v):
    return tr.top_features(tr.importances(v.spark, only(trained(v)[1], "enhanced")), 10)


@query("ml19_importance_balance", dbl="lag_share temporal_share weather_share")
def _(v):
    return tr.importance_balance(tr.importances(v.spark, only(trained(v)[1], "enhanced")))


@query("pip08_train_and_validate", dbl="overall_mape evening_peak_mape peak_hour_mape rmse mae r2 evening_r2")
def _(v):
    ranges = v.spark.createDataFrame([("SCE", 1000.0, 1500.0), ("SP15", 1000.0, 1500.0)], "zone string, lo double, hi double")
    df = cal.strong_evening_features(cl.in_load_range(v.load_hourly, ranges))

    def build(s):
        return {
            **wn.lag_columns(s, "load", (1, 2, 3, 6, 12, 24)),
            **wn.rolling_columns(s, "load", (6, 12, 24), ("mean", "std"), "load_rolling_{stat}_{n}h", least=1),
        }

    df = wt.decay_weights(wn.over_series(df, build, back=24).dropna())
    df = wn.split_by_position(df, [("train", 0.8), ("val", 1.0)])
    df = stored(df.withColumn("is_val", F.col("split") == "val"))
    names = ["hour", "is_weekend", "evening_hour_intensity", "hour_sin", "hour_cos", "load_lag_1h", "load_lag_24h", "load_rolling_mean_24h"]
    third = replace(bo.PROFILES["refresh_leaves"], categories=("hour", "is_weekend"))
    models = {"enhanced": (names, bo.PROFILES["refresh_levels"]), "third": (names, third)}
    val = tr.score_zones_by(df.where("is_val"), bo.fit_boosted(df, models, "load", "sample_weight", "is_val"))
    val = val.withColumn("prediction", fc.ensemble(fc.ENSEMBLES["strong_evening"], (0, 50000)))
    return mt.evening_metrics(val, ["zone"], "load", "prediction")


@query("pip09_model_evaluation", dbl="baseline enhanced")
def _(v):
    df, models = trained(v)
    metrics = sc.evaluate(df.where("is_val"), models)
    return mt.compare_models(metrics, ["mae", "rmse", "mape", "r2", "max_error", "median_ae", "bias"], ["baseline", "enhanced"])


@query(
    "pip10_forecast_run",
    dbl="coverage_pct mean_improvement_pct std_improvement_pct min_improvement_pct max_improvement_pct median_improvement_pct",
)
def _(v):
    return mt.forecast_report(stored(forecast_rows(v).drop("intervals", "metadata")))


@query("pip11_regional_comparison", dbl="mae rmse mape r2 max_error bias bias_pct median_ae peak_load min_load avg_load load_std")
def _(v):
    df = trained(v)[0]
    train, test = df.where("not is_val"), df.where("is_val")
    zones = tr.zones_of(train, 100)
    models = tr.fit_zones(train, lambda z: tr.forest(ENHANCED), zones)
    scored = tr.score_zones(test, models).where("prediction is not null")
    metrics = mt.core_metrics(scored, ["zone"], "load", "prediction")
    # Zones with too few rows to train on are reported, not left out.
    status = F.when(F.col("mae").isNull(), "no model").otherwise("ok")
    return ag.zone_extremes(df).join(metrics, "zone", "left").withColumn("status", status)


@query("pip12_retraining", dbl="mape r2 variation_pct")
def _(v):
    kept = wt.hybrid_training_rows(v.load_hourly, core_days=720)
    weather = v.weather_hourly.withColumnRenamed("wind_speed", "wind_speed_kmh")
    df = pf.unified_features(kept, weather, v.forecast_hourly)
    df = cal.extreme_temporal_features(cal.enhanced_temporal_features(df))
    df = wt.month_split(df, F.unix_seconds("timestamp"), "timestamp")
    df = stored(df.withColumn("is_val", F.col("split") == "val").dropna(subset=ENHANCED))
    models = bo.fit_boosted(df, {"prediction": (ENHANCED, CONSERVATIVE)}, "load", holdout="is_val")
    metrics = mt.core_metrics(tr.score_zones(df.where("is_val"), models), ["zone"], "load", "prediction").select("zone", "mape", "r2")
    base = latest_per_key(df, ["zone"], ["timestamp"])
    spread = tr.temporal_sensitivity(base, models, ENHANCED, weekend=False).select("zone", "variation_pct")
    out = metrics.join(spread, "zone")
    return out.withColumn("passed", ((F.col("mape") <= 2.0) & (F.col("variation_pct") >= 3.5)).cast("int"))
