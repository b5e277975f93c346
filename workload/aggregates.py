"""Checked queries: resampling, averages, profiles, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import catalog as ct
from gridweave.functions import calendar as cal
from gridweave.operators import aggregates as ag
from gridweave.operators import metrics as mt
from gridweave.operators import weights as wt
from gridweave.operators.quality import grade
from gridweave.plans import forecast as fc
from workload.features import SPINE, TS, parts
from workload.harness import query
from workload.windows import Z

MAPPED = "(SELECT * FROM load_raw WHERE zone IS NOT NULL)"


@query(
    "agg01_hourly_resample",
    f"WITH {SPINE} SELECT s.zone, s.{TS}, r.load FROM spine s LEFT JOIN raw r ON s.zone = r.zone AND s.{TS} = r.{TS}",
    dbl="load",
)
def _(v):
    return ag.hourly_mean(v.load_raw.where("zone is not null"))


_W = "(VALUES " + ", ".join(f"('{z}', {w})" for z, w in ct.LOAD_WEIGHTS.items()) + ") AS wt(zone, weight)"


@query(
    "agg02_weighted_average",
    f"""SELECT {TS}, sum(temp_c * weight) / sum(CASE WHEN temp_c IS NOT NULL THEN weight END) AS temp_c,
        sum(hum * weight) / sum(CASE WHEN hum IS NOT NULL THEN weight END) AS humidity
        FROM (SELECT *, CASE WHEN humidity > 30 THEN humidity END AS hum FROM weather_hourly) JOIN {_W} USING (zone) GROUP BY 1""",
    dbl="temp_c humidity",
)
def _(v):
    weights = ct.pairs_table(v.spark, ct.LOAD_WEIGHTS, "zone", "weight")
    df = v.weather_hourly.withColumn("humidity", F.when(F.col("humidity") > 30, F.col("humidity")))
    return ag.weighted_average(df, weights, ["temp_c", "humidity"])


_POP = {"NP15": "WEST", "SCE": "NYNYC", "SMUD": "LONGIL", "SP15": "HUD VL"}


@query(
    "agg02_population_weighted",
    f"""SELECT {TS}, sum(temp_c * w) / sum(w) AS temp_c FROM (SELECT *, CASE zone """
    + " ".join(f"WHEN '{z}' THEN {ct.POPULATION_WEIGHTS[p]}" for z, p in _POP.items())
    + " END AS w FROM weather_hourly) GROUP BY 1",
    dbl="temp_c",
)
def _(v):
    weights = ct.pairs_table(v.spark, ct.POPULATION_WEIGHTS, "zone", "weight")
    df = v.weather_hourly.withColumn("zone", ct.lookup(_POP, F.col("zone")))
    return ag.weighted_average(df, weights, ["temp_c"])


@query(
    "agg03_simple_average",
    f"SELECT {TS}, avg(temp_c) AS temp_c, avg(humidity) AS humidity, avg(wind_speed) AS wind_speed FROM weather_hourly GROUP BY 1",
    dbl="temp_c humidity wind_speed",
)
def _(v):
    return ag.simple_average(v.weather_hourly, ["temp_c", "humidity", "wind_speed"])


@query(
    "agg04_dataset_profile",
    f"""SELECT count(*) AS n_rows, min({TS}) AS first_ts, max({TS}) AS last_ts, count(DISTINCT zone) AS n_zones, count(load) AS value_count,
        avg(load) AS value_mean, stddev_samp(load) AS value_std, min(load) AS value_min, max(load) AS value_max,
        count(*) FILTER ({TS} IS NULL) AS null_timestamp, count(*) FILTER (load IS NULL) AS null_load,
        count(*) FILTER (resource_name IS NULL) AS null_resource_name, count(*) FILTER (seq IS NULL) AS null_seq,
        count(*) FILTER (zone IS NULL) AS null_zone, quantile_cont(load, 0.25) AS value_p25, quantile_cont(load, 0.5) AS value_p50,
        quantile_cont(load, 0.75) AS value_p75 FROM load_raw""",
    dbl="value_mean value_std value_min value_max value_p25 value_p50 value_p75",
    lng="n_rows n_zones value_count null_timestamp null_load null_resource_name null_seq null_zone",
)
def _(v):
    return ag.dataset_profile(v.load_raw)


@query(
    "agg04_zone_shares",
    "SELECT zone, count(*) AS n_rows, count(*) / (SELECT count(*) FROM load_raw) AS share FROM load_raw GROUP BY zone",
    dbl="share",
    lng="n_rows",
)
def _(v):
    return ag.zone_shares(v.load_raw)


@query(
    "agg05_zone_summary",
    f"""SELECT zone, arg_max(load, {TS}) AS current_load, avg(load) AS avg_load, max(load) AS peak_load, arg_max(load, {TS}) * 1.05 AS predicted_load,
        CASE zone {' '.join(f"WHEN '{z}' THEN {w}" for z, w in ct.LOAD_WEIGHTS.items())} ELSE 0.1 END AS load_weight FROM load_hourly GROUP BY zone""",
    dbl="current_load avg_load peak_load predicted_load load_weight",
)
def _(v):
    return ag.zone_summary(v.load_hourly)


@query(
    "agg06_seasonal_profile",
    f"""WITH m AS (SELECT zone, extract(month FROM {TS}) AS month, avg(load) AS m FROM load_daily GROUP BY 1, 2),
        y AS (SELECT zone, count(DISTINCT extract(year FROM {TS})) AS years_covered FROM load_daily GROUP BY 1)
        SELECT zone, count(*) AS months_covered, max(years_covered) AS years_covered, (max(m) - min(m)) / avg(m) * 100 AS seasonal_variation_pct
        FROM m JOIN y USING (zone) GROUP BY zone""",
    dbl="seasonal_variation_pct",
    lng="months_covered years_covered",
)
def _(v):
    return ag.seasonal_profile(v.load_daily)


@query(
    "agg07_hour_profile",
    f"SELECT zone, extract(hour FROM {TS}) AS hour, avg(load) AS mean_load FROM load_hourly GROUP BY 1, 2",
    dbl="mean_load",
    lng="hour",
)
def _(v):
    return ag.load_profile(v.load_hourly, F.hour("timestamp"), "hour")


@query(
    "agg07_weekday_profile",
    f"SELECT zone, extract(isodow FROM {TS}) - 1 AS day_of_week, avg(load) AS mean_load FROM load_hourly GROUP BY 1, 2",
    dbl="mean_load",
    lng="day_of_week",
)
def _(v):
    return ag.load_profile(v.load_hourly, F.weekday("timestamp"), "day_of_week")


@query(
    "agg07_peak_and_valley",
    f"""WITH h AS (SELECT zone, extract(hour FROM {TS}) AS hour, avg(load) AS m FROM load_hourly GROUP BY 1, 2)
        SELECT zone, arg_max(hour, m) AS peak_hour, arg_min(hour, m) AS valley_hour FROM h GROUP BY zone""",
    lng="peak_hour valley_hour",
)
def _(v):
    return ag.peak_and_valley(v.load_hourly)


_LW = f"""SELECT l.zone, l.{TS}, l.load, w.temp_c FROM load_hourly l JOIN weather_hourly w ON l.zone = w.zone AND l.{TS} = w.{TS}"""
_BINS = f"""SELECT greatest(ceil((temp_c - lo) / ((hi - lo) / 15)) - 1, 0) AS temp_bin, avg(temp_c) AS mean_temp, avg(load) AS mean_load,
    avg(greatest(temp_c - 18, 0)) AS mean_cooling, avg(greatest(18 - temp_c, 0)) AS mean_heating
    FROM ({_LW}), (SELECT min(temp_c) AS lo, max(temp_c) AS hi FROM ({_LW})) GROUP BY 1"""


def load_weather(v):
    return v.load_hourly.join(v.weather_hourly.select("zone", "timestamp", "temp_c"), ["zone", "timestamp"])


@query("agg08_temperature_response", _BINS, dbl="mean_temp mean_load mean_cooling mean_heating", lng="temp_bin")
def _(v):
    return ag.temperature_response(load_weather(v))


@query(
    "agg08_balance_temperature",
    f"""SELECT (SELECT arg_min(mean_temp, mean_load) FROM ({_BINS})) AS balance_temp, (SELECT min(mean_load) FROM ({_BINS})) AS min_mean_load,
        avg(CASE WHEN temp_c > 25 THEN load END) AS hot_load, avg(CASE WHEN temp_c < 10 THEN load END) AS cold_load,
        avg(CASE WHEN temp_c BETWEEN 15 AND 20 THEN load END) AS mild_load FROM ({_LW})""",
    dbl="balance_temp min_mean_load hot_load cold_load mild_load",
)
def _(v):
    return ag.balance_temperature(load_weather(v))


_SLICES = {
    "month": f"extract(month FROM {TS})", "day_of_week": f"extract(isodow FROM {TS}) - 1",
    "is_weekend": f"CASE WHEN extract(isodow FROM {TS}) >= 6 THEN 1 ELSE 0 END", "zone": "zone",
}


@query(
    "agg09_error_slices",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS slice, CAST({e} AS VARCHAR) AS slice_value, avg(abs(y_true - y_pred)) AS mean_abs_error,
            avg(abs(y_true - y_pred) / nullif(abs(y_true), 0)) * 100 AS mean_pct_error, count(*) AS n_rows FROM pred_panel GROUP BY 2"""
        for n, e in _SLICES.items()
    ),
    dbl="mean_abs_error mean_pct_error",
    lng="n_rows",
)
def _(v):
    day = F.weekday("timestamp")
    return mt.error_slices(
        v.pred_panel,
        {"month": F.month("timestamp"), "day_of_week": day, "is_weekend": (day >= 5).cast("int"), "zone": F.col("zone")},
    )


_CORE = """avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse,
    avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-6)) * 100 AS mape,
    CASE WHEN var_pop(y_true) > 0 THEN 1 - avg(pow(y_true - y_pred, 2)) / var_pop(y_true) ELSE 0 END AS r2,
    max(abs(y_true - y_pred)) AS max_error, avg(y_pred - y_true) AS bias, avg(y_pred - y_true) / avg(y_true) * 100 AS bias_pct,
    quantile_cont(abs(y_true - y_pred), 0.5) AS median_ae"""
_CORE_COLS = "mae rmse mape r2 max_error bias bias_pct median_ae"


@query("agg10_core_metrics", f"SELECT {_CORE} FROM pred_panel", dbl=_CORE_COLS)
def _(v):
    return mt.core_metrics(v.pred_panel)


@query("agg10_core_metrics_by_zone", f"SELECT zone, {_CORE} FROM pred_panel GROUP BY zone", dbl=_CORE_COLS)
def _(v):
    return mt.core_metrics(v.pred_panel, ["zone"])


@query(
    "agg11_metric_variants",
    """SELECT zone, avg(pow(y_true - y_pred, 2)) AS mse, avg(CASE WHEN y_true <> 0 THEN abs((y_true - y_pred) / y_true) END) * 100 AS mape_nonzero,
        avg(y_true) AS mean_actual, avg(y_pred) AS mean_predicted, stddev_samp(y_true) AS std_actual, stddev_pop(y_pred) AS std_predicted
        FROM (SELECT zone, CASE WHEN l_linenumber = 7 THEN 0 ELSE y_true / 1000 END AS y_true, y_pred / 1000 AS y_pred FROM pred_panel) GROUP BY zone""",
    dbl="mse mape_nonzero mean_actual mean_predicted std_actual std_predicted",
)
def _(v):
    zeroed = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("y_true") / 1000)
    return mt.metric_variants(v.pred_panel.withColumns({"y_true": zeroed, "y_pred": F.col("y_pred") / 1000}), ["zone"])


@query(
    "agg12_pinball_loss",
    """SELECT zone, q AS quantile, avg(greatest(q * (y_true - y_pred), (q - 1) * (y_true - y_pred))) AS pinball
        FROM pred_panel, (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.9)) t(q) GROUP BY 1, 2""",
    dbl="quantile pinball",
)
def _(v):
    return mt.pinball_loss(v.pred_panel, [0.1, 0.5, 0.9], ["zone"])


# The panel is daily; the part key stands in for the hour.
_HOURED = "SELECT *, l_orderkey % 24 AS hour FROM pred_panel"


def houred(v):
    return v.pred_panel.withColumn("hour", (F.col("l_orderkey") % 24).cast("int"))


@query(
    "agg13_evening_metrics",
    f"""WITH p AS (SELECT zone, hour, y_true AS a, y_true - y_pred AS e FROM ({_HOURED}))
        SELECT zone, avg(abs(e / a)) * 100 AS overall_mape, avg(CASE WHEN hour BETWEEN 17 AND 21 THEN abs(e / a) END) * 100 AS evening_peak_mape,
        avg(CASE WHEN hour BETWEEN 19 AND 20 THEN abs(e / a) END) * 100 AS peak_hour_mape, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
        1 - avg(e * e) / var_pop(a) AS r2, 1 - avg(CASE WHEN hour BETWEEN 17 AND 21 THEN e * e END) / var_pop(CASE WHEN hour BETWEEN 17 AND 21 THEN a END) AS evening_r2,
        count(*) FILTER (hour BETWEEN 17 AND 21) AS evening_samples, count(*) AS validation_samples FROM p GROUP BY zone""",
    dbl="overall_mape evening_peak_mape peak_hour_mape rmse mae r2 evening_r2",
    lng="evening_samples validation_samples",
)
def _(v):
    return mt.evening_metrics(houred(v), ["zone"])


@query(
    "agg14_within_five_percent",
    "SELECT zone, avg(CASE WHEN abs(y_true - y_pred) / abs(y_true) <= 0.05 THEN 1.0 ELSE 0.0 END) * 100 AS accuracy_pct FROM pred_panel GROUP BY zone",
    dbl="accuracy_pct",
)
def _(v):
    return mt.within_share(v.pred_panel, 0.05, ["zone"])


@query(
    "agg15_model_comparison",
    """WITH m AS (SELECT zone, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, max(abs(y_true - y_pred)) AS max_error
            FROM pred_panel GROUP BY zone),
        l AS (SELECT zone, 'mae' AS metric, mae AS x FROM m UNION ALL SELECT zone, 'rmse', rmse FROM m UNION ALL SELECT zone, 'max_error', max_error FROM m)
        SELECT metric, round(max(CASE WHEN zone = 'A' THEN x END), 3) AS A, round(max(CASE WHEN zone = 'N' THEN x END), 3) AS N,
               round(max(CASE WHEN zone = 'R' THEN x END), 3) AS R FROM l GROUP BY metric""",
    dbl="A N R",
)
def _(v):
    metrics = mt.core_metrics(v.pred_panel, ["zone"]).withColumnRenamed("zone", "model")
    return mt.compare_models(metrics, ["mae", "rmse", "max_error"], ["A", "N", "R"])


@query(
    "agg16_forecast_report",
    """WITH p AS (SELECT zone, l_linenumber AS horizon_hours, l_linenumber < 5 AS ok, (y_pred - y_true) / y_true * 100 AS x FROM pred_panel)
        SELECT count(*) AS total_predictions, count(DISTINCT zone) AS n_zones, count(DISTINCT horizon_hours) AS n_horizons,
        count(*) FILTER (ok) AS with_forecasts, 100.0 * count(*) FILTER (ok) / count(*) AS coverage_pct, avg(x) AS mean_improvement_pct,
        stddev_pop(x) AS std_improvement_pct, min(x) AS min_improvement_pct, max(x) AS max_improvement_pct, count(*) FILTER (x > 0.000001) AS n_improved,
        CASE WHEN avg(abs(x)) >= 5 THEN 1 ELSE 0 END AS target_achieved, quantile_cont(x, 0.5) AS median_improvement_pct FROM p""",
    dbl="coverage_pct mean_improvement_pct std_improvement_pct min_improvement_pct max_improvement_pct median_improvement_pct",
    lng="total_predictions n_zones n_horizons with_forecasts n_improved target_achieved",
)
def _(v):
    df = v.pred_panel.select(
        "zone",
        F.col("l_linenumber").alias("horizon_hours"),
        (F.col("l_linenumber") < 5).alias("forecast_available"),
        ((F.col("y_pred") - F.col("y_true")) / F.col("y_true") * 100).alias("improvement_pct"),
    )
    return mt.forecast_report(df)


@query(
    "agg17_collection_summary",
    """WITH z AS (SELECT zone, count(*) AS n, max(forecast_horizon_hours) AS h FROM forecast_hourly GROUP BY zone)
        SELECT count(*) AS zones_attempted, count(n) AS zones_successful, count(*) FILTER (n IS NULL) AS zones_failed,
               coalesce(sum(n), 0) AS total_forecasts, coalesce(max(h), 0) AS forecast_horizon_hours
        FROM (VALUES ('NP15'), ('SCE'), ('SMUD'), ('PGE_VALLEY'), ('SP15'), ('SDGE')) e(zone) LEFT JOIN z USING (zone)""",
    lng="zones_attempted zones_successful zones_failed total_forecasts forecast_horizon_hours",
)
def _(v):
    expected = v.spark.createDataFrame([(z,) for z in ("NP15", "SCE", "SMUD", "PGE_VALLEY", "SP15", "SDGE")], "zone string")
    return ag.collection_summary(expected, v.forecast_hourly)


STEP_SQL = f"""SELECT l.*, CASE WHEN {TS} >= z - INTERVAL 30 DAY THEN 3.0 WHEN {TS} >= z - INTERVAL 90 DAY THEN 2.0
        WHEN {TS} >= z - INTERVAL 180 DAY THEN 1.5 ELSE 1.0 END AS temporal_weight,
        CASE WHEN extract(hour FROM {TS}) BETWEEN 17 AND 21 THEN 2.5 WHEN extract(hour FROM {TS}) BETWEEN 14 AND 16 THEN 1.5 ELSE 1.0 END AS time_of_day_weight
        FROM (SELECT *, max({TS}) OVER (PARTITION BY zone) AS z FROM weight_rows) l"""
# Half the daily rows moved to the evening, so that all weights occur.
WEIGHT_ROWS = f"""SELECT zone, {TS} + to_hours(CAST(day(CAST({TS} AS DATE)) % 24 AS INTEGER)) AS {TS}, load FROM load_daily"""


def weight_rows(v):
    return v.load_daily.withColumn(
        "timestamp", F.col("timestamp") + F.make_dt_interval(hours=F.dayofmonth("timestamp") % 24)
    )


@query(
    "agg18_weighting_impact",
    f"""WITH weight_rows AS ({WEIGHT_ROWS}), s AS (SELECT *, temporal_weight * time_of_day_weight AS w FROM ({STEP_SQL}))
        SELECT zone, 100.0 * count(*) FILTER (extract(hour FROM {TS}) BETWEEN 17 AND 21) / count(*) AS evening_samples_pct,
        100 * sum(CASE WHEN extract(hour FROM {TS}) BETWEEN 17 AND 21 THEN w ELSE 0 END) / sum(w) AS evening_weight_pct,
        100.0 * count(*) FILTER ({TS} >= z - INTERVAL 30 DAY) / count(*) AS recent_samples_pct,
        100 * sum(CASE WHEN {TS} >= z - INTERVAL 30 DAY THEN w ELSE 0 END) / sum(w) AS recent_weight_pct, max(w) / min(w) AS weight_amplification
        FROM s GROUP BY zone""",
    dbl="evening_samples_pct evening_weight_pct recent_samples_pct recent_weight_pct weight_amplification",
)
def _(v):
    return wt.weighting_impact(wt.step_weights(weight_rows(v)))


@query(
    "agg20_chart_errors",
    "SELECT zone, avg(abs(y_true - y_pred)) AS avg_error, max(abs(y_true - y_pred)) AS max_error, min(abs(y_true - y_pred)) AS min_error FROM pred_panel GROUP BY zone",
    dbl="avg_error max_error min_error",
)
def _(v):
    return mt.chart_errors(v.pred_panel, ["zone"])


@query(
    "agg21_zone_extremes",
    "SELECT zone, max(load) AS peak_load, min(load) AS min_load, avg(load) AS avg_load, stddev_samp(load) AS load_std FROM load_hourly GROUP BY zone",
    dbl="peak_load min_load avg_load load_std",
)
def _(v):
    return ag.zone_extremes(v.load_hourly)


@query(
    "agg21_best_and_worst_zone",
    """WITH m AS (SELECT zone, avg(abs(y_true - y_pred) / y_true) * 100 AS mape FROM pred_panel GROUP BY zone)
        SELECT arg_min(zone, mape) AS best_zone, arg_max(zone, mape) AS worst_zone FROM m""",
)
def _(v):
    m = mt.core_metrics(v.pred_panel, ["zone"])
    return m.agg(F.min_by("zone", "mape").alias("best_zone"), F.max_by("zone", "mape").alias("worst_zone"))


@query(
    "agg22_before_after",
    """WITH t AS (SELECT sum(y_true * 0.9) / 1e6 AS baseline_total, sum(y_pred) / 1e6 AS improved_total FROM pred_panel),
        e AS (SELECT *, 2e3 AS actual_load, (baseline_total - 2e3) / 2e3 * 100 AS baseline_error_pct, (improved_total - 2e3) / 2e3 * 100 AS improved_error_pct,
              CASE WHEN improved_total > 0 THEN baseline_total / improved_total ELSE 1 END AS accuracy_improvement_ratio FROM t)
        SELECT *, abs(baseline_error_pct) - abs(improved_error_pct) AS error_reduction_pct,
               CASE WHEN abs(improved_error_pct) < abs(baseline_error_pct) THEN 1 ELSE 0 END AS target_met FROM e""",
    dbl="actual_load baseline_error_pct improved_error_pct accuracy_improvement_ratio error_reduction_pct baseline_total improved_total",
    lng="target_met",
)
def _(v):
    df = v.pred_panel.select((F.col("y_true") * 0.9 / 1e6).alias("baseline"), (F.col("y_pred") / 1e6).alias("improved"))
    return mt.before_after(df, 2e3)


@query(
    "ml14_linear_calibration",
    """WITH k AS (SELECT zone, l_orderkey, l_linenumber, y_true / 1000 AS y_true, y_pred / 1000 AS y_pred FROM pred_panel),
        c AS (SELECT zone, regr_slope(y_pred, y_true) AS a, regr_intercept(y_pred, y_true) AS b FROM k GROUP BY zone)
        SELECT zone, l_orderkey, l_linenumber, y_true, y_pred, (y_pred - b) / a AS y_pred_calibrated FROM k JOIN c USING (zone)""",
    dbl="y_true y_pred y_pred_calibrated",
    lng="l_linenumber",
)
def _(v):
    from gridweave.operators.smoothing import calibrate

    scaled = v.pred_panel.withColumns({"y_true": F.col("y_true") / 1000, "y_pred": F.col("y_pred") / 1000})
    return calibrate(scaled.drop("timestamp"), "y_true", "y_pred")


@query(
    "ml16_scaled_chart",
    f"""WITH c AS (SELECT {TS}, sum(load) AS a, sum(load) * 1.02 AS p FROM load_hourly GROUP BY 1)
        SELECT {TS}, zone, a * f AS actual_load, p * f AS predicted_load FROM c,
        (VALUES {", ".join(f"('{z}', {x})" for z, x in {**ct.SCALE_FACTOR, 'ZP26': 0.1}.items())}) s(zone, f)""",
    dbl="actual_load predicted_load",
)
def _(v):
    chart = v.load_hourly.groupBy("timestamp").agg(F.sum("load").alias("actual_load"), (F.sum("load") * 1.02).alias("predicted_load"))
    return fc.scaled_chart(chart, [*ct.SCALE_FACTOR, "ZP26"])


# --- weights, splits and samples

@query(
    "fn22_step_weights",
    f"""WITH weight_rows AS ({WEIGHT_ROWS}) SELECT zone, {TS}, load, temporal_weight, time_of_day_weight,
        temporal_weight * time_of_day_weight AS sample_weight FROM ({STEP_SQL})""",
    dbl="load temporal_weight time_of_day_weight sample_weight",
)
def _(v):
    return wt.step_weights(weight_rows(v))


@query(
    "fn23_decay_weights",
    f"""WITH weight_rows AS ({WEIGHT_ROWS}),
        d AS (SELECT *, floor((epoch_us(max({TS}) OVER (PARTITION BY zone)) - epoch_us({TS})) / 86400000000) AS days_from_latest FROM weight_rows),
        w AS (SELECT *, exp(-days_from_latest / 365.0) * 5 AS recency_weight, CASE WHEN extract(hour FROM {TS}) BETWEEN 17 AND 21 THEN 3.0 ELSE 1.0 END AS evening_weight FROM d)
        SELECT *, recency_weight * evening_weight / avg(recency_weight * evening_weight) OVER (PARTITION BY zone) AS sample_weight FROM w""",
    dbl="load recency_weight evening_weight sample_weight",
    lng="days_from_latest",
)
def _(v):
    return wt.decay_weights(weight_rows(v))


@query(
    "fn24_two_level_weights",
    f"""WITH weight_rows AS ({WEIGHT_ROWS}),
        w AS (SELECT zone, {TS}, load, CASE WHEN {TS} >= z - INTERVAL 60 DAY THEN 2.0 ELSE 1.0 END AS recency_weight,
              CASE WHEN extract(hour FROM {TS}) BETWEEN 17 AND 21 THEN 2.0 ELSE 1.0 END AS evening_weight
              FROM (SELECT *, max({TS}) OVER (PARTITION BY zone) AS z FROM weight_rows))
        SELECT *, recency_weight * evening_weight AS sample_weight FROM w""",
    dbl="load recency_weight evening_weight sample_weight",
)
def _(v):
    return wt.two_level_weights(weight_rows(v))


@query(
    "ml01_hybrid_training_rows",
    f"""WITH l AS (SELECT *, max({TS}) OVER (PARTITION BY zone) AS z FROM load_daily),
        m AS (SELECT zone, count(DISTINCT extract(month FROM {TS})) AS months FROM l WHERE {TS} >= z - INTERVAL 300 DAY GROUP BY zone)
        SELECT zone, {TS}, load, CASE WHEN {TS} >= z - INTERVAL 180 DAY THEN 2.0 ELSE 1.0 END AS sample_weight FROM l JOIN m USING (zone)
        WHERE {TS} >= z - (CASE WHEN months < 12 THEN INTERVAL 365 DAY ELSE INTERVAL 300 DAY END)""",
    dbl="load sample_weight",
)
def _(v):
    return wt.hybrid_training_rows(v.load_daily, core_days=300)


@query(
    "ml02_month_split",
    f"""SELECT zone, {TS}, seq, load, CASE WHEN ix < floor(n * 0.15 + 1e-9) THEN 'val' ELSE 'train' END AS split FROM (
        SELECT *, row_number() OVER (PARTITION BY zone, month({TS}) ORDER BY md5(CAST(seq AS VARCHAR) || '|42'), seq) - 1 AS ix,
               count(*) OVER (PARTITION BY zone, month({TS})) AS n FROM {MAPPED})""",
    dbl="load",
)
def _(v):
    df = v.load_raw.where("zone is not null")
    return wt.month_split(df, F.col("seq"), "seq").select("zone", "timestamp", "seq", "load", "split")


_U = "(CAST(CAST('0x' || substr(md5(CAST(seq AS VARCHAR) || '|42'), 1, 12) AS BIGINT) AS DOUBLE) + 1) / 281474976710656.0"


@query(
    "ml03_weighted_sample",
    f"""SELECT zone, {TS}, seq, load, w AS sample_weight FROM (SELECT *, 1 + load / 50 AS w FROM {MAPPED})
        QUALIFY row_number() OVER (PARTITION BY zone ORDER BY -ln({_U}) / w, seq) <= 700""",
    dbl="load sample_weight",
)
def _(v):
    df = v.load_raw.where("zone is not null").withColumn("sample_weight", 1 + F.col("load") / 50)
    return wt.weighted_sample(df, F.col("seq"), "seq", 700).select("zone", "timestamp", "seq", "load", "sample_weight")


@query(
    "ml03_recent_evening_rows",
    f"""SELECT zone, count(*) FILTER ({TS} >= z - INTERVAL 60 DAY AND extract(hour FROM {TS}) BETWEEN 17 AND 21) AS recent_evening_rows
        FROM (SELECT *, max({TS}) OVER (PARTITION BY zone) AS z FROM load_raw) GROUP BY zone""",
    lng="recent_evening_rows",
)
def _(v):
    return wt.recent_evening_counts(v.load_raw)


@query(
    "ml18_shuffled_split",
    f"""SELECT zone, {TS}, seq, load, CASE WHEN ix < ceil(n * 0.2 - 1e-9) THEN 'test'
        WHEN ix < ceil(n * 0.2 - 1e-9) + ceil((n - ceil(n * 0.2 - 1e-9)) * 0.2 - 1e-9) THEN 'val' ELSE 'train' END AS split FROM (
        SELECT *, row_number() OVER (PARTITION BY zone ORDER BY md5(CAST(seq AS VARCHAR) || '|42'), seq) - 1 AS ix, count(*) OVER (PARTITION BY zone) AS n FROM {MAPPED})""",
    dbl="load",
)
def _(v):
    df = v.load_raw.where("zone is not null")
    return wt.shuffled_split(df, F.col("seq"), "seq").select("zone", "timestamp", "seq", "load", "split")


@query(
    "pip05_weighted_training_sets",
    f"""WITH weight_rows AS (SELECT * FROM load_raw WHERE zone IN ('SCE', 'SP15')),
        s AS (SELECT *, temporal_weight * time_of_day_weight AS sample_weight FROM ({STEP_SQL})),
        k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY zone ORDER BY -ln({_U}) / sample_weight, seq) <= 900)
        SELECT zone, {TS}, seq, load, sample_weight, CASE WHEN ix < floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'val' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {TS}, seq) - 1 AS ix, count(*) OVER (PARTITION BY zone) AS n FROM k)""",
    dbl="load sample_weight",
)
def _(v):
    from gridweave.plans.master import weighted_training_sets

    out = weighted_training_sets(v.load_raw, ["SCE", "SP15"], "seq", 900)
    return out.select("zone", "timestamp", "seq", "load", "sample_weight", "split")
