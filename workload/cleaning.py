"""Checked queries: row filters, mapping, defaults, clipping and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import catalog as ct
from gridweave.functions.weather import fill_weather
from gridweave.operators import clean as cl
from gridweave.operators import quality as dq
from gridweave.operators import windows as wn
from gridweave.operators.joins import map_values
from gridweave.plans import forecast as fc
from workload.features import PIP01_SQL, TS
from workload.harness import query
from workload.windows import RAW, Z, rows

RESOURCE = {"click": "PGE-TAC", "view": "SCE-TAC", "purchase": "BANCSMUD", "signup": "LADWP", "error": "BANCMID"}
RES_SQL = "CASE resource_name " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in RESOURCE.items()) + " END"


def resources(v):
    return v.load_raw.select("timestamp", "seq", "load", ct.lookup(RESOURCE, F.col("resource_name")).alias("resource_name"))


def _map_sql(values: dict) -> str:
    return "CASE resource_name " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in values.items()) + " END"


@query(
    "prj01_resource_to_zone",
    f"SELECT *, {_map_sql(ct.RESOURCE_ZONE)} AS zone FROM (SELECT {TS}, seq, load, {RES_SQL} AS resource_name FROM load_raw)",
    dbl="load",
)
def _(v):
    mapping = ct.pairs_table(v.spark, ct.RESOURCE_ZONE, "resource_name", "zone", "string")
    return map_values(resources(v), mapping, "resource_name")


@query(
    "prj02_zone_repair",
    f"""SELECT * FROM (SELECT *, {_map_sql(ct.RESOURCE_ZONE_REPAIR)} AS zone
        FROM (SELECT {TS}, seq, load, {RES_SQL} AS resource_name FROM load_raw)) WHERE zone IS NOT NULL""",
    dbl="load",
)
def _(v):
    mapping = ct.pairs_table(v.spark, ct.RESOURCE_ZONE_REPAIR, "resource_name", "zone", "string")
    return map_values(resources(v), mapping, "resource_name", "inner")


@query(
    "prj03_recent_hours",
    f"SELECT {TS}, seq, load FROM load_raw WHERE {TS} >= TIMESTAMP '2024-01-28 12:00:00' - INTERVAL 36 HOUR",
    dbl="load",
)
def _(v):
    return cl.recent(v.load_raw.select("timestamp", "seq", "load"), "36 hours", F.lit("2024-01-28 12:00:00").cast("timestamp"))


@query(
    "prj03_recent_days_from_latest",
    f"SELECT zone, {TS}, load FROM load_daily WHERE {TS} >= (SELECT max({TS}) FROM load_daily) - INTERVAL 730 DAY",
    dbl="load",
)
def _(v):
    return cl.recent(v.load_daily, "730 days")


@query(
    "prj04_calendar_sample",
    f"""SELECT DISTINCT zone, {TS}, load FROM (SELECT * FROM load_daily WHERE """
    + " OR ".join(f"{TS} BETWEEN TIMESTAMP '{y}-{m:02d}-01' AND TIMESTAMP '{y}-{m:02d}-15'" for y in (1996, 1997) for m in (1, 4, 7, 10))
    + f""" UNION ALL SELECT zone, {TS}, load FROM load_daily
        QUALIFY row_number() OVER (PARTITION BY zone ORDER BY {TS} DESC) <= 100)""",
    dbl="load",
)
def _(v):
    return cl.calendar_sample(v.load_daily, (1996, 1997), tail=100)


@query(
    "prj05_load_range",
    f"""SELECT zone, {TS}, load FROM load_hourly
        WHERE CASE zone WHEN 'SCE' THEN load BETWEEN 1020 AND 1100 WHEN 'SP15' THEN load BETWEEN 1010 AND 1060 ELSE TRUE END""",
    dbl="load",
)
def _(v):
    ranges = v.spark.createDataFrame([("SCE", 1020.0, 1100.0), ("SP15", 1010.0, 1060.0)], "zone string, lo double, hi double")
    return cl.in_load_range(v.load_hourly, ranges)


@query(
    "prj06_proxy_zone",
    f"""SELECT 'SDGE' AS zone, {TS}, load * 2500 / m AS load FROM load_hourly, (SELECT avg(load) AS m FROM load_hourly WHERE zone = 'SCE')
        WHERE zone = 'SCE' AND load * 2500 / m BETWEEN 800 AND 4800""",
    dbl="load",
)
def _(v):
    return cl.proxy_zone(v.load_hourly, "SDGE", "SCE", 1000, 4000)


@query(
    "prj07_valid_forecasts",
    f"""SELECT zone, {TS}, temp_c * 3 - 30 AS temp_c, CASE WHEN humidity * 2 BETWEEN 0 AND 100 THEN humidity * 2 END AS humidity,
        CASE WHEN wind_speed_kmh * 20 BETWEEN 0 AND 200 THEN wind_speed_kmh * 20 END AS wind_speed_kmh, forecast_horizon_hours
        FROM forecast_hourly WHERE temp_c * 3 - 30 BETWEEN -20 AND 60""",
    dbl="temp_c humidity wind_speed_kmh",
    lng="forecast_horizon_hours",
)
def _(v):
    df = v.forecast_hourly.select(
        "zone", "timestamp", (F.col("temp_c") * 3 - 30).alias("temp_c"), (F.col("humidity") * 2).alias("humidity"),
        (F.col("wind_speed_kmh") * 20).alias("wind_speed_kmh"), "forecast_horizon_hours",
    )
    return cl.valid_forecasts(df)


LEFT = f"""SELECT l.zone, l.{TS}, l.load, w.temp_c, w.humidity FROM load_hourly l
    LEFT JOIN weather_hourly w ON l.zone = w.zone AND l.{TS} = w.{TS}"""


def left(v):
    return v.load_hourly.join(v.weather_hourly.select("zone", "timestamp", "temp_c", "humidity"), ["zone", "timestamp"], "left")


@query("prj08_complete_rows", f"SELECT * FROM ({LEFT}) WHERE temp_c IS NOT NULL", dbl="load temp_c humidity")
def _(v):
    return left(v).dropna(subset=["load", "temp_c", "humidity"])


@query(
    "prj09_local_time_to_utc",
    f"SELECT zone, {TS} + INTERVAL 8 HOUR AS {TS}, load FROM load_hourly",
    dbl="load",
)
def _(v):
    # January: the zone is eight hours behind UTC.
    return cl.to_utc(v.load_hourly, "timestamp", "America/Los_Angeles")


@query("prj10_selected_features", f"SELECT temp_c, humidity, load FROM ({LEFT}) WHERE load IS NOT NULL", dbl="load temp_c humidity")
def _(v):
    return cl.select_features(left(v), ["temp_c", "humidity", "not_there"], "load")


@query("prj11_numeric_features", f"SELECT temp_c, load FROM ({LEFT}) WHERE temp_c IS NOT NULL", dbl="load temp_c")
def _(v):
    return cl.numeric_features(left(v), "load", exclude=["humidity"])


@query(
    "prj12_aligned_features",
    f"""SELECT zone, {TS}, coalesce(temp_c, 0) AS temp_c, 0 AS wind_speed_kmh, coalesce(humidity, 0) AS humidity,
        coalesce(load, 0) AS load FROM ({LEFT})""",
    dbl="load temp_c humidity wind_speed_kmh",
)
def _(v):
    return cl.align_features(left(v), ["temp_c", "wind_speed_kmh", "humidity", "load"], keep=["zone", "timestamp"])


@query(
    "prj13_default_weather",
    f"SELECT zone, {TS}, load, temp_c, 65 AS humidity, 5 AS wind_speed FROM ({LEFT})",
    dbl="load temp_c humidity wind_speed",
)
def _(v):
    return fill_weather(left(v).drop("humidity"))


@query(
    "prj14_clipped_predictions",
    """SELECT zone, l_orderkey, l_linenumber, y_true, CASE zone WHEN 'A' THEN least(greatest(y_pred, 6000), 25000)
        ELSE least(greatest(y_pred, 0), 50000) END AS y_pred FROM pred_panel""",
    dbl="y_true y_pred",
    lng="l_linenumber",
)
def _(v):
    ranges = v.spark.createDataFrame([("A", 6000.0, 25000.0)], "zone string, lo double, hi double")
    return cl.clip_predictions(v.pred_panel.drop("timestamp"), ranges, "y_pred")


def _class(name: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({name}, '{p}') THEN '{c}'" for c, p in dq.CATALOGUE_CLASSES)
    return f"CASE {whens} ELSE 'other' END"


_COV = "load load_lag_1h load_lag_24h temp_c humidity hour hour_sin load_rolling_3h_mean load_target_1h is_weekend".split()


@query(
    "prj15_feature_coverage",
    "WITH f AS (" + PIP01_SQL + "), l AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature_name, 100.0 * count(CASE WHEN l_ok THEN {c} END) / count(*) AS non_null_pct FROM (SELECT *, hour <> 5 AS l_ok FROM f)"
        for c in _COV
    ) + f") SELECT feature_name, non_null_pct, {_class('feature_name')} AS feature_type FROM l",
    dbl="non_null_pct",
)
def _(v):
    from workload.harness import QUERIES

    df = QUERIES["pip01_build_features"](v.spark, v.dir)
    hidden = {c: F.when(F.col("hour") != 5, F.col(c)) for c in _COV}
    return dq.feature_catalogue(df.select("timestamp", *[hidden[c].alias(c) for c in _COV]))


@query(
    "prj15_coverage_by_class",
    "WITH f AS (" + PIP01_SQL + "), l AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature_name, 100.0 * count({c}) / count(*) AS p FROM f" for c in _COV
    ) + f") SELECT {_class('feature_name')} AS feature_type, count(*) AS n_features, avg(p) AS mean_coverage_pct FROM l GROUP BY 1",
    dbl="mean_coverage_pct",
    lng="n_features",
)
def _(v):
    from workload.harness import QUERIES

    return dq.coverage_by_class(QUERIES["pip01_build_features"](v.spark, v.dir).select("timestamp", *_COV))


FENCE = """SELECT zone, quantile_cont(load, 0.25) AS q1, quantile_cont(load, 0.75) AS q3 FROM load_shift WHERE load >= 0 GROUP BY zone"""
SHIFT = f"SELECT zone, {TS}, load - 1010 AS load FROM load_hourly"


def shift(v):
    return v.load_hourly.withColumn("load", F.col("load") - 1010)


@query(
    "dq01_iqr_fence",
    f"""WITH load_shift AS ({SHIFT}), q AS ({FENCE}) SELECT zone, {TS}, load FROM load_shift JOIN q USING (zone)
        WHERE load >= 0 AND (zone NOT IN ('NP15', 'SCE', 'SMUD') OR load BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""",
    dbl="load",
)
def _(v):
    return cl.without_extremes(shift(v), factor=1.5, zones=("NP15", "SCE", "SMUD"))


@query(
    "dq01_zone_preprocessing",
    f"""WITH load_shift AS (SELECT zone, {TS}, CASE WHEN extract(hour FROM {TS}) = 3 THEN 0 ELSE load - 1010 END AS load FROM load_hourly),
        q AS ({FENCE}),
        k AS (SELECT zone, {TS}, load FROM load_shift JOIN q USING (zone) WHERE load >= 0 AND
              (zone NOT IN ('NP15', 'SCE', 'SMUD') OR load BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1))),
        x AS (SELECT *, row_number() OVER ({Z}) AS ix, nullif(load, 0) AS y FROM k),
        p AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN {{'ix': ix, 'v': y}} END IGNORE NULLS) OVER ({Z}) AS a,
              first_value(CASE WHEN y IS NOT NULL THEN {{'ix': ix, 'v': y}} END IGNORE NULLS) OVER ({Z} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM x)
        SELECT zone, {TS}, CASE WHEN zone = 'SCE' THEN coalesce(y, CASE WHEN b.v IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (ix - a.ix) / (b.ix - a.ix) END)
            WHEN zone IN ('NP15', 'SMUD') THEN 0.7 * load + (1 - 0.7) * avg(load) OVER ({Z} {rows(1, 1)}) ELSE load END AS load FROM p""",
    dbl="load",
)
def _(v):
    df = shift(v).withColumn("load", F.when(F.hour("timestamp") == 3, 0.0).otherwise(F.col("load")))
    return cl.preprocess_zones(df)


@query(
    "dq02_modified_z_score",
    f"""WITH med AS (SELECT zone, quantile_cont(load, 0.5) AS md, count(*) AS n FROM load_hourly GROUP BY zone),
        dev AS (SELECT l.*, abs(load - md) AS off, n FROM load_hourly l JOIN med USING (zone)),
        mad AS (SELECT zone, quantile_cont(off, 0.5) AS mad FROM dev GROUP BY zone)
        SELECT zone, {TS}, load FROM dev JOIN mad USING (zone) WHERE NOT (n > 10 AND mad > 0 AND 0.6745 * off / nullif(mad, 0) > 2.0)""",
    dbl="load",
)
def _(v):
    return cl.without_outliers(v.load_hourly, limit=2.0)


@query(
    "dq03_winsorised",
    f"""WITH x AS (SELECT *, lag(load, 1) OVER ({Z}) AS load_lag_1h, avg(load) OVER ({Z} {rows(3)}) AS load_ma_4h FROM load_hourly),
        q AS (SELECT zone, quantile_cont(load_lag_1h, 0.01) AS a, quantile_cont(load_lag_1h, 0.99) AS b,
              quantile_cont(load_ma_4h, 0.01) AS c, quantile_cont(load_ma_4h, 0.99) AS e FROM x GROUP BY zone)
        SELECT zone, {TS}, load, CASE WHEN load_lag_1h IS NOT NULL THEN least(greatest(load_lag_1h, a), b) END AS load_lag_1h,
               least(greatest(load_ma_4h, c), e) AS load_ma_4h FROM x JOIN q USING (zone)""",
    dbl="load load_lag_1h load_ma_4h",
)
def _(v):
    df = wn.over_series(
        v.load_hourly,
        lambda s: {**wn.lag_columns(s, "load", (1,)), **wn.rolling_columns(s, "load", (4,), ("mean",), "load_ma_{n}h", least=1)},
        back=3,
    )
    return cl.winsorise(df, ["load_lag_1h", "load_ma_4h"])


def _ensemble_sql(name: str, weights: dict[str, float]) -> str:
    value = " + ".join(f"coalesce({m} * {w}, 0)" for m, w in weights.items())
    total = " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE {w} END" for m, w in weights.items())
    return f"CASE WHEN {total} > 0 THEN least(greatest(({value}) / ({total}), 0), 50000) END AS {name}"


@query(
    "ml09_ensembles",
    """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 4 THEN y_true * 0.98 END AS baseline,
            CASE WHEN l_linenumber <> 3 AND l_linenumber <> 4 THEN y_pred END AS enhanced, CASE WHEN l_linenumber > 4 THEN y_true * 1.01 END AS third, y_true FROM pred_panel)
        SELECT l_orderkey, l_linenumber, y_true, """
    + ", ".join(_ensemble_sql(name, ws) for name, ws in fc.ENSEMBLES.items())
    + " FROM p",
    dbl="y_true " + " ".join(fc.ENSEMBLES),
    lng="l_linenumber",
)
def _(v):
    cols = [fc.ensemble(w, (0, 50000)).alias(name) for name, w in fc.ENSEMBLES.items()]
    return three_models(v).select("l_orderkey", "l_linenumber", "y_true", *cols)


def three_models(v):
    n = F.col("l_linenumber")
    return v.pred_panel.withColumns(
        {
            "baseline": F.when(n != 4, F.col("y_true") * 0.98),
            "enhanced": F.when((n != 3) & (n != 4), F.col("y_pred")),
            "third": F.when(n > 4, F.col("y_true") * 1.01),
        }
    )


@query(
    "ml10_model_choice",
    """SELECT l_orderkey, l_linenumber, y_true, coalesce(third, enhanced, baseline) AS third, coalesce(enhanced, baseline) AS enhanced, baseline
        FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 4 THEN y_true * 0.98 END AS baseline,
            CASE WHEN l_linenumber <> 3 AND l_linenumber <> 4 THEN y_pred END AS enhanced, CASE WHEN l_linenumber > 4 THEN y_true * 1.01 END AS third, y_true FROM pred_panel)""",
    dbl="y_true third enhanced baseline",
    lng="l_linenumber",
)
def _(v):
    df = three_models(v)
    picked = [fc.pick_model(m).alias(m) for m in ("third", "enhanced", "baseline")]
    return df.select("l_orderkey", "l_linenumber", "y_true", *picked)


@query(
    "ml09_evening_chosen_weights",
    f"""WITH e AS (SELECT zone, avg(abs(y_true - y_pred) / y_true) * 100 AS enhanced_mape,
            avg(CASE WHEN l_linenumber > 3 THEN abs(y_true - y_pred) / y_true * 100 END) AS third_mape FROM pred_panel GROUP BY zone)
        SELECT *, CASE WHEN enhanced_mape < third_mape THEN 0.65 ELSE 0.45 END AS enhanced_weight,
               CASE WHEN enhanced_mape < third_mape THEN 0.35 ELSE 0.55 END AS third_weight FROM e""",
    dbl="enhanced_mape third_mape enhanced_weight third_weight",
)
def _(v):
    ape = F.abs(F.col("y_true") - F.col("y_pred")) / F.col("y_true") * 100
    errors = v.pred_panel.groupBy("zone").agg(
        F.avg(ape).alias("enhanced_mape"), F.avg(F.when(F.col("l_linenumber") > 3, ape)).alias("third_mape")
    )
    return fc.chosen_ensemble(errors)
