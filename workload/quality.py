"""Checked queries: data quality, gates, file sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridweave import catalog as ct
from gridweave.operators import aggregates as ag
from gridweave.operators import quality as dq
from gridweave.operators.joins import latest_per_key
from gridweave.plans import features as pf
from gridweave.plans.master import land_forecasts
from gridweave.session import shared_dir
from gridweave.sources import files as fs
from workload.features import TS, parts
from workload.harness import QUERIES, query
from workload.windows import Z

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query(
    "dq04_training_gate",
    f"""WITH f AS (SELECT zone, count(*) AS n_rows, 100.0 * count(*) FILTER (load IS NULL) / count(*) AS null_pct,
            floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max({TS}))) / 86400000000) AS days_old,
            quantile_cont(load, 0.75) - quantile_cont(load, 0.25) AS iqr
            FROM (SELECT zone, {TS}, CASE WHEN zone = 'SCE' AND load < 20 THEN NULL ELSE load END AS load FROM load_raw WHERE zone IS NOT NULL) GROUP BY zone)
        SELECT *, CASE WHEN n_rows >= 1000 AND null_pct <= 10 AND coalesce(iqr, 1) <> 0 THEN 1 ELSE 0 END AS passed FROM f""",
    dbl="null_pct iqr",
    lng="n_rows days_old passed",
)
def _(v):
    hole = (F.col("zone") == "SCE") & (F.col("load") < 20)
    df = v.load_raw.where("zone is not null").withColumn("load", F.when(~hole, F.col("load")))
    return dq.training_gate(df, as_of())


_EXPECTED = ", ".join(f"'{z}'" for z in ct.EXPECTED_ZONES)


@query(
    "dq05_quality_report",
    f"""WITH f AS (SELECT count(*) FILTER (zone IS NULL) AS missing_values,
            floor((epoch_us(max({TS})) - epoch_us(min({TS}))) / 86400000000) / 365.25 AS duration_years,
            7 - count(DISTINCT CASE WHEN zone IN ({_EXPECTED}) THEN zone END) AS missing_zones FROM load_raw),
        s AS (SELECT *, 100 - CASE WHEN missing_values > 0 THEN 10 ELSE 0 END - CASE WHEN duration_years < 4.5 THEN 15 ELSE 0 END
            - CASE WHEN missing_zones > 0 THEN 20 ELSE 0 END - 5 AS quality_score FROM f)
        SELECT *, CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 70 THEN 'fair' ELSE 'poor' END AS grade FROM s""",
    dbl="duration_years",
    lng="missing_values missing_zones quality_score",
)
def _(v):
    return dq.quality_report(v.load_raw, has_system=False)


def _pen(name: str, cond: str, p: int) -> str:
    return f"SELECT '{name}' AS \"check\", CASE WHEN {cond} THEN {p} ELSE 0 END AS penalty FROM x"


_UNI = f"""WITH x AS (SELECT l.zone, l.{TS}, load, h AS hour, d AS day_of_week, m AS month, lag(load, 400) OVER ({Z}) AS load_lag_400h,
    CASE WHEN h < 20 THEN 1.0 END AS temp_forecast_1h, CASE WHEN h = 30 THEN 1.0 END AS temp_forecast_6h,
    load AS wind_forecast_12h, CASE WHEN h = 31 THEN 1.0 END AS cooling_forecast_24h FROM {parts('load_hourly')} l)"""


def _null(c: str) -> str:
    return f"(SELECT 100.0 * count(*) FILTER ({c} IS NULL) / count(*) FROM x)"


_UNI_RULES = (
    [(f"nulls_{c}", f"{_null(q)} > 5", 15) for c, q in (("timestamp", TS), ("zone", "zone"), ("load", "load"), ("hour", "hour"), ("day_of_week", "day_of_week"))]
    + [(f"range_{c}", f"(SELECT min({c}) FROM x) < {lo} OR (SELECT max({c}) FROM x) > {hi}", p)
       for c, lo, hi, p in (("load", 0, 100000, 20), ("hour", 0, 23, 10), ("day_of_week", 0, 6, 10), ("month", 1, 12, 10))]
    + [(f"coverage_{c}", f"{_null(c)} > 90", 5) for c in ("temp_forecast_1h", "temp_forecast_6h", "wind_forecast_12h", "cooling_forecast_24h")]
    + [("lag_nulls_load_lag_400h", f"{_null('load_lag_400h')} > 50", 5)]
)


def unified(v):
    from gridweave.functions.calendar import calendar_parts
    from gridweave.operators.windows import lag_features

    df = calendar_parts(v.load_hourly).select("zone", "timestamp", "load", "hour", "day_of_week", "month")
    df = lag_features(df, "load", (400,))
    when = lambda rule: F.when(F.expr(rule), 1.0)
    return df.withColumns(
        {"temp_forecast_1h": when("hour < 20"), "temp_forecast_6h": when("hour = 30"), "wind_forecast_12h": F.col("load"), "cooling_forecast_24h": when("hour = 31")}
    )


@query(
    "dq06_unified_feature_checks",
    _UNI + " " + " UNION ALL ".join(f"(SELECT * FROM ({_pen(n, c, p)}) LIMIT 1)" for n, c, p in _UNI_RULES),
    lng="penalty",
)
def _(v):
    return dq.feature_penalties(unified(v))


@query(
    "dq06_unified_feature_score",
    _UNI + ", p AS (" + " UNION ALL ".join(f"(SELECT * FROM ({_pen(n, c, p)}) LIMIT 1)" for n, c, p in _UNI_RULES)
    + """) SELECT 100 - sum(penalty) AS quality_score, count(*) FILTER (penalty > 0) AS n_issues,
        CASE WHEN 100 - sum(penalty) >= 75 THEN 1 ELSE 0 END AS passed FROM p""",
    lng="quality_score n_issues passed",
)
def _(v):
    return dq.score(dq.feature_penalties(unified(v)))


@query(
    "dq07_forecast_table_checks",
    f"""WITH f AS (SELECT CASE WHEN extract(hour FROM {TS}) BETWEEN 2 AND 5 THEN NULL ELSE {TS} END AS {TS}, CASE WHEN humidity > 80 THEN NULL ELSE temp_c * 2 END AS temp_c,
            forecast_horizon_hours FROM forecast_hourly),
        t AS (SELECT DISTINCT {TS} FROM f WHERE {TS} IS NOT NULL),
        g AS (SELECT epoch_us({TS}) - lag(epoch_us({TS})) OVER (ORDER BY {TS}) AS g FROM t)
        SELECT 'null_timestamp' AS "check", CASE WHEN (SELECT count(*) FROM f WHERE {TS} IS NULL) > 0 THEN 20 ELSE 0 END AS penalty
        UNION ALL SELECT 'null_temperature', CASE WHEN (SELECT count(*) FROM f WHERE temp_c IS NULL) > 0 THEN 30 ELSE 0 END
        UNION ALL SELECT 'temperature_range', CASE WHEN (SELECT count(*) FROM f WHERE temp_c NOT BETWEEN -10 AND 50) > 0 THEN 15 ELSE 0 END
        UNION ALL SELECT 'short_horizon', CASE WHEN (SELECT max(forecast_horizon_hours) FROM f) < 12 THEN 10 ELSE 0 END
        UNION ALL SELECT 'time_gaps', CASE WHEN (SELECT count(*) FROM g WHERE g > 7200000000) > 0 THEN 10 ELSE 0 END""",
    lng="penalty",
)
def _(v):
    df = v.forecast_hourly.select(
        F.when(~F.hour("timestamp").between(2, 5), F.col("timestamp")).alias("timestamp"),
        F.when(~(F.col("humidity") > 80), F.col("temp_c") * 2).alias("temp_c"),
        "forecast_horizon_hours",
    )
    return dq.forecast_table_penalties(df)


_FF = "temp_forecast_6h cooling_forecast_6h heating_forecast_6h rapid_temp_change extreme_temp_probability temp_c".split()
_FX = """WITH x AS (SELECT (temp_c - 10) * 2 AS temp_forecast_6h, temp_c - 15 AS cooling_forecast_6h, greatest(18 - temp_c, 0) AS heating_forecast_6h,
    forecast_horizon_hours % 3 AS rapid_temp_change, forecast_horizon_hours % 2 AS extreme_temp_probability, CASE WHEN humidity > 40 THEN temp_c END AS temp_c
    FROM forecast_hourly)"""


def forecast_like(v):
    t, h = F.col("temp_c"), F.col("forecast_horizon_hours")
    return v.forecast_hourly.select(
        ((t - 10) * 2).alias("temp_forecast_6h"),
        (t - 15).alias("cooling_forecast_6h"),
        F.greatest(18 - t, F.lit(0.0)).alias("heating_forecast_6h"),
        (h % 3).alias("rapid_temp_change"),
        (h % 2).alias("extreme_temp_probability"),
        F.when(F.col("humidity") > 40, t).alias("temp_c"),
    )


_FR = [
    ("high_nulls", " OR ".join(f"{_null(c)} > 50" for c in _FF), 20),
    ("range_temp_forecast_6h", "(SELECT min(temp_forecast_6h) FROM x) < -30 OR (SELECT max(temp_forecast_6h) FROM x) > 60", 10),
    ("negative_cooling_forecast_6h", "(SELECT min(cooling_forecast_6h) FROM x) < 0", 15),
    ("negative_heating_forecast_6h", "(SELECT min(heating_forecast_6h) FROM x) < 0", 15),
    ("binary_rapid_temp_change", "(SELECT count(*) FROM x WHERE rapid_temp_change NOT IN (0, 1)) > 0", 10),
    ("binary_extreme_temp_probability", "(SELECT count(*) FROM x WHERE extreme_temp_probability NOT IN (0, 1)) > 0", 10),
]


@query(
    "dq08_forecast_feature_checks",
    _FX + " " + " UNION ALL ".join(f"(SELECT * FROM ({_pen(n, c, p)}) LIMIT 1)" for n, c, p in _FR),
    lng="penalty",
)
def _(v):
    return dq.forecast_feature_penalties(forecast_like(v))


@query(
    "dq08_forecast_column_issues",
    _FX + " SELECT *, CASE WHEN n_extreme > 0 OR null_pct > 50 THEN 1 ELSE 0 END AS has_issue FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} NOT BETWEEN -20 AND 60) AS n_extreme, 100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct FROM x"
        for c in _FF[:3]
    ) + ")",
    dbl="null_pct",
    lng="n_extreme has_issue",
)
def _(v):
    return dq.forecast_column_issues(forecast_like(v))


@query("dq09_required_columns", "SELECT zone, count(*) AS n_rows FROM forecast_hourly GROUP BY zone", lng="n_rows")
def _(v):
    df = dq.require(v.forecast_hourly, ["timestamp", "zone", "temp_c", "forecast_horizon_hours"], ["timestamp", "zone"])
    return df.groupBy("zone").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "dq10_freshness",
    f"""SELECT zone, max({TS}) AS latest_ts, (epoch_us(TIMESTAMP '2024-01-31 01:00:00') - epoch_us(max({TS}))) / 3.6e9 AS age_hours,
        CASE WHEN (epoch_us(TIMESTAMP '2024-01-31 01:00:00') - epoch_us(max({TS}))) / 3.6e9 < 1 THEN 'fresh'
             WHEN (epoch_us(TIMESTAMP '2024-01-31 01:00:00') - epoch_us(max({TS}))) / 3.6e9 < 6 THEN 'aging' ELSE 'stale' END AS freshness,
        CASE WHEN (epoch_us(TIMESTAMP '2024-01-31 01:00:00') - epoch_us(max({TS}))) / 3.6e9 > 24 THEN 1 ELSE 0 END AS alert FROM load_raw GROUP BY zone""",
    dbl="age_hours",
    lng="alert",
)
def _(v):
    return dq.freshness(v.load_raw, F.lit("2024-01-31 01:00:00").cast("timestamp"))


_DUP = f"SELECT date_trunc('hour', {TS}) AS {TS}, zone, resource_name, round(load / 50) AS load FROM load_raw"


@query(
    "dq11_duplicate_counts",
    f"""WITH x AS ({_DUP}) SELECT (SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) AS duplicate_rows,
        (SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT {TS}, zone FROM x)) AS duplicate_keys""",
    lng="duplicate_rows duplicate_keys",
)
def _(v):
    df = v.load_raw.select(
        F.date_trunc("hour", "timestamp").alias("timestamp"), "zone", "resource_name", F.round(F.col("load") / 50).alias("load")
    )
    return ag.duplicate_counts(df, ["timestamp", "zone"])


# Model table of the events: error of a naive model per zone and the time it was trained.
_MODELS = f"""SELECT zone, max({TS}) - to_hours(CAST(ascii(zone) % 12 AS INTEGER)) AS trained_at, avg(load) / 20 AS mape FROM load_raw WHERE zone IS NOT NULL GROUP BY zone"""


@query(
    "dq12_model_health",
    f"""WITH m AS ({_MODELS}), e AS (SELECT e.zone, m.mape, trained_at, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(trained_at)) / 3.6e9 AS age_hours
            FROM (VALUES {", ".join(f"('{z}')" for z in ct.EXPECTED_ZONES)}) e(zone) LEFT JOIN m ON e.zone = m.zone)
        SELECT zone, mape, age_hours, CASE WHEN trained_at IS NULL THEN 'missing' WHEN mape > 5 THEN 'critical'
            WHEN mape > 2 OR age_hours > 8 THEN 'degraded' ELSE 'healthy' END AS status FROM e""",
    dbl="mape age_hours",
)
def _(v):
    models = v.load_raw.where("zone is not null").groupBy("zone").agg(
        (F.max("timestamp") - F.make_dt_interval(hours=F.first(F.ascii("zone") % 12))).alias("trained_at"),
        (F.avg("load") / 20).alias("mape"),
    )
    expected = v.spark.createDataFrame([(z,) for z in ct.EXPECTED_ZONES], "zone string")
    return dq.model_health(models, as_of(), expected)


@query(
    "dq13_promotion_gate",
    """WITH m AS (SELECT zone, avg(abs(y_true - y_pred) / y_true) * 25 AS mape, stddev_samp(y_pred) / avg(y_pred) * 10 AS temporal_variation,
            avg(l_linenumber) * 14 AS lag_share, avg(l_linenumber) * 9 AS temporal_share, avg(abs(y_true - y_pred) / y_true) * 100 AS evening_mape,
            1 - avg(pow(y_true - y_pred, 2)) / var_pop(y_true) AS r2 FROM pred_panel GROUP BY zone),
        c AS (SELECT *, CASE WHEN mape <= 2 THEN 1 ELSE 0 END AS accuracy_check, CASE WHEN temporal_variation >= 3.5 THEN 1 ELSE 0 END AS temporal_variation_check,
            CASE WHEN lag_share <= 60 AND temporal_share >= 35 THEN 1 ELSE 0 END AS feature_balance_check,
            CASE WHEN evening_mape < 5 AND r2 > 0.5 THEN 1 ELSE 0 END AS deployment_ready FROM m)
        SELECT *, accuracy_check * temporal_variation_check * feature_balance_check AS overall_pass FROM c""",
    dbl="mape temporal_variation lag_share temporal_share evening_mape r2",
    lng="accuracy_check temporal_variation_check feature_balance_check deployment_ready overall_pass",
)
def _(v):
    ape = F.abs(F.col("y_true") - F.col("y_pred")) / F.col("y_true")
    e = F.col("y_true") - F.col("y_pred")
    metrics = v.pred_panel.groupBy("zone").agg(
        (F.avg(ape) * 25).alias("mape"),
        (F.stddev_samp("y_pred") / F.avg("y_pred") * 10).alias("temporal_variation"),
        (F.avg("l_linenumber") * 14).alias("lag_share"),
        (F.avg("l_linenumber") * 9).alias("temporal_share"),
        (F.avg(ape) * 100).alias("evening_mape"),
        (1 - F.avg(e * e) / F.var_pop("y_true")).alias("r2"),
    )
    return dq.promotion_gate(metrics)


# --- sources and sinks. Landing files are written by Spark from the given tables.


def landing(v, name: str) -> str:
    return f"{shared_dir(v.spark)}/landing-{name}-{uuid.uuid4().hex}"


@query("src01_load_scan", f"SELECT {TS}, load, resource_name, seq, zone FROM load_raw WHERE zone IN ('NP15', 'SCE')", dbl="load")
def _(v):
    return fs.mapped_load(v.load_raw, ["NP15", "SCE"])


@query("src02_weather_scan", f"SELECT {TS}, temp_c, humidity, wind_speed, zone FROM weather_hourly WHERE zone = 'SCE'", dbl="temp_c humidity wind_speed")
def _(v):
    path = landing(v, "weather")
    fs.write_by_zone(v.weather_hourly, path)
    schema = "timestamp timestamp, temp_c double, humidity double, wind_speed double, zone string"
    absent = fs.read_weather(v.spark, path + "-absent", schema=schema)
    return fs.read_weather(v.spark, path, ["SCE"], schema).unionByName(absent)


@query(
    "src03_latest_forecasts",
    f"""SELECT zone, {TS}, temp_c, humidity, wind_speed_kmh, forecast_source, forecast_issued, forecast_horizon_hours FROM forecast_hourly
        WHERE zone IN ('SCE', 'SMUD') QUALIFY row_number() OVER (PARTITION BY zone, {TS} ORDER BY forecast_issued DESC) = 1""",
    dbl="temp_c humidity wind_speed_kmh",
    lng="forecast_horizon_hours",
)
def _(v):
    path = landing(v, "forecasts")
    fs.write_by_zone(v.forecast_hourly, path)
    return fs.read_forecasts(v.spark, path, ["SCE", "SMUD"])


@query(
    "src04_region_csv",
    f"SELECT {TS}, sum(load) AS load, 'NYISO' AS region, 'nyiso_mis' AS data_source FROM load_hourly GROUP BY 1",
    dbl="load",
)
def _(v):
    path = landing(v, "csv")
    rows = v.load_hourly.select(
        F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss").alias("Time Stamp"),
        F.col("zone").alias("Name"), F.lit("1").alias("PTID"), F.col("load").alias("Load"),
    )
    rows.write.option("header", True).csv(path)
    return fs.read_region_csv(v.spark, path)


_RES = {"click": "PGE-TAC", "view": "SCE-TAC", "purchase": "BANCSMUD", "signup": "LADWP", "error": "ELSEWHERE"}


@query(
    "src05_report_xml",
    f"""SELECT date_trunc('second', {TS}) AS {TS}, load, CASE resource_name {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in _RES.items())} END AS resource_name,
        CASE resource_name WHEN 'click' THEN 'NP15' WHEN 'view' THEN 'SCE' WHEN 'purchase' THEN 'SMUD' WHEN 'signup' THEN 'SP15' END AS zone,
        'CAISO' AS region, 'caiso_oasis_sld' AS data_source FROM load_raw WHERE load > 20 AND load < 90""",
    dbl="load",
)
def _(v):
    path = landing(v, "xml")
    rows = v.load_raw.select(
        ct.lookup(_RES, F.col("resource_name")).alias("RESOURCE_NAME"),
        F.when(F.col("load") > 20, "LOAD_5MIN_MW").otherwise("OTHER_MW").alias("DATA_ITEM"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'-00:00'").alias("INTERVAL_START_GMT"),
        F.when(F.col("load") < 90, F.col("load").cast("string")).otherwise("n/a").alias("VALUE"),
    )
    rows.write.format("xml").option("rootTag", "OASISReport").option("rowTag", "REPORT_DATA").save(path)
    return fs.read_report_xml(v.spark, path)


def forecast_docs(v):
    """One nested forecast document per zone and day, issued 90 minutes before the day."""
    period = F.struct(
        F.col("timestamp").alias("startTime"),
        (F.col("temp_c") * 9 / 5 + 32).alias("temperature"),
        F.struct(F.col("humidity").alias("value")).alias("relativeHumidity"),
        F.concat(F.hour("timestamp").cast("string"), F.lit(" mph")).alias("windSpeed"),
    )
    day = F.date_trunc("day", "timestamp")
    # At most 24 periods in a document: all are read.
    return v.weather_hourly.groupBy("zone", day.alias("day")).agg(F.sort_array(F.collect_list(period)).alias("periods")).select(
        "zone", (F.col("day") - F.expr("interval 90 minutes")).alias("issued"), F.struct("periods").alias("properties")
    )


_HOURLY = f"""SELECT {TS}, zone, temp_c, humidity, extract(hour FROM {TS}) * 1.60934 AS wind_speed_kmh, 'nws' AS forecast_source,
    date_trunc('day', {TS}) - INTERVAL 90 MINUTE AS forecast_issued,
    trunc((epoch({TS}) - epoch(date_trunc('day', {TS}) - INTERVAL 90 MINUTE)) / 3600) AS forecast_horizon_hours
    FROM weather_hourly"""


@query("src06_hourly_forecast_json", _HOURLY, dbl="temp_c humidity wind_speed_kmh", lng="forecast_horizon_hours")
def _(v):
    path = landing(v, "json")
    forecast_docs(v).write.json(path)
    return fs.read_hourly_json(v.spark, path)


@query(
    "src07_daily_records",
    f"""SELECT date, tmax AS "TMAX", tmin AS "TMIN", CASE WHEN n > 70 THEN prcp END AS "PRCP", (tmax + tmin) / 2 / 10 AS temp_c FROM (
        SELECT CAST({TS} AS DATE) AS date, max(temp_c) * 10 AS tmax, min(temp_c) * 10 AS tmin, sum(wind_speed) AS prcp, count(*) AS n FROM weather_hourly GROUP BY 1)""",
    dbl="TMAX TMIN PRCP temp_c",
)
def _(v):
    daily = v.weather_hourly.groupBy(F.to_date("timestamp").alias("date")).agg(
        (F.max("temp_c") * 10).alias("TMAX"), (F.min("temp_c") * 10).alias("TMIN"), F.sum("wind_speed").alias("PRCP"), F.count(F.lit(1)).alias("n")
    )
    long = daily.unpivot(["date", "n"], ["TMAX", "TMIN", "PRCP"], "datatype", "value").where("datatype <> 'PRCP' or n > 70").drop("n")
    return fs.daily_records(long)


@query(
    "src08_station_hours",
    f"""SELECT {TS}, temp_c, humidity, wind_speed, 'CAISO' AS region, 'station' AS data_source FROM weather_hourly WHERE humidity <= 60""",
    dbl="temp_c humidity wind_speed",
)
def _(v):
    rows = v.weather_hourly.select(
        F.col("timestamp").alias("time"), F.col("temp_c").alias("temp"),
        F.when(F.col("humidity") <= 60, F.col("humidity")).alias("rhum"), F.col("wind_speed").alias("wspd"), F.lit(1).alias("coco"),
    )
    return fs.station_hours(rows, "CAISO", "station")


@query(
    "src09_current_conditions",
    f"""SELECT zone, {TS}, temp_c, humidity, wind_speed * 3.6 AS wind_speed, extract(hour FROM {TS}) % 5 AS weather_code, 'x' AS city,
        CASE extract(hour FROM {TS}) % 5 WHEN 0 THEN 'clear sky' WHEN 1 THEN 'mainly clear' WHEN 2 THEN 'partly cloudy' WHEN 3 THEN 'overcast' ELSE 'weather code 4' END AS description
        FROM weather_hourly QUALIFY row_number() OVER (PARTITION BY zone ORDER BY {TS} DESC) = 1""",
    dbl="temp_c humidity wind_speed",
    lng="weather_code",
)
def _(v):
    path = landing(v, "conditions")
    rows = v.weather_hourly.withColumns({"weather_code": F.hour("timestamp") % 5, "city": F.lit("x")})
    rows.write.json(path)
    return fs.read_conditions(v.spark, path)


@query(
    "src10_parquet_snapshot",
    f"SELECT zone, {TS}, temp_c, forecast_horizon_hours FROM forecast_hourly WHERE zone = 'NP15'",
    dbl="temp_c",
    lng="forecast_horizon_hours",
)
def _(v):
    path = landing(v, "snapshots")
    fs.write_snapshot(v.forecast_hourly, path, "2024-01-31")
    return v.spark.read.parquet(path).where("zone = 'NP15'").select("zone", "timestamp", "temp_c", "forecast_horizon_hours")


@query(
    "src11_result_sinks",
    "SELECT kind, zone, avg(load) AS mean_load FROM load_hourly, (VALUES ('json'), ('csv')) k(kind) GROUP BY 1, 2",
    dbl="mean_load",
)
def _(v):
    result = v.load_hourly.groupBy("zone").agg(F.avg("load").alias("mean_load"))
    base, schema = landing(v, "results"), "zone string, mean_load double"
    fs.write_results(result, f"{base}/json")
    fs.write_results(result, f"{base}/csv", "csv")
    j = v.spark.read.schema(schema).json(f"{base}/json").withColumn("kind", F.lit("json"))
    c = v.spark.read.schema(schema).option("header", True).csv(f"{base}/csv").withColumn("kind", F.lit("csv"))
    return j.unionByName(c)


@query(
    "src12_master_metadata",
    f"SELECT count(*) AS total_records, count(zone) AS mapped_records, min({TS}) AS first_ts, max({TS}) AS last_ts, count(DISTINCT zone) AS n_zones FROM load_raw",
    lng="total_records mapped_records n_zones",
)
def _(v):
    return fs.write_master(v.load_raw, landing(v, "master"))


@query(
    "pip13_forecast_landing",
    f"""SELECT count(*) AS zones_attempted, count(n) AS zones_successful, count(*) FILTER (n IS NULL) AS zones_failed,
        coalesce(sum(n), 0) AS total_forecasts, coalesce(max(h), 0) AS forecast_horizon_hours
        FROM (VALUES ('NP15'), ('SCE'), ('SMUD'), ('PGE_VALLEY'), ('SP15'), ('SDGE')) e(zone)
        LEFT JOIN (SELECT zone, count(*) AS n, max(forecast_horizon_hours) AS h FROM ({_HOURLY}) WHERE temp_c BETWEEN -20 AND 60 GROUP BY zone) USING (zone)""",
    lng="zones_attempted zones_successful zones_failed total_forecasts forecast_horizon_hours",
)
def _(v):
    path = landing(v, "landed")
    rows = land_forecasts(fs.hourly_forecasts(forecast_docs(v)))
    fs.write_snapshot(rows, path, "2024-01-31")
    expected = v.spark.createDataFrame([(z,) for z in ("NP15", "SCE", "SMUD", "PGE_VALLEY", "SP15", "SDGE")], "zone string")
    return ag.collection_summary(expected, v.spark.read.parquet(path))
