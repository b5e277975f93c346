"""Checked queries: joins, deduplication, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import catalog as ct
from gridweave.core.series import with_position
from gridweave.operators import clean as cl
from gridweave.operators import joins as jn
from gridweave.operators.windows import last_rows
from gridweave.plans import features as pf
from gridweave.plans import master as ms
from workload.features import H4, TS
from workload.harness import query
from workload.windows import Z

MAPPED = "SELECT * FROM load_raw WHERE zone IS NOT NULL"


@query(
    "joi01_inner_with_suffixes",
    f"""WITH p AS (SELECT {TS}, sum(load) AS load, 'A' AS region, 'power' AS data_source FROM load_hourly GROUP BY 1),
        w AS (SELECT {TS}, avg(temp_c) AS temp_c, 'A' AS region, 'station' AS data_source FROM weather_hourly GROUP BY 1)
        SELECT p.{TS}, load, temp_c, p.region AS region_power, w.region AS region_weather, p.data_source AS data_source_power,
               w.data_source AS data_source_weather FROM p JOIN w ON p.{TS} = w.{TS}""",
    dbl="load temp_c",
)
def _(v):
    p = v.load_hourly.groupBy("timestamp").agg(F.sum("load").alias("load"))
    w = v.weather_hourly.groupBy("timestamp").agg(F.avg("temp_c").alias("temp_c"))
    p = p.withColumns({"region": F.lit("A"), "data_source": F.lit("power")})
    w = w.withColumns({"region": F.lit("A"), "data_source": F.lit("station")})
    return jn.merge(p, w, ["timestamp"])


@query(
    "joi02_left_load_weather_forecast",
    f"""SELECT l.zone, l.{TS}, l.load, w.temp_c, w.humidity, w.wind_speed, f.temp_c AS temp_c_forecast, f.forecast_horizon_hours
        FROM load_hourly l LEFT JOIN weather_hourly w ON l.zone = w.zone AND l.{TS} = w.{TS}
        LEFT JOIN forecast_hourly f ON l.zone = f.zone AND l.{TS} = f.{TS}""",
    dbl="load temp_c humidity wind_speed temp_c_forecast",
    lng="forecast_horizon_hours",
)
def _(v):
    fc = v.forecast_hourly.select("zone", "timestamp", "temp_c", "forecast_horizon_hours")
    both = jn.merge(v.load_hourly, v.weather_hourly, ["timestamp", "zone"], "left", ("", "_weather"))
    return jn.merge(both, fc, ["timestamp", "zone"], "left", ("", "_forecast"))


def _asof_sql(limit: str) -> str:
    return f"""SELECT l.zone, l.{TS}, l.seq, l.load, {limit.format(c='w.temp_c')} AS temp_c, {limit.format(c='w.humidity')} AS humidity
        FROM ({MAPPED}) l ASOF LEFT JOIN weather_hourly w ON l.zone = w.zone AND l.{TS} >= w.{TS}"""


ONE_HOUR = f"CASE WHEN epoch_us(l.{TS}) - epoch_us(w.{TS}) <= 3600000000 THEN {{c}} END"


@query("joi03_asof_one_hour", _asof_sql(ONE_HOUR), dbl="load temp_c humidity")
def _(v):
    left = v.load_raw.where("zone is not null").select("zone", "timestamp", "seq", "load")
    right = v.weather_hourly.select("zone", "timestamp", "temp_c", "humidity")
    return jn.asof_join(left, right, tolerance_seconds=3600)


@query("joi04_asof_unlimited", _asof_sql("{c}"), dbl="load temp_c humidity")
def _(v):
    left = v.load_raw.where("zone is not null").select("zone", "timestamp", "seq", "load")
    return jn.asof_join(left, v.weather_hourly.select("zone", "timestamp", "temp_c", "humidity"))


@query(
    "joi05_nearest_weather",
    f"""SELECT b.zone, b.{TS}, b.seq, b.load,
        CASE WHEN coalesce(epoch_us(b.{TS}) - epoch_us(b.bt) <= epoch_us(f.ft) - epoch_us(b.{TS}), b.bt IS NOT NULL) THEN b.bc ELSE f.fc END AS temp_c,
        CASE WHEN coalesce(epoch_us(b.{TS}) - epoch_us(b.bt) <= epoch_us(f.ft) - epoch_us(b.{TS}), b.bt IS NOT NULL) THEN b.bt ELSE f.ft END AS matched_at
        FROM (SELECT l.*, w.{TS} AS bt, w.temp_c AS bc FROM ({MAPPED}) l ASOF LEFT JOIN weather_hourly w ON l.zone = w.zone AND l.{TS} >= w.{TS}) b
        JOIN (SELECT l.seq, w.{TS} AS ft, w.temp_c AS fc FROM ({MAPPED}) l ASOF LEFT JOIN weather_hourly w ON l.zone = w.zone AND l.{TS} <= w.{TS}) f
        USING (seq)""",
    dbl="load temp_c",
)
def _(v):
    left = v.load_raw.where("zone is not null").select("zone", "timestamp", "seq", "load")
    return jn.nearest_join(left, v.weather_hourly.select("zone", "timestamp", "temp_c"))


LATEST = f"SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {TS} DESC) AS back FROM load_hourly"


@query(
    "joi06_horizon_expansion",
    f"""SELECT zone, {TS}, load, h AS horizon_hours, {TS} + to_hours(h) AS target_time
        FROM ({LATEST}), (VALUES (1), (6), (12), (24), (48)) t(h) WHERE back = 1""",
    dbl="load",
    lng="horizon_hours",
)
def _(v):
    latest = jn.latest_per_key(v.load_hourly, ["zone"], ["timestamp"])
    return jn.expand_horizons(latest, (1, 6, 12, 24, 48))


@query(
    "joi07_latest_lags",
    f"""SELECT zone, max({TS}) AS {TS}, max(CASE WHEN back = 1 THEN load END) AS load_lag_1h,
        max(CASE WHEN back = 24 THEN load END) AS load_lag_24h, coalesce(max(CASE WHEN back = 100000 THEN load END), 0) AS load_lag_100000h
        FROM ({LATEST}) GROUP BY zone""",
    dbl="load_lag_1h load_lag_24h load_lag_100000h",
)
def _(v):
    return jn.latest_lags(v.load_hourly, (1, 24, 100000))


@query(
    "joi08_composite_zone",
    f"""WITH p AS (SELECT * FROM load_hourly WHERE zone IN ('SCE', 'SP15'))
        SELECT 'LA_METRO' AS composite, {TS}, sum(load) AS predicted_load, sum(load) - sqrt(sum(pow(load * 0.05, 2))) AS confidence_lower,
        sum(load) + sqrt(sum(pow(load * 0.05, 2))) AS confidence_upper FROM p GROUP BY {TS} HAVING count(*) = 2""",
    dbl="predicted_load confidence_lower confidence_upper",
)
def _(v):
    parts = [(c, z) for c, zs in ct.COMPOSITES.items() for z in zs]
    composition = v.spark.createDataFrame(parts, "composite string, zone string")
    return jn.composite_forecast(v.load_hourly, composition, "load", by=("timestamp",))


def _case(values: dict, col: str, default) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {x}" for k, x in values.items())
    return f"CAST(CASE {col} {whens} ELSE {default} END AS DOUBLE)"


@query(
    "joi09_constant_lookups",
    f"""SELECT zone, {TS}, seq, {_case(ct.LOAD_WEIGHTS, 'zone', 0.1)} AS load_weight, {_case(ct.EVENING_MULTIPLIER, 'zone', 1.0)} AS multiplier,
        {_case(ct.GROWTH_FACTOR, 'zone', 0.0)} AS growth, {_case(ct.SCALE_FACTOR, 'zone', 0.1)} AS scale FROM load_raw""",
    dbl="load_weight multiplier growth scale",
)
def _(v):
    z = F.col("zone")
    return v.load_raw.select(
        "zone", "timestamp", "seq",
        ct.lookup(ct.LOAD_WEIGHTS, z, 0.1).alias("load_weight"),
        ct.lookup(ct.EVENING_MULTIPLIER, z, 1.0).alias("multiplier"),
        ct.lookup(ct.GROWTH_FACTOR, z, 0.0).alias("growth"),
        ct.lookup(ct.SCALE_FACTOR, z, 0.1).alias("scale"),
    )


@query(
    "joi10_weather_fallback",
    f"""WITH cur AS (SELECT * FROM weather_hourly QUALIFY row_number() OVER (PARTITION BY zone ORDER BY {TS} DESC) = 1),
        z AS (SELECT * FROM (VALUES ('NP15', NULL), ('SCE', NULL), ('LA_METRO', 'SCE'), ('SDGE', NULL)) t(zone, alt))
        SELECT z.zone, coalesce(c.temp_c, a.temp_c, 20) AS temp_c, coalesce(c.humidity, a.humidity, 50) AS humidity,
               coalesce(c.wind_speed, a.wind_speed, 10) AS wind_speed,
               CASE WHEN c.temp_c IS NOT NULL THEN 'zone' WHEN a.temp_c IS NOT NULL THEN 'component' ELSE 'default' END AS weather_source
        FROM z LEFT JOIN cur c ON z.zone = c.zone LEFT JOIN cur a ON z.alt = a.zone""",
    dbl="temp_c humidity wind_speed",
)
def _(v):
    current = jn.latest_per_key(v.weather_hourly, ["zone"], ["timestamp"])
    zones = v.spark.createDataFrame([("NP15",), ("SCE",), ("LA_METRO",), ("SDGE",)], "zone string")
    return jn.weather_with_fallback(zones, current, {"LA_METRO": "SCE"}, {"temp_c": 20.0, "humidity": 50.0, "wind_speed": 10.0})


# The increment repeats the readings above 40, some of them with a corrected load.
INCREMENT_SQL = "SELECT resource_name, zone, {ts}, seq, CASE WHEN load > 60 THEN load + 1 ELSE load END AS load FROM load_raw WHERE load > 40"
ARRIVALS = f"""SELECT date_trunc('hour', {TS}) AS {TS}, zone, resource_name, seq, load, 0 AS source_rank FROM load_raw
    UNION ALL SELECT date_trunc('hour', {TS}) AS {TS}, zone, resource_name, seq, load, 1 AS source_rank FROM ({INCREMENT_SQL.format(ts=TS)})"""


def arrivals(v):
    hist = v.load_raw.withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    inc = hist.where("load > 40").withColumn("load", F.when(F.col("load") > 60, F.col("load") + 1).otherwise(F.col("load")))
    return hist, inc


@query(
    "win11_dedupe_keep_last",
    f"""SELECT {TS}, zone, resource_name, seq, load FROM ({ARRIVALS})
        QUALIFY row_number() OVER (PARTITION BY {TS}, zone, resource_name ORDER BY source_rank DESC, seq DESC) = 1""",
    dbl="load",
)
def _(v):
    both = cl.union_sources(*arrivals(v))
    return cl.deduplicate(both, ["timestamp", "zone", "resource_name"], ["source_rank", "seq"]).drop("source_rank")


@query(
    "pip07_master_refresh",
    f"""WITH m AS (SELECT {TS}, zone, seq, load FROM ({ARRIVALS})
        QUALIFY row_number() OVER (PARTITION BY {TS}, zone ORDER BY source_rank DESC, seq DESC) = 1)
        SELECT zone, count(*) AS n_rows, min({TS}) AS first_ts, max({TS}) AS last_ts, avg(load) AS mean_load,
               count(*) FILTER (g > 900) AS gap_count, max(g) FILTER (g > 900) AS largest_gap_seconds
        FROM (SELECT *, (epoch_us({TS}) - lag(epoch_us({TS})) OVER ({Z})) / 1e6 AS g FROM m) GROUP BY zone""",
    dbl="mean_load largest_gap_seconds",
    lng="n_rows gap_count",
)
def _(v):
    from gridweave.core.series import join_keys
    from gridweave.operators.windows import gap_report

    master = ms.refresh_master(*arrivals(v), keys=("timestamp", "zone"))
    per_zone = master.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.avg("load").alias("mean_load"),
    )
    return join_keys(per_zone, gap_report(master, 900), ["zone"])


@query(
    "set01_union_by_name",
    f"""SELECT {TS}, zone, load, NULL::DOUBLE AS temp_c, 0 AS source_rank FROM load_hourly
        UNION ALL SELECT {TS}, zone, NULL, temp_c, 1 FROM weather_hourly""",
    dbl="load temp_c",
    lng="source_rank",
)
def _(v):
    return cl.union_sources(v.load_hourly, v.weather_hourly.select("timestamp", "zone", "temp_c"))


@query(
    "set02_missing_zones",
    "SELECT zone FROM (VALUES " + ", ".join(f"('{z}')" for z in ct.EXPECTED_ZONES) + ") t(zone) EXCEPT SELECT zone FROM load_raw",
)
def _(v):
    expected = v.spark.createDataFrame([(z,) for z in ct.EXPECTED_ZONES], "zone string")
    return expected.join(v.load_raw.select("zone").distinct(), "zone", "left_anti")


@query(
    "set03_distinct_resources",
    "SELECT DISTINCT resource_name, zone, CAST(zone IS NOT NULL AS INT) AS is_mapped FROM load_raw",
    lng="is_mapped",
)
def _(v):
    return v.load_raw.select("resource_name", "zone").distinct().withColumn("is_mapped", F.col("zone").isNotNull().cast("int"))


@query(
    "srt01_zone_time_order",
    f"SELECT zone, {TS}, load, row_number() OVER ({Z}) - 1 AS pos FROM load_hourly",
    dbl="load",
    lng="pos",
)
def _(v):
    return with_position(v.load_hourly, "pos", None).orderBy("zone", "timestamp")


@query("srt02_last_thousand", f"SELECT {TS}, seq, load FROM load_raw ORDER BY {TS} DESC, seq DESC LIMIT 1000", dbl="load")
def _(v):
    return v.load_raw.select("timestamp", "seq", "load").orderBy(F.desc("timestamp"), F.desc("seq")).limit(1000)
