"""Checked queries: scalar feature functions and composed feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.catalog import HOLIDAYS
from gridweave.functions import calendar as cal
from gridweave.functions import expr as ex
from gridweave.functions import weather as wx
from gridweave.functions.sqlfns import register_functions
from gridweave.operators import windows as wn
from gridweave.plans import features as pf
from gridweave.plans import forecast as fc
from gridweave.sources.files import weather_text
from workload.harness import query
from workload.windows import CHANGE_COLS, CHANGE_SQL, FC_COLS, FC_ORDER, H4, PROXY_COLS, Z, rows

TS = '"timestamp"'
# hour, weekday (Monday 0), month, day of year of the row in SQL.
PARTS = f"""SELECT *, CAST(extract(hour FROM {TS}) AS BIGINT) AS h, CAST(extract(isodow FROM {TS}) AS BIGINT) - 1 AS d,
    CAST(extract(month FROM {TS}) AS BIGINT) AS m, CAST(extract(doy FROM {TS}) AS BIGINT) AS y,
    CAST(extract(quarter FROM {TS}) AS BIGINT) AS q"""


def parts(view: str) -> str:
    return f"({PARTS} FROM {view})"


def b(cond: str) -> str:
    """Flag in SQL."""
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def wave(x: str, p: float, kind: str) -> str:
    return f"{kind}(2 * pi() * {x} / {float(p)})"


CAL_SQL = f"h AS hour, d AS day_of_week, y AS day_of_year, m AS month, q AS quarter, {b('d >= 5')} AS is_weekend"
CAL_COLS = "hour day_of_week day_of_year month quarter is_weekend"
CYC = [(f"{n}_{k}", wave(c, p, k)) for n, c, p in (("hour", "h", 24), ("day_of_week", "d", 7), ("day_of_year", "y", 365.25)) for k in ("sin", "cos")]
CYC_SQL = ", ".join(f"{e} AS {n}" for n, e in CYC)
CYC_COLS = " ".join(n for n, _ in CYC)


@query("fn01_calendar", f"SELECT zone, {TS}, load, {CAL_SQL} FROM {parts('load_hourly')}", dbl="load", lng=CAL_COLS)
def _(v):
    return cal.calendar_parts(v.load_hourly)


@query(
    "fn02_business_hours",
    f"SELECT zone, {TS}, load, {CAL_SQL}, {b('h BETWEEN 6 AND 18 AND d < 5')} AS is_business_hours,"
    f" {b('h BETWEEN 8 AND 18 AND d < 5')} AS is_business_hour FROM {parts('load_hourly')}",
    dbl="load",
    lng=f"{CAL_COLS} is_business_hours is_business_hour",
)
def _(v):
    df = cal.calendar_parts(v.load_hourly)
    return cal.business_hours(cal.business_hours(df, 6, 18, "is_business_hours"), 8, 18)


@query(
    "fn03_cyclic",
    f"SELECT zone, {TS}, load, {CAL_SQL}, {CYC_SQL}, {wave('m', 12, 'sin')} AS month_sin, {wave('m', 12, 'cos')} AS month_cos"
    f" FROM {parts('load_hourly')}",
    dbl=f"load {CYC_COLS} month_sin month_cos",
    lng=CAL_COLS,
)
def _(v):
    return cal.month_cycle(cal.cyclic_parts(cal.calendar_parts(v.load_hourly)))


W_COLS = "temp_c humidity wind_speed"


@query(
    "fn04_degree_days",
    f"""SELECT zone, {TS}, greatest(temp_c - 18, 0) AS cooling_degree_days, greatest(18 - temp_c, 0) AS heating_degree_days,
        greatest(temp_c * 9 / 5 + 32 - 75, 0) AS cooling_degree_hours_f FROM weather_hourly""",
    dbl="cooling_degree_days heating_degree_days cooling_degree_hours_f",
)
def _(v):
    warm = ex.above(F.col("temp_c") * 9 / 5 + 32 - 75, 0.0)
    return v.weather_hourly.select(
        "zone", "timestamp", *[c.alias(n) for n, c in wx.degree_days().items()], warm.alias("cooling_degree_hours_f")
    )


WX_A = """temp_c * temp_c AS temp_c_squared, greatest(temp_c - 18, 0) AS cooling_degree_days,
    greatest(18 - temp_c, 0) AS heating_degree_days, temp_c * humidity / 100 AS temp_humidity_interaction,
    temp_c - wind_speed * 0.5 AS wind_chill_effect"""
WX_A_COLS = "temp_c_squared cooling_degree_days heating_degree_days temp_humidity_interaction wind_chill_effect"


@query("fn05_weather_a", f"SELECT *, {WX_A} FROM weather_hourly", dbl=f"{W_COLS} {WX_A_COLS}")
def _(v):
    return wx.weather_features(v.weather_hourly)


@query(
    "fn06_weather_b",
    f"""SELECT zone, {TS}, temp_c, humidity, wind_speed AS wind_speed_kmh, temp_c * temp_c AS temp_c_squared,
        greatest(temp_c - 18, 0) AS cooling_degree_days, greatest(18 - temp_c, 0) AS heating_degree_days,
        humidity * humidity AS humidity_squared, wind_speed * wind_speed AS wind_speed_squared FROM weather_hourly""",
    dbl="temp_c humidity wind_speed_kmh temp_c_squared cooling_degree_days heating_degree_days humidity_squared wind_speed_squared",
)
def _(v):
    return wx.historical_weather_features(v.weather_hourly.withColumnRenamed("wind_speed", "wind_speed_kmh"))


INTER_SQL = f"""temp_c * humidity AS temp_humidity_interaction, temp_c + 0.5 * humidity AS heat_index_approx,
    temp_c * wind_speed_kmh AS temp_wind_interaction, temp_c - 0.1 * wind_speed_kmh AS wind_chill_approx,
    temp_c * {b('h BETWEEN 14 AND 18')} AS afternoon_heat_load, temp_c * {b('h BETWEEN 19 AND 23')} AS evening_temp_relief,
    temp_c * {b('h <= 10')} AS morning_temp_baseline, {b('h BETWEEN 16 AND 20 AND temp_c >= 35')} AS peak_heat_stress,
    temp_c * {wave('h', 24, 'sin')} AS temp_hour_sin_interaction, temp_c * {wave('h', 24, 'cos')} AS temp_hour_cos_interaction,
    temp_c * {b('d >= 5')} AS weekend_temp_load"""
INTER_COLS = """temp_humidity_interaction heat_index_approx temp_wind_interaction wind_chill_approx afternoon_heat_load
    evening_temp_relief morning_temp_baseline temp_hour_sin_interaction temp_hour_cos_interaction weekend_temp_load"""


@query(
    "fn07_weather_interactions",
    f"SELECT zone, {TS}, {INTER_SQL} FROM (SELECT *, wind_speed AS wind_speed_kmh FROM {parts('weather_hourly')})",
    dbl=INTER_COLS,
    lng="peak_heat_stress",
)
def _(v):
    df = v.weather_hourly.withColumnRenamed("wind_speed", "wind_speed_kmh")
    df = wx.weather_interactions(cal.cyclic_parts(cal.calendar_parts(df)))
    return df.select("zone", "timestamp", *INTER_COLS.split(), "peak_heat_stress")


ADV_SQL = f"""temp_c * temp_c AS temp_squared, temp_c * temp_c * temp_c AS temp_cubed,
    temp_c * humidity AS temp_humidity_interaction, temp_c * wind_speed AS temp_wind_interaction,
    {b('temp_c > 30')} AS extreme_heat, {b('temp_c < 5')} AS extreme_cold,
    greatest(temp_c - 18, 0) AS cooling_degree_hours, greatest(18 - temp_c, 0) AS heating_degree_hours"""
ADV_COLS = "temp_squared temp_cubed temp_humidity_interaction temp_wind_interaction cooling_degree_hours heating_degree_hours"


@query(
    "fn08_weather_c",
    f"SELECT *, {ADV_SQL}, temp_c - lag(temp_c) OVER ({Z}) AS temp_change_1h FROM weather_hourly",
    dbl=f"{W_COLS} {ADV_COLS} temp_change_1h",
    lng="extreme_heat extreme_cold",
)
def _(v):
    df = wx.advanced_weather(v.weather_hourly)
    return wn.over_series(df, lambda s: {"temp_change_1h": F.col("temp_c") - s.lag("temp_c")}, back=1)


EVE_SQL = f"""{b('h BETWEEN 17 AND 21')} AS is_evening_peak,
    CASE WHEN h BETWEEN 17 AND 21 THEN (h - 17) / 4 ELSE 0 END AS evening_hour_intensity, abs(h - 18) / 24 AS hours_from_peak,
    CASE WHEN h BETWEEN 15 AND 19 THEN (h - 15) / 4 ELSE 0 END AS evening_ramp,
    CASE WHEN h BETWEEN 21 AND 23 THEN (23 - h) / 2 ELSE 0 END AS post_peak_decline"""
EVE_COLS = "evening_hour_intensity hours_from_peak evening_ramp post_peak_decline"


@query(
    "fn09_evening",
    f"SELECT zone, {TS}, load, h AS hour, {EVE_SQL} FROM {parts('load_hourly')}",
    dbl=f"load {EVE_COLS}",
    lng="hour is_evening_peak",
)
def _(v):
    return cal.evening_features(v.load_hourly)


# Fahrenheit temperatures high enough for the evening rule.
HOT_SQL = "SELECT *, temp_c * 1.8 + 32 AS temperature FROM"
EVW_SQL = f"""temperature * {b('h BETWEEN 17 AND 21')} AS temp_evening_interaction,
    greatest(temperature - 75, 0) AS cooling_degree_hour,
    CASE WHEN h BETWEEN 17 AND 21 AND temperature > 85 THEN temperature * exp((temperature - 85) / 20) ELSE temperature END
        AS evening_cooling_demand, 1 + (humidity - 50) / 100 AS humidity_cooling_factor,
    greatest(temperature - 75, 0) * (1 + (humidity - 50) / 100) AS humidity_cooling_demand"""
EVW_COLS = "temp_evening_interaction cooling_degree_hour evening_cooling_demand humidity_cooling_factor humidity_cooling_demand"


@query(
    "fn10_evening_weather",
    f"SELECT zone, {TS}, {EVW_SQL} FROM ({HOT_SQL} {parts('weather_hourly')})",
    dbl=EVW_COLS,
)
def _(v):
    df = v.weather_hourly.withColumn("temperature", F.col("temp_c") * 1.8 + 32)
    return wx.evening_weather(cal.evening_features(df)).select("zone", "timestamp", *EVW_COLS.split())


DEM_SQL = f"""{b('d >= 5')} AS weekend_flag, strftime({TS}, '%m-%d') AS month_day,
    {b("strftime(" + TS + ", '%m-%d') IN (" + ", ".join(repr(x) for x in HOLIDAYS) + ")")} AS near_holiday,
    {b('m IN (6, 7, 8, 9)')} AS is_summer_month, {b('h BETWEEN 17 AND 19 AND d < 5')} AS work_evening_overlap"""
DEM_COLS = "weekend_flag near_holiday is_summer_month work_evening_overlap"


@query(
    "fn11_demand_patterns",
    f"SELECT zone, {TS}, load, h AS hour, d AS weekday, {DEM_SQL} FROM {parts('load_daily')}",
    dbl="load",
    lng=f"hour weekday {DEM_COLS}",
)
def _(v):
    return cal.demand_pattern_flags(v.load_daily)


ZF_SQL = """CASE zone WHEN 'SCE' THEN 1.15 WHEN 'SP15' THEN 1.08 ELSE 1.0 END AS zone_evening_multiplier,
    CASE zone WHEN 'SCE' THEN 0.02 WHEN 'SP15' THEN 0.015 ELSE 0.0 END AS zone_growth_factor,
    is_evening_peak * CASE zone WHEN 'SCE' THEN 1.15 WHEN 'SP15' THEN 1.08 ELSE 1.0 END AS zone_adjusted_evening,
    days_since_start * CASE zone WHEN 'SCE' THEN 0.02 WHEN 'SP15' THEN 0.015 ELSE 0.0 END / 365 AS zone_growth_effect"""
ZF_COLS = "zone_evening_multiplier zone_growth_factor zone_adjusted_evening zone_growth_effect"
SINCE = f"(epoch_us({TS}) - epoch_us(min({TS}) OVER (PARTITION BY zone))) / 1e6 / 86400"


@query(
    "fn12_zone_factors",
    f"SELECT zone, {TS}, {ZF_SQL} FROM (SELECT *, {b('h BETWEEN 17 AND 21')} AS is_evening_peak, {SINCE} AS days_since_start"
    f" FROM {parts('load_hourly')})",
    dbl=ZF_COLS,
)
def _(v):
    df = cal.zone_factors(cal.days_since_start(cal.evening_features(v.load_hourly)))
    return df.select("zone", "timestamp", *ZF_COLS.split())


_E, _WE = b("h BETWEEN 17 AND 21"), b("d >= 5")
STRONG = {
    "is_weekend": _WE, "is_evening_peak": _E, "work_evening_overlap": f"{_E} * (1 - {_WE})",
    "extended_evening": b("h BETWEEN 16 AND 22"), "pre_evening_ramp": b("h BETWEEN 15 AND 17"),
    "post_evening_decline": b("h BETWEEN 20 AND 23"), "business_hours": b("h BETWEEN 8 AND 18"),
    "industrial_peak": b("h BETWEEN 10 AND 15"), "weekend_evening_different": f"{_E} * {_WE}",
    "high_demand_season": b("m BETWEEN 6 AND 9"), "evening_weekend_interaction": f"{_E} * {_WE}",
    "evening_month_interaction": f"{_E} * m", "evening_season_interaction": f"{_E} * {b('m BETWEEN 6 AND 9')}",
    "industrial_evening_overlap": f"{_E} * {b('h BETWEEN 10 AND 15')}", "hours_from_peak": "abs(h - 19)",
    "hour": "h", "day_of_week": "d", "month": "m",
}
STRONG_D = {
    "evening_hour_intensity": "CASE WHEN h BETWEEN 17 AND 21 THEN 1 - abs(h - 19) / 3 ELSE 0 END",
    "sce_evening_multiplier": "CASE WHEN h BETWEEN 17 AND 21 THEN 1.2 ELSE 1.0 END",
    **{f"{n}_{k}": wave(c, p, k) for n, c, p in (("hour", "h", 24), ("dow", "d", 7), ("month", "m", 12)) for k in ("sin", "cos")},
}


@query(
    "fn13_strong_evening",
    f"SELECT zone, {TS}, load, " + ", ".join(f"{e} AS {n}" for n, e in {**STRONG, **STRONG_D}.items())
    + f" FROM {parts('load_hourly')}",
    dbl="load " + " ".join(STRONG_D),
    lng=" ".join(STRONG),
)
def _(v):
    return cal.strong_evening_features(v.load_hourly)


_P = {
    "early_morning": "h BETWEEN 4 AND 7", "morning_ramp": "h BETWEEN 8 AND 11", "midday_peak": "h BETWEEN 12 AND 15",
    "afternoon_peak": "h BETWEEN 16 AND 19", "evening_decline": "h BETWEEN 20 AND 23", "overnight_low": "h BETWEEN 0 AND 3",
}
EXT = {"hour": "h", "month": "m", "day_of_week": "d"} | {n: b(c) for n, c in _P.items()} | {
    "summer_afternoon": b(f"{_P['midday_peak']} AND m IN (6, 7, 8)"),
    "summer_evening": b(f"{_P['afternoon_peak']} AND m IN (6, 7, 8)"),
    "winter_morning": b(f"{_P['morning_ramp']} AND m IN (12, 1, 2)"),
    "workday_morning": b(f"{_P['morning_ramp']} AND d < 5"), "workday_afternoon": b(f"{_P['afternoon_peak']} AND d < 5"),
    "weekend_midday": b(f"{_P['midday_peak']} AND d >= 5"),
} | {f"ac_hour_{k}": b(f"h = {k}") for k in (14, 15, 16, 17)}
EXT_D = {"hour_cubed": "pow(h, 3)", "hour_quartic": "pow(h, 4)"} | {
    f"hour_{s}_{k}": f"{s}(2 * pi() * h * {k} / 24)" for k in (2, 3, 4, 6, 8, 12) for s in ("sin", "cos")
}


@query(
    "fn14_extreme_temporal",
    f"SELECT zone, {TS}, load, " + ", ".join(f"{e} AS {n}" for n, e in {**EXT, **EXT_D}.items()) + f" FROM {parts('load_hourly')}",
    dbl="load " + " ".join(EXT_D),
    lng=" ".join(EXT),
)
def _(v):
    return cal.extreme_temporal_features(v.load_hourly)


ENH = {
    "morning_peak": b("h BETWEEN 7 AND 9"), "afternoon_peak": b("h BETWEEN 14 AND 16"), "evening_peak": b("h BETWEEN 17 AND 19"),
    "night_low": b("h BETWEEN 1 AND 5"), "weekend_hour": f"{_WE} * h", "weekday_hour": f"(1 - {_WE}) * h",
    "summer_indicator": b("m IN (6, 7, 8)"), "winter_indicator": b("m IN (12, 1, 2)"),
    "summer_hour": f"{b('m IN (6, 7, 8)')} * h", "winter_hour": f"{b('m IN (12, 1, 2)')} * h", "business_day": b("d < 5"),
    "business_hour": b("d < 5 AND h BETWEEN 8 AND 17"), "hour_squared": "h * h", "hour_cubed": "h * h * h",
}
ENH_D = {
    "hour_sin_2": f"pow({wave('h', 24, 'sin')}, 2)", "hour_cos_2": f"pow({wave('h', 24, 'cos')}, 2)",
    "hour_sin_cos": f"{wave('h', 24, 'sin')} * {wave('h', 24, 'cos')}",
}


@query(
    "fn15_enhanced_temporal",
    f"SELECT zone, {TS}, load, {CAL_SQL}, {CYC_SQL}, " + ", ".join(f"{e} AS {n}" for n, e in {**ENH, **ENH_D}.items())
    + f" FROM {parts('load_hourly')}",
    dbl=f"load {CYC_COLS} " + " ".join(ENH_D),
    lng=f"{CAL_COLS} " + " ".join(ENH),
)
def _(v):
    return cal.enhanced_temporal_features(cal.cyclic_parts(cal.calendar_parts(v.load_hourly)))


_OTHER = "NOT IN (" + ", ".join(f"'{z}'" for z in cal.REGIONAL_RULES) + ")"
REG = {n: f"CASE WHEN zone = '{z}' THEN {b(c)} END" for z, r in cal.REGIONAL_RULES.items() for n, c in r.items()}
REG |= {n: f"CASE WHEN zone IS NULL OR zone {_OTHER} THEN {b(c)} END" for n, c in cal.OTHER_ZONE_RULES.items()}
REG |= {n: b(c) for n, c in cal.SHARED_RULES.items()}


@query(
    "fn16_regional_flags",
    f"SELECT zone, {TS}, seq, " + ", ".join(f"{e} AS {n}" for n, e in REG.items()) + f" FROM {parts('load_raw')}",
    lng=" ".join(REG),
)
def _(v):
    return cal.regional_features(v.load_raw).select("zone", "timestamp", "seq", *REG)


XT_SQL = f"""CASE WHEN abs(temp_change_rate_6h * 6) > 10 THEN 1 ELSE 0 END AS rapid_temp_change,
    CASE WHEN temp_forecast_24h > p95 OR temp_forecast_24h < p05 THEN 1 ELSE 0 END AS extreme_temp_probability,
    least(forecast_horizon_hours / 48.0, 1.0) AS forecast_uncertainty_score,
    1 / (1 + weather_volatility_6h) AS weather_pattern_stability, 1 / (1 + temp_forecast_stability) AS forecast_confidence"""
Q95 = """JOIN (SELECT zone, quantile_cont(temp_c, 0.95) AS p95, quantile_cont(temp_c, 0.05) AS p05 FROM forecast_hourly
    GROUP BY zone) USING (zone)"""


@query(
    "pip02_forecast_features",
    f"SELECT * EXCLUDE (pt, ph, pw, p95, p05), {XT_SQL} FROM ({CHANGE_SQL}) {Q95}",
    dbl=f"{FC_COLS} {PROXY_COLS} {CHANGE_COLS} forecast_uncertainty_score weather_pattern_stability forecast_confidence",
    lng="forecast_horizon_hours rapid_temp_change extreme_temp_probability",
)
def _(v):
    return pf.forecast_features(v.forecast_hourly, order=("timestamp", "forecast_horizon_hours"))


@query(
    "fn17_extreme_weather",
    """SELECT zone, "timestamp", CASE WHEN f > 20 THEN 1 ELSE 0 END AS heat_wave_incoming,
        CASE WHEN f < 18 THEN 1 ELSE 0 END AS cold_snap_incoming, CASE WHEN abs((f - temp_c) / 6 * 6) > 10 THEN 1 ELSE 0 END AS rapid_temp_change
        FROM (SELECT *, avg(temp_c) OVER (PARTITION BY zone ORDER BY "timestamp" ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS f
              FROM weather_hourly)""",
    lng="heat_wave_incoming cold_snap_incoming rapid_temp_change",
)
def _(v):
    df = wn.weather_change_features(wn.forecast_proxies(v.weather_hourly, (6, 24, 48, 72)))
    out = wn.extreme_weather_features(df, hot=20.0, cold=18.0)
    return out.select("zone", "timestamp", "heat_wave_incoming", "cold_snap_incoming", "rapid_temp_change")


@query(
    "fn18_uncertainty",
    """SELECT zone, "timestamp", forecast_horizon_hours, least(forecast_horizon_hours / 48.0, 1.0) AS forecast_uncertainty_score,
        1 / (1 + humidity) AS weather_pattern_stability, 1 / (1 + wind_speed_kmh) AS forecast_confidence FROM forecast_hourly""",
    dbl="forecast_uncertainty_score weather_pattern_stability forecast_confidence",
    lng="forecast_horizon_hours",
)
def _(v):
    df = v.forecast_hourly.withColumnsRenamed(
        {"humidity": "weather_volatility_6h", "wind_speed_kmh": "temp_forecast_stability"}
    )
    return wx.uncertainty_features(df).select(
        "zone", "timestamp", "forecast_horizon_hours", "forecast_uncertainty_score", "weather_pattern_stability", "forecast_confidence"
    )


ERR_SQL = """WITH w AS (SELECT zone, "timestamp", temp_c AS actual, h FROM weather_shifted, (VALUES (1), (6), (12), (24)) t(h)),
    f AS (SELECT zone, forecast_horizon_hours AS h, "timestamp", temp_c AS predicted FROM forecast_hourly),
    j AS (SELECT w.zone, w.h, actual, CASE WHEN epoch_us(w."timestamp") - epoch_us(f."timestamp") <= 3600000000 THEN predicted END AS predicted
          FROM w ASOF LEFT JOIN f ON w.zone = f.zone AND w.h = f.h AND w."timestamp" >= f."timestamp"),
    e AS (SELECT zone, h, count(*) FILTER (actual IS NOT NULL AND predicted IS NOT NULL) AS n,
          avg(abs((actual - predicted) / nullif(actual, 0))) * 100 AS m FROM j GROUP BY zone, h)
    SELECT zone, h AS forecast_horizon_hours, n AS n_matches, CASE WHEN n > 10 THEN least(m, 50) ELSE 20 END AS error_pct FROM e"""
# Observations half an hour after the forecast hour, every second hour.
SHIFTED_SQL = """SELECT zone, "timestamp" + INTERVAL 30 MINUTE AS "timestamp", temp_c + 20 AS temp_c, humidity, wind_speed
    FROM weather_hourly"""


def shifted(v):
    return v.weather_hourly.withColumns(
        {"timestamp": F.col("timestamp") + F.expr("interval 30 minutes"), "temp_c": F.col("temp_c") + 20}
    )


@query(
    "agg19_historical_forecast_errors",
    ERR_SQL.replace("WITH w AS", f"WITH weather_shifted AS ({SHIFTED_SQL}), w AS"),
    dbl="error_pct",
    lng="forecast_horizon_hours n_matches",
)
def _(v):
    return fc.historical_errors(shifted(v), v.forecast_hourly)


_SAFE = [(f"{n}_{h}h", h, e) for h in H4 for n, e in (
    ("temp_forecast", "temp_c"), ("forecast_confidence", "greatest(1 - error_pct / 100, 0)"), ("forecast_uncertainty", "error_pct"))]


@query(
    "fn19_safe_forecasts",
    f"""WITH weather_shifted AS ({SHIFTED_SQL}), err AS ({ERR_SQL}),
        wide AS (SELECT zone, "timestamp", """
    + ", ".join(f"max(CASE WHEN forecast_horizon_hours = {h} THEN {e} END) AS {n}" for n, h, e in _SAFE)
    + """ FROM forecast_hourly JOIN err USING (zone, forecast_horizon_hours) GROUP BY 1, 2)
        SELECT s.zone, s."timestamp", s.temp_c, s.humidity, s.wind_speed, """
    + ", ".join(f"w.{n}" for n, _, _ in _SAFE) + ", "
    + ", ".join(f"0.7 * s.temp_c + 0.3 * w.temp_forecast_{h}h AS temp_forecast_weighted_{h}h" for h in H4)
    + """ FROM weather_shifted s ASOF LEFT JOIN wide w ON s.zone = w.zone AND s."timestamp" >= w."timestamp" """,
    dbl="temp_c humidity wind_speed " + " ".join(n for n, _, _ in _SAFE) + " " + " ".join(f"temp_forecast_weighted_{h}h" for h in H4),
)
def _(v):
    return fc.safe_forecast_features(shifted(v), v.forecast_hourly)


@query(
    "fn19_uncertainty_bounds",
    f"""WITH weather_shifted AS ({SHIFTED_SQL}), err AS ({ERR_SQL})
        SELECT zone, "timestamp", forecast_horizon_hours, temp_c - temp_c * error_pct / 100 * 0.15 AS temp_lower,
               temp_c + temp_c * error_pct / 100 * 0.15 AS temp_upper, greatest(1 - error_pct / 100, 0) AS confidence
        FROM forecast_hourly JOIN err USING (zone, forecast_horizon_hours)""",
    dbl="temp_lower temp_upper confidence",
    lng="forecast_horizon_hours",
)
def _(v):
    out = fc.bounded_forecasts(v.forecast_hourly, fc.historical_errors(shifted(v), v.forecast_hourly))
    return out.select("zone", "timestamp", "forecast_horizon_hours", "temp_lower", "temp_upper", "confidence")


@query(
    "fn20_units",
    """SELECT ts AS "timestamp", event_id, (value - 32) * 5 / 9 AS celsius, value * 1.60934 AS kmh, value * 3.6 AS kmh_from_ms,
        value / 10 AS tenths FROM events""",
    dbl="celsius kmh kmh_from_ms tenths",
)
def _(v):
    x = F.col("load")
    return v.load_raw.select(
        "timestamp",
        F.col("seq").alias("event_id"),
        ex.fahrenheit_to_celsius(x).alias("celsius"),
        ex.mph_to_kmh(x).alias("kmh"),
        ex.ms_to_kmh(x).alias("kmh_from_ms"),
        (x / 10).alias("tenths"),
    )


@query(
    "fn21_text",
    """SELECT event_id, CAST(user_id % 40 AS DOUBLE) AS mph, lower(event_type) AS kind,
        CAST(event_type LIKE '%ur%' AS INT) AS has_ur, CAST(regexp_matches(event_type, 'click|view') AS INT) AS is_visit,
        strftime(ts, '%m-%d') AS month_day,
        CASE user_id % 4 WHEN 0 THEN 'clear sky' WHEN 1 THEN 'mainly clear' WHEN 2 THEN 'partly cloudy' ELSE 'overcast' END AS description
        FROM events""",
    dbl="mph",
    lng="has_ur is_visit",
)
def _(v):
    u = F.col("user_id")
    return v.table("events").select(
        "event_id",
        ex.leading_number(F.concat((u % 40).cast("string"), F.lit(" mph"))).alias("mph"),
        F.lower("event_type").alias("kind"),
        ex.flag(F.col("event_type").contains("ur")).alias("has_ur"),
        ex.flag(F.col("event_type").rlike("click|view")).alias("is_visit"),
        F.date_format("ts", "MM-dd").alias("month_day"),
        weather_text((u % 4).cast("int")).alias("description"),
    )


@query(
    "fn25_bands",
    """SELECT l_orderkey, l_linenumber, y_true, y_pred, y_pred - 400 AS lower_bound, y_pred + 400 AS upper_bound,
        y_pred - y_pred * 0.05 AS share_lower, y_pred + y_pred * 0.05 AS share_upper,
        CASE WHEN y_pred > 35000 THEN 'high' WHEN y_pred > 30000 THEN 'moderate' ELSE 'normal' END AS demand_level,
        level, y_pred - y_pred * 0.10 * (level / 0.95) AS lower, y_pred + y_pred * 0.10 * (level / 0.95) AS upper
        FROM pred_panel, (VALUES (CAST(0.68 AS DOUBLE)), (0.95)) AS t(level)""",
    dbl="y_true y_pred lower_bound upper_bound share_lower share_upper level lower upper",
    lng="l_linenumber",
)
def _(v):
    return fc.level_bands(fc.fixed_band(v.pred_panel.drop("zone", "timestamp"), "y_pred"), "y_pred")


@query(
    "fn26_improvement",
    """SELECT l_orderkey, l_linenumber, y_true, y_pred,
        CASE WHEN l_linenumber > 1 THEN (y_pred - y_true) / y_true * 100 END AS improvement_pct FROM pred_panel""",
    dbl="y_true y_pred improvement_pct",
    lng="l_linenumber",
)
def _(v):
    df = v.pred_panel.withColumns({"enhanced": F.col("y_pred"), "baseline": F.when(F.col("l_linenumber") > 1, F.col("y_true")).otherwise(0.0)})
    return df.withColumn("improvement_pct", fc.improvement_pct()).drop("enhanced", "baseline", "zone", "timestamp")


@query(
    "udf01_sql_functions",
    """SELECT zone, "timestamp", greatest(temp_c - 18, 0) AS cooling, greatest(18 - temp_c, 0) AS heating,
        sin(2 * pi() * extract(hour FROM "timestamp") / 24) AS hour_sin, (humidity - 32) * 5 / 9 AS celsius,
        wind_speed * 1.60934 AS kmh, wind_speed * 3.6 AS kmh_from_ms FROM weather_hourly""",
    dbl="cooling heating hour_sin celsius kmh kmh_from_ms",
)
def _(v):
    register_functions(v.spark)
    return v.weather_hourly.selectExpr(
        "zone", "timestamp", "cooling_degrees(temp_c, 18) AS cooling", "heating_degrees(temp_c, 18) AS heating",
        "cycle_sin(hour(timestamp), 24) AS hour_sin", "f_to_c(humidity) AS celsius", "mph_to_kmh(wind_speed) AS kmh",
        "ms_to_kmh(wind_speed) AS kmh_from_ms",
    )


ROLL = [(n, s) for n in (3, 6, 12, 24) for s in ("mean", "std", "min", "max")]
FN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
LAGS = (1, 2, 3, 6, 12, 24)
PIP01_SQL = (
    "SELECT * FROM (SELECT l.zone, l.\"timestamp\", load, temp_c, humidity, wind_speed, "
    + ", ".join(f"lag(load, {k}) OVER ({Z}) AS load_lag_{k}h" for k in LAGS) + ", "
    + ", ".join(
        f"CASE WHEN count(load) OVER ({Z} {rows(n - 1)}) = {n} THEN {FN[s]}(load) OVER ({Z} {rows(n - 1)}) END AS load_rolling_{n}h_{s}"
        for n, s in ROLL
    )
    + f", lead(load, 1) OVER ({Z}) AS load_target_1h, h AS hour, d AS day_of_week, y AS day_of_year, m AS month, q AS quarter,"
    f" {b('d >= 5')} AS is_weekend, {b('h BETWEEN 6 AND 18 AND d < 5')} AS is_business_hours, {CYC_SQL}, {WX_A}"
    f" FROM {parts('load_hourly')} l JOIN weather_hourly w USING (zone, \"timestamp\"))"
    " WHERE load_lag_24h IS NOT NULL AND load_target_1h IS NOT NULL"
)


@query(
    "pip01_build_features",
    PIP01_SQL,
    dbl=f"load {W_COLS} " + " ".join(f"load_lag_{k}h" for k in LAGS) + " " + " ".join(f"load_rolling_{n}h_{s}" for n, s in ROLL)
    + f" load_target_1h {CYC_COLS} {WX_A_COLS}",
    lng=f"{CAL_COLS} is_business_hours",
)
def _(v):
    return pf.build_features(v.load_hourly, v.weather_hourly, on=("zone", "timestamp"), keys=("zone",))


_FEAT = [c for c in pf.forecast_feature_names() if "incoming" not in c]


@query(
    "pip03_unified_features",
    f"""WITH one AS (SELECT * FROM forecast_hourly QUALIFY row_number() OVER (PARTITION BY zone, "timestamp" ORDER BY forecast_issued DESC, forecast_horizon_hours) = 1),
        base AS (SELECT *, avg(temp_c) OVER w24 AS pt, avg(humidity) OVER ({Z} {rows(11)}) AS ph,
                 avg(wind_speed_kmh) OVER ({Z} {rows(5)}) AS pw FROM one WINDOW w24 AS ({Z} {rows(23)})),
        prox AS (SELECT *, """
    + ", ".join(f"pt AS temp_forecast_{h}h, ph AS humidity_forecast_{h}h, pw AS wind_forecast_{h}h,"
                f" greatest(pt - 18, 0) AS cooling_forecast_{h}h, greatest(18 - pt, 0) AS heating_forecast_{h}h" for h in H4)
    + f""" FROM base),
        chg AS (SELECT *, (pt - temp_c) / 6 AS temp_change_rate_6h, (pt - temp_c) / 12 AS temp_change_rate_12h,
                (pt - temp_c) / 24 AS temp_change_rate_24h, (ph - humidity) / 6 AS humidity_change_rate_6h,
                (ph - humidity) / 12 AS humidity_change_rate_12h,
                CASE WHEN count(pt) OVER ({Z} {rows(5)}) >= 3 THEN stddev_samp(pt) OVER ({Z} {rows(5)}) END AS weather_volatility_6h,
                CASE WHEN count(pt) OVER ({Z} {rows(5)}) >= 3 THEN stddev_samp(pt) OVER ({Z} {rows(5)}) END AS temp_forecast_stability
                FROM prox),
        qs AS (SELECT zone, quantile_cont(temp_c, 0.95) AS p95, quantile_cont(temp_c, 0.05) AS p05 FROM one GROUP BY zone),
        fx AS (SELECT * , {XT_SQL} FROM chg JOIN qs USING (zone)),
        wk AS (SELECT zone, "timestamp", temp_c, humidity, wind_speed AS wind_speed_kmh FROM weather_hourly),
        u AS (SELECT l.*, wk.temp_c, wk.humidity, wk.wind_speed_kmh, """
    + ", ".join(f"fx.{c}" for c in _FEAT)
    + f""" FROM {parts('load_hourly')} l LEFT JOIN wk ON l.zone = wk.zone AND l."timestamp" = wk."timestamp"
           LEFT JOIN fx ON l.zone = fx.zone AND l."timestamp" = fx."timestamp")
        SELECT zone, "timestamp", load, temp_c, humidity, wind_speed_kmh, """
    + ", ".join(_FEAT)
    + f""", {CAL_SQL}, {CYC_SQL}, temp_c * temp_c AS temp_c_squared,
        CASE WHEN temp_c IS NOT NULL THEN greatest(temp_c - 18, 0) END AS cooling_degree_days,
        CASE WHEN temp_c IS NOT NULL THEN greatest(18 - temp_c, 0) END AS heating_degree_days,
        humidity * humidity AS humidity_squared, wind_speed_kmh * wind_speed_kmh AS wind_speed_squared,
        lag(load, 1) OVER ({Z}) AS load_lag_1h, lag(load, 24) OVER ({Z}) AS load_lag_24h, {INTER_SQL} FROM u""",
    dbl="load temp_c humidity wind_speed_kmh " + " ".join(c for c in _FEAT if c not in ("rapid_temp_change", "extreme_temp_probability"))
    + f" {CYC_COLS} temp_c_squared cooling_degree_days heating_degree_days humidity_squared wind_speed_squared load_lag_1h load_lag_24h {INTER_COLS}",
    lng=f"{CAL_COLS} rapid_temp_change extreme_temp_probability peak_heat_stress",
)
def _(v):
    weather = v.weather_hourly.withColumnRenamed("wind_speed", "wind_speed_kmh")
    return pf.unified_features(v.load_hourly, weather, v.forecast_hourly)


PIP04_COLS = f"""load temperature humidity hour_sin hour_cos day_of_week_sin day_of_week_cos month_sin month_cos {EVE_COLS} {EVW_COLS}
    load_daily_change load_day_over_day load_lag_1h load_lag_2h load_ma_4h load_ma_8h temp_lag_1h temp_lag_2h
    days_since_start {ZF_COLS}"""
PIP04_LNG = f"hour weekday month is_evening_peak {DEM_COLS}"


@query(
    "pip04_evening_peak_features",
    f"""WITH src AS (SELECT l.zone, l."timestamp", load, temp_c * 1.8 + 32 AS temperature, humidity
            FROM load_hourly l JOIN weather_hourly USING (zone, "timestamp")),
        f AS (SELECT zone, "timestamp", load, temperature, humidity, h AS hour, d AS weekday, m AS month,
            {wave('h', 24, 'sin')} AS hour_sin, {wave('h', 24, 'cos')} AS hour_cos, {wave('d', 7, 'sin')} AS day_of_week_sin,
            {wave('d', 7, 'cos')} AS day_of_week_cos, {wave('m', 12, 'sin')} AS month_sin, {wave('m', 12, 'cos')} AS month_cos,
            {EVE_SQL}, {EVW_SQL}, load / nullif(lag(load, 24) OVER ({Z}), 0) - 1 AS load_daily_change,
            load / nullif(lag(load, 24) OVER ({Z}), 0) - 1 AS load_day_over_day, lag(load, 1) OVER ({Z}) AS load_lag_1h,
            lag(load, 2) OVER ({Z}) AS load_lag_2h, avg(load) OVER ({Z} {rows(3)}) AS load_ma_4h,
            avg(load) OVER ({Z} {rows(7)}) AS load_ma_8h, lag(temperature, 1) OVER ({Z}) AS temp_lag_1h,
            lag(temperature, 2) OVER ({Z}) AS temp_lag_2h, {SINCE} AS days_since_start, {DEM_SQL} FROM {parts('src')})
        SELECT *, {ZF_SQL} FROM f WHERE load_daily_change IS NOT NULL""",
    dbl=PIP04_COLS,
    lng=PIP04_LNG,
)
def _(v):
    warm = v.weather_hourly.select("zone", "timestamp", (F.col("temp_c") * 1.8 + 32).alias("temperature"), "humidity")
    return pf.evening_peak_features(v.load_hourly.join(warm, ["zone", "timestamp"]))


_RAW_HOUR = """SELECT zone, date_trunc('hour', "timestamp") AS "timestamp", avg(load) AS load FROM load_raw
    WHERE zone IS NOT NULL GROUP BY 1, 2"""
_PIP6 = f"""SELECT l.zone, l."timestamp", load, temp_c, humidity, wind_speed, {CAL_SQL}, {b('h BETWEEN 8 AND 18 AND d < 5')} AS is_business_hour,
    lag(load, 1) OVER ({Z}) AS load_lag_1h, lag(load, 24) OVER ({Z}) AS load_lag_24h"""


def _pip6_from() -> str:
    return f"""FROM ({PARTS} FROM (SELECT s.zone, s."timestamp", r.load FROM spine s LEFT JOIN raw r
        ON s.zone = r.zone AND s."timestamp" = r."timestamp")) l JOIN weather_hourly w USING (zone, "timestamp")"""


SPINE = f"""raw AS ({_RAW_HOUR}), span AS (SELECT zone, min("timestamp") AS a, max("timestamp") AS z FROM raw GROUP BY zone),
    spine AS (SELECT zone, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS "timestamp" FROM span)"""


@query(
    "pip06_hourly_model_table",
    f"""WITH {SPINE} SELECT * FROM ({_PIP6}, temp_c * temp_c AS temp_squared, temp_c * humidity AS temp_humidity_interaction,
        greatest(temp_c - 18, 0) AS cooling_degree_hours, greatest(18 - temp_c, 0) AS heating_degree_hours {_pip6_from()})
        WHERE load IS NOT NULL AND load_lag_1h IS NOT NULL AND load_lag_24h IS NOT NULL""",
    dbl=f"load {W_COLS} load_lag_1h load_lag_24h temp_squared temp_humidity_interaction cooling_degree_hours heating_degree_hours",
    lng=f"{CAL_COLS} is_business_hour",
)
def _(v):
    return pf.hourly_model_table(v.load_raw.where("zone is not null"), v.weather_hourly)


_Y = [(f"{k}_{n}", wave(c, p, k)) for n, c, p in (("hour", "h", 24), ("day_of_year", "y", 365)) for k in ("sin", "cos")]


@query(
    "pip06_advanced_model_table",
    f"""WITH {SPINE} SELECT * FROM ({_PIP6}, {ADV_SQL}, lag(temp_c) OVER ({Z}) AS temp_lag_1h,
        temp_c - lag(temp_c) OVER ({Z}) AS temp_change_1h, {", ".join(f"{e} AS {n}" for n, e in _Y)} {_pip6_from()})
        WHERE load IS NOT NULL AND load_lag_1h IS NOT NULL AND load_lag_24h IS NOT NULL""",
    dbl=f"load {W_COLS} load_lag_1h load_lag_24h {ADV_COLS} temp_lag_1h temp_change_1h " + " ".join(n for n, _ in _Y),
    lng=f"{CAL_COLS} is_business_hour extreme_heat extreme_cold",
)
def _(v):
    return pf.hourly_model_table(v.load_raw.where("zone is not null"), v.weather_hourly, advanced=True)
