"""Checked queries: lags, rolling windows, smoothing and other series windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import smoothing as sm
from gridweave.operators import windows as wn
from gridweave.functions import calendar as cal
from gridweave.operators.joins import lag_by_time
from workload.harness import query

Z = 'PARTITION BY zone ORDER BY "timestamp"'
RAW = 'PARTITION BY zone ORDER BY "timestamp", seq'
PANEL_ORDER = 'PARTITION BY zone ORDER BY "timestamp", l_orderkey, l_linenumber, y_true, y_pred'
PANEL = {"order": ("timestamp", "l_orderkey", "l_linenumber", "y_true", "y_pred")}
RAW_ORDER = {"order": ("timestamp", "seq")}


def rows(n: int, ahead: int = 0) -> str:
    last = f"{ahead} FOLLOWING" if ahead else "CURRENT ROW"
    return f"ROWS BETWEEN {n} PRECEDING AND {last}"


LAGS = (1, 2, 3, 6, 12, 24)


@query(
    "win01_row_lags",
    "SELECT *, " + ", ".join(f"lag(load, {k}) OVER ({Z}) AS load_lag_{k}h" for k in LAGS) + " FROM load_hourly",
    dbl="load " + " ".join(f"load_lag_{k}h" for k in LAGS),
)
def _(v):
    return wn.lag_features(v.load_hourly, "load", LAGS)


@query(
    "win02_lags_per_zone",
    f"""SELECT l.zone, l."timestamp", load, temp_c, lag(load, 1) OVER ({Z}) AS load_lag_1h,
        lag(load, 24) OVER ({Z}) AS load_lag_24h, lag(load, 168) OVER ({Z}) AS load_lag_168h,
        lag(temp_c, 1) OVER ({Z}) AS temp_c_lag_1h, lag(temp_c, 2) OVER ({Z}) AS temp_c_lag_2h
        FROM load_hourly l JOIN weather_hourly w USING (zone, "timestamp")""",
    dbl="load temp_c load_lag_1h load_lag_24h load_lag_168h temp_c_lag_1h temp_c_lag_2h",
)
def _(v):
    df = v.load_hourly.join(v.weather_hourly.select("zone", "timestamp", "temp_c"), ["zone", "timestamp"])
    return wn.over_series(
        df,
        lambda s: {**wn.lag_columns(s, "load", (1, 24, 168)), **wn.lag_columns(s, "temp_c", (1, 2))},
        back=168,
    )


@query(
    "win02_lags_by_time",
    """SELECT a.zone, a."timestamp", a.load, b.load AS load_lag_1h, c.load AS load_lag_24h FROM load_hourly a
       LEFT JOIN load_hourly b ON a.zone = b.zone AND a."timestamp" = b."timestamp" + INTERVAL 1 HOUR
       LEFT JOIN load_hourly c ON a.zone = c.zone AND a."timestamp" = c."timestamp" + INTERVAL 24 HOUR""",
    dbl="load load_lag_1h load_lag_24h",
)
def _(v):
    return lag_by_time(v.load_hourly, "load", (1, 24))


@query(
    "win03_lead_target",
    f"SELECT *, lead(load, 3) OVER ({Z}) AS load_target_3h FROM load_hourly",
    dbl="load load_target_3h",
)
def _(v):
    return wn.target_feature(v.load_hourly, "load", 3)


_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
_W4 = [(n, s) for n in (3, 6, 12, 24) for s in _AGG]


@query(
    "win04_full_rolling",
    "SELECT *, "
    + ", ".join(
        f"CASE WHEN count(load) OVER ({Z} {rows(n - 1)}) = {n} THEN {_AGG[s]}(load) OVER ({Z} {rows(n - 1)}) END"
        f" AS load_rolling_{n}h_{s}"
        for n, s in _W4
    )
    + " FROM load_hourly",
    dbl="load " + " ".join(f"load_rolling_{n}h_{s}" for n, s in _W4),
)
def _(v):
    return wn.rolling_features(v.load_hourly)


_W5 = [(n, s) for n in (6, 12, 24, 48) for s in ("mean", "std")]


@query(
    "win05_partial_rolling",
    "SELECT *, "
    + ", ".join(f"{_AGG[s]}(load) OVER ({Z} {rows(n - 1)}) AS load_rolling_{s}_{n}h" for n, s in _W5)
    + ", "
    + ", ".join(f"avg(load) OVER ({Z} {rows(n - 1)}) AS load_ma_{n}h" for n in (4, 8))
    + " FROM load_hourly",
    dbl="load load_ma_4h load_ma_8h " + " ".join(f"load_rolling_{s}_{n}h" for n, s in _W5),
)
def _(v):
    def build(s):
        return {
            **wn.rolling_columns(s, "load", (6, 12, 24, 48), ("mean", "std"), "load_rolling_{stat}_{n}h", least=1),
            **wn.rolling_columns(s, "load", (4, 8), ("mean",), "load_ma_{n}h", least=1),
        }

    return wn.over_series(v.load_hourly, build, back=47)


H4 = (1, 6, 12, 24)
FC = 'PARTITION BY zone ORDER BY "timestamp", forecast_horizon_hours'
FC_ORDER = {"order": ("timestamp", "forecast_horizon_hours")}
PROXY_SQL = (
    "SELECT *, "
    + ", ".join(f"pt AS temp_forecast_{h}h, ph AS humidity_forecast_{h}h, pw AS wind_forecast_{h}h,"
                f" greatest(pt - 18, 0) AS cooling_forecast_{h}h, greatest(18 - pt, 0) AS heating_forecast_{h}h" for h in H4)
    + f""" FROM (SELECT *, avg(temp_c) OVER ({FC} {rows(23)}) AS pt, avg(humidity) OVER ({FC} {rows(11)}) AS ph,
            avg(wind_speed_kmh) OVER ({FC} {rows(5)}) AS pw FROM forecast_hourly)"""
)
PROXY_COLS = " ".join(f"{n}_forecast_{h}h" for h in H4 for n in ("temp", "humidity", "wind", "cooling", "heating"))
FC_COLS = "temp_c humidity wind_speed_kmh"


@query(
    "win06_forecast_proxies",
    f"SELECT * EXCLUDE (pt, ph, pw) FROM ({PROXY_SQL})",
    dbl=f"{FC_COLS} {PROXY_COLS}",
    lng="forecast_horizon_hours",
)
def _(v):
    return wn.forecast_proxies(v.forecast_hourly, H4, **FC_ORDER)


@query(
    "win06_actual_horizons",
    """SELECT zone, "timestamp", """
    + ", ".join(
        f"max(CASE WHEN forecast_horizon_hours = {h} THEN temp_c END) AS temp_forecast_{h}h,"
        f" max(CASE WHEN forecast_horizon_hours = {h} THEN humidity END) AS humidity_forecast_{h}h,"
        f" max(CASE WHEN forecast_horizon_hours = {h} THEN wind_speed_kmh END) AS wind_forecast_{h}h,"
        f" greatest(max(CASE WHEN forecast_horizon_hours = {h} THEN temp_c END) - 18, 0) AS cooling_forecast_{h}h,"
        f" greatest(18 - max(CASE WHEN forecast_horizon_hours = {h} THEN temp_c END), 0) AS heating_forecast_{h}h"
        for h in H4
    )
    + " FROM forecast_hourly GROUP BY 1, 2",
    dbl=PROXY_COLS,
)
def _(v):
    return wn.forecast_by_horizon(v.forecast_hourly, H4)


def _std3(c: str) -> str:
    return f"CASE WHEN count({c}) OVER ({FC} {rows(5)}) >= 3 THEN stddev_samp({c}) OVER ({FC} {rows(5)}) END"


CHANGE_SQL = f"""SELECT *, (temp_forecast_6h - temp_c) / 6 AS temp_change_rate_6h,
    (temp_forecast_12h - temp_c) / 12 AS temp_change_rate_12h, (temp_forecast_24h - temp_c) / 24 AS temp_change_rate_24h,
    (humidity_forecast_6h - humidity) / 6 AS humidity_change_rate_6h,
    (humidity_forecast_12h - humidity) / 12 AS humidity_change_rate_12h,
    {_std3('temp_forecast_6h')} AS weather_volatility_6h, {_std3('temp_forecast_24h')} AS temp_forecast_stability
    FROM ({PROXY_SQL})"""
CHANGE_COLS = (
    "temp_change_rate_6h temp_change_rate_12h temp_change_rate_24h humidity_change_rate_6h humidity_change_rate_12h"
    " weather_volatility_6h temp_forecast_stability"
)


@query(
    "win07_weather_change",
    f"SELECT * EXCLUDE (pt, ph, pw) FROM ({CHANGE_SQL})",
    dbl=f"{FC_COLS} {PROXY_COLS} {CHANGE_COLS}",
    lng="forecast_horizon_hours",
)
def _(v):
    return wn.weather_change_features(wn.forecast_proxies(v.forecast_hourly, H4, **FC_ORDER), **FC_ORDER)


@query(
    "win08_percent_change",
    f"""SELECT zone, "timestamp", seq, p / nullif(lag(p, 24) OVER ({RAW}), 0) - 1 AS load_daily_change FROM (
        SELECT *, last_value(x IGNORE NULLS) OVER ({RAW}) AS p FROM (
            SELECT *, CASE WHEN load < 5 THEN NULL ELSE load END AS x FROM load_raw WHERE zone IS NOT NULL))""",
    dbl="load_daily_change",
)
def _(v):
    df = v.load_raw.where("zone is not null").withColumn("load", F.when(F.col("load") >= 5, F.col("load")))
    return wn.percent_change(df, "load", 24, **RAW_ORDER).select("zone", "timestamp", "seq", "load_daily_change")


@query(
    "win09_volatility",
    f"""SELECT zone, avg(dp) AS y_pred_volatility, max(dp) AS y_pred_max_step, count(*) FILTER (dp > 50000) AS y_pred_spikes,
        avg(da) AS y_true_volatility, max(da) AS y_true_max_step, count(*) FILTER (da > 50000) AS y_true_spikes,
        avg(dp) / nullif(avg(da), 0) AS volatility_ratio FROM (
        SELECT zone, abs(y_pred - lag(y_pred) OVER ({PANEL_ORDER})) AS dp,
               abs(y_true - lag(y_true) OVER ({PANEL_ORDER})) AS da FROM pred_panel) GROUP BY zone""",
    dbl="y_pred_volatility y_pred_max_step y_true_volatility y_true_max_step volatility_ratio",
    lng="y_pred_spikes y_true_spikes",
)
def _(v):
    return wn.volatility(v.pred_panel, ["y_pred", "y_true"], 50000, **PANEL)


def _gap_sql(limit: float) -> str:
    return f"""SELECT zone, count(*) FILTER (g > {limit}) AS gap_count, max(g) FILTER (g > {limit}) AS largest_gap_seconds
        FROM (SELECT zone, (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER ({RAW})) / 1000000.0 AS g
              FROM load_raw) GROUP BY zone"""


for _limit, _name in ((900, "15min"), (450, "450s"), (7200, "2h")):

    @query(f"win10_gaps_over_{_name}", _gap_sql(_limit), dbl="largest_gap_seconds", lng="gap_count")
    def _(v, limit=_limit):
        return wn.gap_report(v.load_raw, limit)


@query(
    "win12_zero_interpolation",
    f"""SELECT zone, "timestamp", seq, CASE WHEN x IS NOT NULL THEN x WHEN n.v IS NULL THEN p.v
            ELSE p.v + (n.v - p.v) * (ix - p.ix) / (n.ix - p.ix) END AS load FROM (
        SELECT *, last_value(CASE WHEN x IS NOT NULL THEN {{'ix': ix, 'v': x}} END IGNORE NULLS) OVER ({RAW}) AS p,
               first_value(CASE WHEN x IS NOT NULL THEN {{'ix': ix, 'v': x}} END IGNORE NULLS) OVER ({RAW}
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM (
            SELECT *, row_number() OVER ({RAW}) - 1 AS ix, CASE WHEN load >= 10 THEN load END AS x
            FROM load_raw WHERE zone IS NOT NULL))""",
    dbl="load",
)
def _(v):
    df = v.load_raw.where("zone is not null").withColumn("load", F.when(F.col("load") < 10, 0.0).otherwise(F.col("load")))
    return wn.fill_zeros(df, "load", **RAW_ORDER).select("zone", "timestamp", "seq", "load")


@query(
    "win13_light_smoothing",
    f"""SELECT zone, "timestamp", 0.7 * load + (1 - 0.7) * avg(load) OVER ({Z} {rows(1, 1)}) AS load FROM load_hourly""",
    dbl="load",
)
def _(v):
    return wn.light_smoothing(v.load_hourly)


@query(
    "win14_time_split",
    f"""SELECT zone, "timestamp", load, CASE WHEN ix < floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'val' END AS split_80,
        CASE WHEN ix < floor(n * 0.7 + 1e-9) THEN 'train' WHEN ix < floor(n * 0.8 + 1e-9) THEN 'val' ELSE 'test' END AS split_70,
        CASE WHEN "timestamp" < TIMESTAMP '2024-01-24' THEN 'train' ELSE 'test' END AS split_date
        FROM (SELECT *, row_number() OVER ({Z}) - 1 AS ix, count(*) OVER (PARTITION BY zone) AS n FROM load_hourly)""",
    dbl="load",
)
def _(v):
    df = wn.split_by_position(v.load_hourly, [("train", 0.8), ("val", 1.0)], "split_80")
    df = wn.split_by_position(df, [("train", 0.7), ("val", 0.8), ("test", 1.0)], "split_70")
    return df.withColumn("split_date", F.when(F.col("timestamp") < "2024-01-24", "train").otherwise("test"))


@query(
    "win15_last_rows",
    f"""SELECT zone, "timestamp", seq, load FROM load_raw
        QUALIFY row_number() OVER (PARTITION BY zone ORDER BY "timestamp" DESC, seq DESC) <= 25""",
    dbl="load",
)
def _(v):
    return wn.last_rows(v.load_raw, 25, **RAW_ORDER).select("zone", "timestamp", "seq", "load")


@query(
    "win16_demand_trend",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY "timestamp" DESC) AS back FROM load_hourly),
       t AS (SELECT zone, max(CASE WHEN back = 1 THEN load END) AS current_load,
             avg(CASE WHEN back <= 4 THEN load END) AS recent_mean, avg(CASE WHEN back BETWEEN 5 AND 8 THEN load END) AS previous_mean
             FROM r GROUP BY zone),
       c AS (SELECT *, coalesce((recent_mean - previous_mean) / nullif(previous_mean, 0) * 100, 0) AS trend_change_pct FROM t)
       SELECT *, CASE WHEN abs(trend_change_pct) < 0.5 THEN 'stable' WHEN trend_change_pct > 0 THEN 'rising' ELSE 'falling' END
                 AS trend_direction, 0 AS is_peak_hours, 8 AS hours_to_peak, TIMESTAMP '2024-01-31 18:00:00' AS next_peak_time
       FROM c""",
    dbl="current_load recent_mean previous_mean trend_change_pct",
    lng="is_peak_hours hours_to_peak",
)
def _(v):
    return wn.demand_trend(v.load_hourly, F.lit("2024-01-31 10:30:00").cast("timestamp"))


@query(
    "win17_smooth_twice",
    f"""SELECT zone, "timestamp", l_orderkey, l_linenumber,
        CASE WHEN ix >= 2 THEN avg(s1) OVER ({PANEL_ORDER} {rows(2)}) ELSE s1 END AS y_pred_smoothed FROM (
        SELECT *, CASE WHEN ix >= 4 THEN avg(y_pred) OVER ({PANEL_ORDER} {rows(4)}) ELSE y_pred END AS s1 FROM (
        SELECT *, row_number() OVER ({PANEL_ORDER}) - 1 AS ix FROM pred_panel))""",
    dbl="y_pred_smoothed",
    lng="l_linenumber",
)
def _(v):
    out = sm.smooth_twice(v.pred_panel, "y_pred", **PANEL)
    return out.select("zone", "timestamp", "l_orderkey", "l_linenumber", "y_pred_smoothed")


@query(
    "win18_constrained",
    f"""SELECT zone, "timestamp", l_orderkey, l_linenumber, CASE WHEN ix >= 5 THEN
            least(greatest(y_pred, greatest(m - 2 * s, y_true - 0.05 * y_true)), least(m + 2 * s, y_true + 0.05 * y_true))
            ELSE least(greatest(y_pred, y_true - 0.10 * y_true), y_true + 0.10 * y_true) END AS y_pred_constrained FROM (
        SELECT *, row_number() OVER ({PANEL_ORDER}) - 1 AS ix, avg(y_true) OVER ({PANEL_ORDER} {rows(5)}) AS m,
               stddev_pop(y_true) OVER ({PANEL_ORDER} {rows(5)}) AS s FROM pred_panel)""",
    dbl="y_pred_constrained",
    lng="l_linenumber",
)
def _(v):
    out = sm.constrain(v.pred_panel, "y_true", "y_pred", **PANEL)
    return out.select("zone", "timestamp", "l_orderkey", "l_linenumber", "y_pred_constrained")


_EMA = " + ".join(
    f"coalesce(lag(g, {j}) OVER w * CASE WHEN ix = {j} THEN {0.3**j!r} ELSE {0.7 * 0.3**j!r} END, 0)" for j in range(33)
)


@query(
    "win19_trend_smoothing",
    f"""SELECT zone, "timestamp", l_orderkey, l_linenumber, y_true + {_EMA} AS y_pred_smoothed FROM (
        SELECT *, y_pred - y_true AS g, row_number() OVER ({PANEL_ORDER}) - 1 AS ix FROM pred_panel)
        WINDOW w AS ({PANEL_ORDER})""",
    dbl="y_pred_smoothed",
    lng="l_linenumber",
)
def _(v):
    out = sm.trend_smoothing(v.pred_panel, "y_true", "y_pred", 0.7, **PANEL)
    return out.select("zone", "timestamp", "l_orderkey", "l_linenumber", "y_pred_smoothed")


def _filtered(inflow: str, impulse: str, result: str) -> str:
    """A linear recurrence as the sum of its inflow times the impulse response, which is below 1e-19 after 320 rows."""
    return f"""WITH RECURSIVE h(k, a, b, c) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1, {impulse}, a, b FROM h WHERE k < 319),
        r AS (SELECT list(a ORDER BY k DESC) AS back FROM h),
        g AS (SELECT *, y_pred - y_true AS gap, row_number() OVER ({PANEL_ORDER}) - 1 AS ix FROM pred_panel),
        u AS (SELECT *, {inflow} AS inflow FROM g WINDOW w AS ({PANEL_ORDER})),
        l AS (SELECT *, list(inflow) OVER ({PANEL_ORDER} ROWS 319 PRECEDING) AS last FROM u)
        SELECT zone, "timestamp", l_orderkey, l_linenumber, {result} + list_dot_product(last, back[320 - len(last) + 1:]) AS y_pred_smoothed FROM l, r"""


@query(
    "win19_trend_smoothing_slow",
    _filtered("CASE WHEN ix = 0 THEN gap ELSE 0.2 * gap END", "0.8 * a", "y_true"),
    dbl="y_pred_smoothed",
    lng="l_linenumber",
)
def _(v):
    out = sm.trend_smoothing(v.pred_panel, "y_true", "y_pred", 0.2, **PANEL)
    return out.select("zone", "timestamp", "l_orderkey", "l_linenumber", "y_pred_smoothed")


@query(
    "win20_recursive_smoothing",
    _filtered(
        """CASE ix WHEN 0 THEN y_pred WHEN 1 THEN y_pred - lag(y_pred) OVER w / 4
            WHEN 2 THEN y_pred - (lag(y_pred) OVER w + lag(y_pred, 2) OVER w) / 4 ELSE y_pred / 4 END""",
        "(a + b + c) / 4",
        "0",
    ),
    dbl="y_pred_smoothed",
    lng="l_linenumber",
)
def _(v):
    out = sm.recursive_smoothing(v.pred_panel, "y_pred", **PANEL)
    return out.select("zone", "timestamp", "l_orderkey", "l_linenumber", "y_pred_smoothed")


@query(
    "win21_uniform_nearest",
    f"""SELECT zone, "timestamp", load, (sum(load) OVER ({Z} {rows(2, 2)})
            + first_value(load) OVER ({Z} {rows(2, 2)}) * greatest(2 - ix, 0)
            + last_value(load) OVER ({Z} {rows(2, 2)}) * greatest(2 - (n - 1 - ix), 0)) / 5 AS load_uniform
        FROM (SELECT *, row_number() OVER ({Z}) - 1 AS ix, count(*) OVER (PARTITION BY zone) AS n FROM load_hourly)""",
    dbl="load load_uniform",
)
def _(v):
    return sm.uniform_smoothing(v.load_hourly, "load", 5)


@query(
    "win21_zero_padded",
    f"""SELECT zone, "timestamp", load, sum(load) OVER ({Z} {rows(1, 1)}) / 3 AS load_padded FROM load_hourly""",
    dbl="load load_padded",
)
def _(v):
    return sm.zero_padded_mean(v.load_hourly, "load", 3)


@query(
    "win22_running_abs_error",
    f"""SELECT zone, "timestamp", l_orderkey, l_linenumber, CAST(sum(CAST(abs(y_pred - y_true) AS DECIMAL(18,4)))
            OVER ({PANEL_ORDER} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_abs_error FROM pred_panel""",
    dbl="cumulative_abs_error",
    lng="l_linenumber",
)
def _(v):
    gap = F.abs(F.col("y_pred") - F.col("y_true")).cast("decimal(18,4)")
    df = v.pred_panel.withColumns({"gap": gap, "none": F.lit(0).cast("decimal(18,4)")})
    out = wn.running_abs_error(df, "none", "gap", **PANEL)
    return out.select("zone", "timestamp", "l_orderkey", "l_linenumber", "cumulative_abs_error")


@query(
    "win23_days_since_start",
    """SELECT zone, "timestamp", load, (epoch_us("timestamp") - epoch_us(a)) / 1e6 / 86400 AS days_since_start,
        floor((epoch_us(b) - epoch_us("timestamp")) / 1e6 / 86400) AS days_from_latest,
        (epoch_us("timestamp") - epoch_us(a)) / 1e6 / 86400 *
            CASE zone WHEN 'SCE' THEN 0.02 WHEN 'SP15' THEN 0.015 ELSE 0 END / 365 AS zone_growth_effect FROM (
        SELECT *, min("timestamp") OVER (PARTITION BY zone) AS a, max("timestamp") OVER (PARTITION BY zone) AS b FROM load_hourly)""",
    dbl="load days_since_start zone_growth_effect",
    lng="days_from_latest",
)
def _(v):
    df = cal.days_since_start(v.load_hourly).withColumn("is_evening_peak", F.lit(0))
    return cal.zone_factors(df).select(
        "zone", "timestamp", "load", "days_since_start", "days_from_latest", "zone_growth_effect"
    )


@query(
    "win24_quantile_flags",
    """SELECT zone, "timestamp", load, CAST(load > p95 AS INT) AS extreme_peak_indicator,
        CAST(load > p90 AS INT) AS peak_demand_indicator, CAST(load < p30 AS INT) AS off_peak_indicator
        FROM load_hourly JOIN (SELECT zone, quantile_cont(load, 0.95) AS p95, quantile_cont(load, 0.9) AS p90,
             quantile_cont(load, 0.3) AS p30 FROM load_hourly GROUP BY zone) USING (zone)""",
    dbl="load",
    lng="extreme_peak_indicator peak_demand_indicator off_peak_indicator",
)
def _(v):
    return wn.quantile_flags(v.load_hourly)


for _rounding in ("floor", "ceil"):

    @query(
        f"win25_downsample_{_rounding}",
        f"""SELECT zone, "timestamp", seq, load FROM (SELECT *, row_number() OVER ({RAW}) - 1 AS ix,
            count(*) OVER (PARTITION BY zone) AS n FROM load_raw)
            WHERE ix % greatest(CAST({_rounding}(n / 300.0) AS BIGINT), 1) = 0""",
        dbl="load",
    )
    def _(v, rounding=_rounding):
        return wn.downsample(v.load_raw, 300, rounding, **RAW_ORDER).select("zone", "timestamp", "seq", "load")


def _recursive_sql(step: str, first: str) -> str:
    """The recurrence row by row, as a recursive query."""
    return f"""WITH RECURSIVE s AS (SELECT zone, "timestamp", load, load * 0.98 AS p, row_number() OVER ({Z}) - 1 AS ix FROM load_hourly),
        r(zone, "timestamp", ix, a, o1, o2, o3) AS (
            SELECT zone, "timestamp", ix, load, {first}, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM s WHERE ix = 0
            UNION ALL SELECT s.zone, s."timestamp", s.ix, s.load, {step}, r.o1, r.o2 FROM r JOIN s ON s.zone = r.zone AND s.ix = r.ix + 1)
        SELECT zone, "timestamp", o1 AS p_smoothed FROM r"""


def _guess(v):
    return v.load_hourly.withColumn("p", F.col("load") * 0.98)


@query(
    "udf02_recursive_smoothing",
    _recursive_sql("CASE WHEN s.ix < 3 THEN s.p ELSE (s.p + r.o1 + r.o2 + r.o3) / 4 END", "p"),
    dbl="p_smoothed",
)
def _(v):
    return sm.recursive_smoothing(_guess(v), "p").select("zone", "timestamp", "p_smoothed")


@query(
    "udf02_slow_trend_smoothing",
    _recursive_sql("0.2 * s.p + (1 - 0.2) * (r.o1 + s.load - r.a)", "p"),
    dbl="p_smoothed",
)
def _(v):
    return sm.trend_smoothing(_guess(v), "load", "p", 0.2).select("zone", "timestamp", "p_smoothed")
