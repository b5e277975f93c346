"""Expected facts of the feature functions on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridweave.functions import calendar as cal
from gridweave.functions import weather as wx
from gridweave.functions.expr import clip, leading_number
from gridweave.operators import windows as wn
from gridweave.plans import features as pf

T0 = dt.datetime(2024, 1, 1)


def hours(spark, n, load=lambda i: 1000.0 + i, zone="A", **cols):
    data = [(zone, T0 + dt.timedelta(hours=i), float(load(i)), *[float(f(i)) for f in cols.values()]) for i in range(n)]
    extra = "".join(f", {c} double" for c in cols)
    return spark.createDataFrame(data, f"zone string, timestamp timestamp, load double{extra}")


def col(df, name):
    return [r[name] for r in df.orderBy("timestamp").collect()]


def test_lags(spark):
    df = wn.lag_features(hours(spark, 48), "load", (1, 2, 6))
    assert col(df, "load_lag_1h")[:2] == [None, 1000]
    assert col(df, "load_lag_2h")[2] == col(df, "load_lag_6h")[6] == 1000


def test_lag_does_not_cross_zones(spark):
    df = hours(spark, 3).unionByName(hours(spark, 3, zone="B"))
    assert wn.lag_features(df, "load", (1,)).where("load_lag_1h is null").count() == 2


def test_rolling_facts(spark):
    flat = wn.rolling_features(hours(spark, 24, lambda i: 1000))
    assert col(flat, "load_rolling_3h_mean")[1] is None
    assert col(flat, "load_rolling_24h_mean")[-1] == 1000 and col(flat, "load_rolling_24h_std")[-1] == 0
    ramp = wn.rolling_features(hours(spark, 10, lambda i: 1000 + 100 * i), windows=(3,))
    assert [col(ramp, f"load_rolling_3h_{s}")[4] for s in ("mean", "min", "max")] == [1300, 1200, 1400]


def test_lead_target(spark):
    df = wn.target_feature(hours(spark, 10), "load", 3)
    assert col(df, "load_target_3h")[0] == 1003 and col(df, "load_target_3h")[-3:] == [None] * 3


def test_calendar_facts(spark):
    df = cal.temporal_features(hours(spark, 24 * 7))
    assert col(df, "day_of_week")[0] == 0 and set(col(df, "month")) == {1}
    assert {d for d, w in zip(col(df, "day_of_week"), col(df, "is_weekend")) if w} == {5, 6}
    assert [col(df, "is_business_hours")[h] for h in (5, 6, 18, 19)] == [0, 1, 1, 0]


def test_weather_facts(spark):
    df = hours(spark, 5, temp_c=lambda i: 10 + 5 * i, humidity=lambda i: 60 + 5 * i, wind_speed=lambda i: 5 + 5 * i)
    df = wx.weather_features(df)
    assert col(df, "temp_c_squared")[0] == 100
    assert col(df, "cooling_degree_days")[4] == 12 and col(df, "heating_degree_days")[0] == 8
    assert wx.weather_features(hours(spark, 3)).columns == ["zone", "timestamp", "load"]


def test_degree_days_keep_null(spark):
    df = spark.createDataFrame([(None,), (20.0,)], "temp_c double").withColumns(wx.degree_days())
    assert df.where("temp_c is null").first()["cooling_degree_days"] is None


def test_clip_upper_bound_wins(spark):
    df = spark.createDataFrame([(5.0, 8.0, 3.0)], "x double, lo double, hi double")
    assert df.select(clip(F.col("x"), F.col("lo"), F.col("hi"))).first()[0] == 3.0


def test_leading_number(spark):
    df = spark.createDataFrame([("10 mph",), ("5.5 to 10 mph",), ("calm",), (None,)], "s string")
    assert [r[0] for r in df.select(leading_number(F.col("s"))).collect()] == [10.0, 5.5, None, None]


def test_regional_rules_by_zone(spark):
    df = hours(spark, 24, zone="NP15").unionByName(hours(spark, 24, zone="ELSE"))
    out = cal.regional_features(df)
    own, other = out.where("zone = 'NP15'"), out.where("zone = 'ELSE'")
    assert sum(col(own, "tech_peak_hours")) == 9 and set(col(own, "ca_business_hours")) == {None}
    assert set(col(other, "tech_peak_hours")) == {None} and sum(col(other, "ca_business_hours")) == 11


def test_heat_wave_needs_three_horizons(spark):
    df = hours(spark, 3, temp_c=lambda i: 40)
    two = wn.extreme_weather_features(wn.forecast_proxies(df, (24, 48)))
    three = wn.extreme_weather_features(wn.forecast_proxies(df, (24, 48, 72)))
    assert "heat_wave_incoming" not in two.columns and col(three, "heat_wave_incoming") == [1, 1, 1]


def test_percent_change_pads_and_survives_zero(spark):
    df = hours(spark, 4, lambda i: [0, 2, 4, 8][i]).withColumn("load", F.when(F.col("load") != 4, F.col("load")))
    out = wn.percent_change(df, "load", 1)
    assert col(out, "load_daily_change") == [None, None, 0.0, 3.0]


def test_row_lag_and_time_lag_differ_over_gaps(spark):
    df = hours(spark, 5).where("load <> 1001")
    power = df.select("zone", "timestamp", "load")
    by_rows = pf.unified_features(power, config=pf.UnifiedConfig(lags=(1,)))
    by_time = pf.unified_features(power, config=pf.UnifiedConfig(lags=(1,), lag_mode="time"))
    assert col(by_rows, "load_lag_1h") == [None, 1000, 1002, 1003]
    assert col(by_time, "load_lag_1h") == [None, None, 1002, 1003]


def test_pipeline_has_no_nulls(spark):
    power = hours(spark, 72).drop("zone").withColumns({"region": F.lit("R"), "data_source": F.lit("p")})
    weather = hours(spark, 72, temp_c=lambda i: i % 30, humidity=lambda i: 50, wind_speed=lambda i: 9)
    weather = weather.drop("zone", "load").withColumns({"region": F.lit("R"), "data_source": F.lit("w")})
    out = pf.build_features(power, weather, lags=(1, 2, 6), windows=(3, 6))
    assert out.count() == 72 - 6 - 1
    assert {"region_power", "region_weather", "load_target_1h", "load_lag_6h"} <= set(out.columns)
    assert out.dropna().count() == out.count()
