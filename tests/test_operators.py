"""Joins, repair, metrics, quality and samples against brute force and edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridweave.operators import aggregates as ag
from gridweave.operators import clean as cl
from gridweave.operators import joins as jn
from gridweave.operators import metrics as mt
from gridweave.operators import quality as dq
from gridweave.operators import smoothing as sm
from gridweave.operators import weights as wt
from gridweave.operators import windows as wn
from tests.test_features import T0, col, hours


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def at(h, s=0):
    return T0 + dt.timedelta(hours=h, seconds=s)


def test_asof_tolerance_edges(spark):
    left = table(spark, [("A", at(1), 1), ("A", at(1, 1), 2), ("A", at(0), 3), ("B", at(5), 4)], "zone string, timestamp timestamp, id int")
    right = table(spark, [("A", at(0), 7.0)], "zone string, timestamp timestamp, t double")
    got = {r["id"]: r["t"] for r in jn.asof_join(left, right, tolerance_seconds=3600).collect()}
    assert got == {1: 7.0, 2: None, 3: 7.0, 4: None}


@pytest.mark.parametrize("chunk", ["1000000", "40"])
def test_asof_equals_pandas(spark, chunk):
    spark.conf.set("gridweave.rowsPerChunk", chunk)
    try:
        rng = np.random.default_rng(3)
        lp = pd.DataFrame({"timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 10**6, 400)), "s"), "zone": rng.choice(["A", "B"], 400), "id": range(400)})
        rp = pd.DataFrame({"timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 10**6, 150)), "s"), "zone": rng.choice(["A", "B"], 150), "v": rng.random(150), "s": range(150)})
        left, right = spark.createDataFrame(lp), spark.createDataFrame(rp)
        for direction in ("backward", "forward"):
            want = pd.merge_asof(lp, rp, on="timestamp", by="zone", direction=direction).set_index("id")["v"]
            got = jn.asof_join(left, right, seq="s", direction=direction).toPandas().set_index("id")["v"].reindex(want.index)
            pd.testing.assert_series_equal(got, want, check_exact=True)
    finally:
        spark.conf.unset("gridweave.rowsPerChunk")


def test_last_duplicate_wins_in_asof(spark):
    left = table(spark, [("A", at(1))], "zone string, timestamp timestamp")
    right = table(spark, [("A", at(1), 1.0, 1), ("A", at(1), 2.0, 2)], "zone string, timestamp timestamp, v double, seq int")
    assert jn.asof_join(left, right, seq="seq").first()["v"] == 2.0


def test_nearest_prefers_the_earlier(spark):
    left = table(spark, [("A", at(1), 1), ("A", at(9), 2), ("C", at(1), 3)], "zone string, timestamp timestamp, id int")
    right = table(spark, [("A", at(0), 0.0), ("A", at(2), 2.0)], "zone string, timestamp timestamp, v double")
    got = {r["id"]: r["v"] for r in jn.nearest_join(left, right).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: None}


def test_composite_needs_all_parts(spark):
    preds = table(spark, [("SCE", 1, 100.0), ("SP15", 1, 50.0), ("SCE", 2, 100.0)], "zone string, h int, p double")
    comp = table(spark, [("LA", "SCE"), ("LA", "SP15")], "composite string, zone string")
    out = jn.composite_forecast(preds, comp, "p", by=("h",)).collect()
    assert len(out) == 1 and out[0]["predicted_load"] == 150
    assert out[0]["confidence_upper"] == pytest.approx(150 + (5**2 + 2.5**2) ** 0.5)


def test_dedupe_keeps_last_and_joins_nulls(spark):
    rows = [(None, at(0), 1.0, 1), (None, at(0), 2.0, 2), ("A", at(0), 3.0, 1)]
    df = table(spark, rows, "zone string, timestamp timestamp, load double, seq int")
    got = cl.deduplicate(df, ["timestamp", "zone"], ["seq"]).collect()
    assert sorted(r["load"] for r in got) == [2.0, 3.0]


def test_dedupe_combines_hot_copies_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("A").alias("zone"), F.col("id").alias("seq"))
    plan = cl.deduplicate(df, ["zone"], ["seq"])._jdf.queryExecution().toString()
    assert "partial_max_by" in plan


def test_zero_interpolation_ends(spark):
    df = hours(spark, 7, lambda i: [0, 10, 0, 0, 40, 0, 0][i])
    assert col(wn.fill_zeros(df), "load") == [None, 10, 20, 30, 40, 40, 40]


def test_spine_has_the_missing_hours(spark):
    df = hours(spark, 30).where("load not in (1003, 1024)")
    out = ag.hourly_mean(df)
    assert out.count() == 30 and out.where("load is null").count() == 2


def test_weighted_average_renormalises_and_is_strict(spark):
    w = table(spark, [("A", 0.75), ("B", 0.25)], "zone string, weight double")
    df = table(spark, [("A", at(0), 10.0), ("B", at(0), 20.0), ("A", at(1), None), ("B", at(1), 7.0)], "zone string, timestamp timestamp, t double")
    assert col(ag.weighted_average(df, w, ["t"]), "t") == [12.5, 7.0]
    bad = df.unionByName(table(spark, [("X", at(0), 1.0)], "zone string, timestamp timestamp, t double"))
    with pytest.raises(Exception, match="unknown zone"):
        ag.weighted_average(bad, w, ["t"]).collect()


def test_metrics_facts(spark):
    df = table(spark, [(y, y - 5) for y in (100.0, 200.0, 150.0, 180.0, 120.0)], "y_true double, y_pred double")
    r = mt.core_metrics(df).first()
    assert r["mae"] == r["rmse"] == r["median_ae"] == r["max_error"] == 5 and r["bias"] == -5
    exact = mt.core_metrics(df.withColumn("y_pred", F.col("y_true"))).first()
    assert exact["r2"] == 1 and exact["mape"] == 0
    zero = mt.core_metrics(table(spark, [(0.0, 1.0), (0.0, 2.0)], "y_true double, y_pred double")).first()
    assert np.isfinite(zero["mape"]) and zero["r2"] == 0


def test_pinball_facts(spark):
    df = table(spark, [(y, y - 10) for y in (100.0, 200.0, 150.0, 180.0)], "y_true double, y_pred double")
    low, high = (r["pinball"] for r in mt.pinball_loss(df, [0.1, 0.9]).orderBy("quantile").collect())
    assert low == pytest.approx(1.0) and high == pytest.approx(9.0)
    over = mt.pinball_loss(df.withColumn("y_pred", F.col("y_true") + 10), [0.1, 0.9]).orderBy("quantile").collect()
    assert over[0]["pinball"] > over[1]["pinball"]


def test_evening_falls_back(spark):
    df = table(spark, [(100.0, 90.0, 3)], "y_true double, y_pred double, hour int")
    assert mt.evening_metrics(df).first()["evening_peak_mape"] == pytest.approx(10.0)
    assert mt.evening_metrics(df, empty=float("inf")).first()["evening_peak_mape"] == float("inf")


def test_outliers_skip_zero_spread_and_few_rows(spark):
    flat = hours(spark, 20, lambda i: 5 if i else 500)
    few = hours(spark, 5, lambda i: [1, 2, 3, 4, 900][i], zone="B")
    assert cl.without_outliers(flat.unionByName(few)).count() == 25
    assert cl.without_outliers(hours(spark, 20, lambda i: i if i else 500)).count() == 19


def test_recursive_smoothing_equals_the_loop(small_chunks):
    p = np.random.default_rng(1).random(1200) * 1000
    df = hours(small_chunks, 1200, lambda i: p[i])
    small_chunks.conf.set("gridweave.rowsPerChunk", "330")
    out = []
    for x in p:
        out.append(x if len(out) < 3 else (x + sum(out[-3:])) / 4)
    assert col(sm.recursive_smoothing(df, "load"), "load_smoothed") == pytest.approx(out, rel=1e-12)


def test_recursive_smoothing_gives_python_small_chunks(spark, monkeypatch):
    made, series = [], sm.series
    monkeypatch.setattr(sm, "series", lambda *a, **k: made.append(series(*a, **k)) or made[-1])
    df = spark.range(250_000).select(F.lit("A").alias("zone"), F.timestamp_seconds(F.col("id") * 60).alias("timestamp"), F.col("id").cast("double").alias("p"))
    out = sm.recursive_smoothing(df, "p")
    assert made[0].df.groupBy(*made[0].by).count().agg(F.max("count")).first()[0] <= 200_000
    # The outputs of a rising line trail it by 6 rows in the end.
    assert out.where("p > 1000 and abs(p - p_smoothed - 6) > 1e-6").count() == 0 and out.count() == 250_000


@pytest.mark.parametrize("alpha", [0.7, 0.05])
def test_smoothing_skips_unknown_rows(small_chunks, alpha):
    """Null and NaN rows come out null and change nothing, chunked or not."""
    values = [1000.0 + (7 * i) % 31 if i % 9 else (None if i % 2 else float("nan")) for i in range(300)]
    df = small_chunks.createDataFrame([("A", T0 + dt.timedelta(hours=i), 1000.0 + i, v) for i, v in enumerate(values)], "zone string, timestamp timestamp, load double, p double")
    known = [(1000.0 + i, v) for i, v in enumerate(values) if v is not None and v == v]
    mean, trend = [], []
    for a, v in known:
        mean.append(v if len(mean) < 3 else (v + sum(mean[-3:])) / 4)
        trend.append(v if not trend else alpha * v + (1 - alpha) * (trend[-1] + a - last))
        last = a
    for out, want in ((sm.recursive_smoothing(df, "p"), mean), (sm.trend_smoothing(df, "load", "p", alpha), trend)):
        got = col(out, "p_smoothed")
        assert len(got) == 300 and [x is None for x in got] == [v is None or v != v for v in values]
        assert [x for x in got if x is not None] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("alpha", [0.7, 0.95, 0.3, 0.05])
def test_trend_smoothing_equals_the_loop(small_chunks, alpha):
    rng = np.random.default_rng(2)
    a, p = rng.random(900) * 1000, rng.random(900) * 1000
    df = hours(small_chunks, 900, lambda i: a[i], p=lambda i: p[i])
    out = [p[0]]
    for i in range(1, len(p)):
        out.append(alpha * p[i] + (1 - alpha) * (out[-1] + a[i] - a[i - 1]))
    assert col(sm.trend_smoothing(df, "load", "p", alpha), "p_smoothed") == pytest.approx(out, rel=1e-9)


def test_smooth_twice_equals_the_loop(small_chunks):
    p = list(np.random.default_rng(4).random(300))

    def smooth(v, n):
        return [v[i] if i < n - 1 else float(np.mean(v[i - n + 1 : i + 1])) for i in range(len(v))]

    got = col(sm.smooth_twice(hours(small_chunks, 300, lambda i: p[i]), "load"), "load_smoothed")
    assert got == pytest.approx(smooth(smooth(p, 5), 3))


def test_uniform_smoothing_pads_with_the_edge(spark):
    p = [5.0, 1, 4, 2, 9, 7, 3, 8, 6, 2, 1, 4, 8, 9, 3, 2, 7, 5, 6, 1]
    v = np.pad(p, 2, mode="edge")
    want = [v[i : i + 5].mean() for i in range(len(p))]
    assert col(sm.uniform_smoothing(hours(spark, 20, lambda i: p[i]), "load"), "load_uniform") == pytest.approx(want)
    short = hours(spark, 8, lambda i: p[i])
    assert col(sm.uniform_smoothing(short, "load"), "load_uniform") == p[:8]


def test_splits_and_samples_repeat(small_chunks):
    df = hours(small_chunks, 500).withColumn("seq", (F.col("load") - 1000).cast("bigint"))
    keys = []
    for parts in (1, 7):
        d = df.repartition(parts).withColumn("sample_weight", 1.0 + F.col("seq") / 100)
        kept = wt.weighted_sample(d, F.col("seq"), "seq", 120)
        split = wt.shuffled_split(d, F.col("seq"), "seq")
        keys.append((sorted(r["seq"] for r in kept.collect()), sorted((r["seq"], r["split"]) for r in split.collect())))
    assert keys[0] == keys[1] and len(keys[0][0]) == 120
    sizes = pd.Series([s for _, s in keys[0][1]]).value_counts()
    assert sizes["test"] == 100 and sizes["val"] == 80
    heavy = np.mean(keys[0][0])
    assert heavy > 249  # heavier rows are drawn more often


def test_month_split_sizes(spark):
    df = hours(spark, 24 * 60).withColumn("seq", (F.col("load") - 1000).cast("bigint"))
    out = wt.month_split(df, F.col("seq"), "seq").groupBy(F.month("timestamp").alias("m")).agg(F.count_if(F.col("split") == "val").alias("v"), F.count("split").alias("n"))
    assert all(r["v"] == int(r["n"] * 0.15) for r in out.collect())


def test_required_columns_errors(spark):
    with pytest.raises(dq.DataValidationError, match="missing"):
        dq.require(hours(spark, 1), ["nope"])
    with pytest.raises(dq.DataValidationError, match="no rows"):
        dq.require(hours(spark, 1).limit(0), ["load"])
    with pytest.raises(dq.DataValidationError, match="nulls"):
        dq.require(hours(spark, 1).withColumn("load", F.lit(None)), ["load"], ["load"])


def test_critical_health_comes_first(spark):
    models = table(spark, [("A", at(0), 9.0), ("B", at(0), 3.0), ("C", at(0), 1.0), ("D", at(-20), 1.0)], "zone string, trained_at timestamp, mape double")
    zones = table(spark, [(z,) for z in "ABCDE"], "zone string")
    got = {r["zone"]: r["status"] for r in dq.model_health(models, F.lit(at(1)), zones).collect()}
    assert got == {"A": "critical", "B": "degraded", "C": "healthy", "D": "degraded", "E": "missing"}


def test_temperature_bins_are_right_closed(spark):
    df = hours(spark, 4, temp_c=lambda i: [0.0, 5.0, 5.1, 10.0][i])
    got = ag.temperature_response(df, 2).orderBy("temp_bin").collect()
    assert [(r["temp_bin"], round(r["mean_temp"], 6)) for r in got] == [(0, 2.5), (1, 7.55)]


def test_nan_becomes_null(spark):
    from gridweave.functions.expr import no_nan

    df = table(spark, [(float("nan"), "x"), (1.0, "y"), (None, "z")], "v double, s string")
    assert no_nan(df).where("v is null").count() == 2
