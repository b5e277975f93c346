"""Boosting against a plain version that looks at every split, rows summed by jobs, early stopping, scoring, awkward rows."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.plans import boosting as bo

SCHEMA = "zone string, timestamp long, hour int, temp double, kind double, load double, w double, held boolean"
FEATURES = ["hour", "temp", "kind"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(2000):
        hour, temp, kind = i % 24, float(rng.integers(0, 40)), float(rng.integers(0, 24))
        load = 100 + 10 * math.sin(hour / 4) + 0.5 * max(temp - 20, 0) + 7 * (kind in (3, 7, 11, 20)) + float(rng.normal())
        out.append(("A", i, hour, None if i % 17 == 0 else temp, kind, load, 1.0 + i % 3, i >= 1600))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows, features, s, categories=(), edges=None):
    """Held-out and training predictions by a recursive search over all rows, column by column and border by border."""
    at = {"hour": 2, "temp": 3, "kind": 4}
    x = [[math.nan if r[at[c]] is None else float(r[at[c]]) for c in features] for r in rows]
    y, w, train = [r[5] for r in rows], [r[6] for r in rows], [not r[7] for r in rows]
    total = sum(b for b, t in zip(w, train) if t)
    base = sum(a * b for a, b, t in zip(y, w, train) if t) / total
    score = [base] * len(rows)

    def strength(g, h):
        t = math.copysign(max(abs(g) - s.alpha, 0), g)
        return t * t / (h + s.lam)

    def sums(own):
        return sum(w[i] * (score[i] - y[i]) for i in own), sum(w[i] for i in own), len(own)

    def search(own):
        best = None
        g, h, _ = sums(own)
        for c, name in enumerate(features):
            if name in categories:
                groups = {}
                for i in own:
                    groups.setdefault(x[i][c], []).append(i)
                missing = [i for k, v in groups.items() if math.isnan(k) for i in v]
                order = sorted((k for k in groups if not math.isnan(k)), key=lambda k: (sums(groups[k])[0] / (sums(groups[k])[1] + bo.CATEGORY_SMOOTHING), k))
                tests = [set(order[: n + 1]) for n in range(len(order))]
                goes = [lambda v, t=t: v in t for t in tests]
            else:
                missing = [i for i in own if math.isnan(x[i][c])]
                goes = [lambda v, b=b: v <= b for b in [*edges[name], math.inf]]
            for test in goes:
                for missing_left in (False, True):
                    side = lambda i: missing_left if math.isnan(x[i][c]) else test(x[i][c])  # noqa: B023, E731
                    left = [i for i in own if side(i)]
                    right = [i for i in own if not side(i)]
                    if min(len(left), len(right)) < max(s.least_rows, 1) or min(sums(left)[1], sums(right)[1]) < s.least_weight:
                        continue
                    gain = 0.5 * (strength(*sums(left)[:2]) + strength(*sums(right)[:2]) - strength(g, h)) - s.gamma
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, c, test, missing_left)
            del missing
        return best

    for _ in range(s.trees):
        whole = list(range(len(rows)))
        leaves = [(whole, 0, search([i for i in whole if train[i]]))]
        while True:
            ready = [k for k, (_, d, b) in enumerate(leaves) if b and (not s.depth or d < s.depth)]
            if not ready or (s.leaves and len(leaves) >= s.leaves):
                break
            k = max(ready, key=lambda k: leaves[k][2][0]) if s.leaves else ready[0]
            own, d, (_, c, test, missing_left) = leaves.pop(k)
            side = [missing_left if math.isnan(x[i][c]) else test(x[i][c]) for i in own]
            for want in (True, False):
                part = [i for i, q in zip(own, side) if q == want]
                leaves.append((part, d + 1, search([i for i in part if train[i]])))
        new = list(score)
        for own, _, _ in leaves:
            g, h, _ = sums([i for i in own if train[i]])
            for i in own:
                new[i] += -s.rate * math.copysign(max(abs(g) - s.alpha, 0), g) / (h + s.lam)
        score = new
    return score


def scores(df, models):
    return [r["m"] for r in bo.score_boosted(df, models).orderBy("timestamp").collect()]


@pytest.mark.parametrize(
    "settings, categories",
    [
        (bo.Boost(3, 0.3, 3, alpha=5.0, lam=2.0, gamma=1.0, least_weight=20), ()),
        (bo.Boost(2, 0.3, 0, leaves=7, lam=0.0, least_rows=20, least_weight=1e-3), ("kind",)),
    ],
)
def test_equals_a_plain_search(spark, rows, table, settings, categories):
    settings = replace(settings, categories=categories)
    models = bo.fit_boosted(table, {"m": (FEATURES, settings)}, weight="w", holdout="held", bins=16)
    edges = {c.name: e for c, e in bo.bin_edges(table, [bo.Feature(c, c in categories) for c in FEATURES], 16)["A"].items()}
    want = plain(rows, FEATURES, settings, categories, edges)
    assert scores(table, models) == pytest.approx(want, rel=1e-9)
    held = [(a, r[5]) for a, r in zip(want, rows) if r[7]]
    row = models.first()
    assert row["held_n"] == 400 and row["held_mae"] == pytest.approx(sum(abs(a - b) for a, b in held) / 400)
    assert row["held_mape"] == pytest.approx(sum(abs(a - b) / b for a, b in held) / 4)


@pytest.mark.parametrize("profile", ["conservative", "leaf_wise"])
def test_jobs_give_the_models_of_single_tasks(spark, table, profile):
    two = {"m": (FEATURES, replace(bo.PROFILES[profile], trees=20, categories=("kind",))), "n": (FEATURES[:2], bo.Boost(18, 0.2, 2, row_share=0.5, patience=5))}
    options = dict(weight="w", holdout="held")
    small = bo.fit_boosted(table, two, **options)
    spark.conf.set("gridweave.rowsPerChunk", "500")
    try:
        large = bo.fit_boosted(table, two, **options)
    finally:
        spark.conf.unset("gridweave.rowsPerChunk")
    one = {r["model"]: r.asDict() for r in small.collect()}
    for r in large.collect():
        assert r["feature"] == one[r["model"]]["feature"] and r["trees"] == one[r["model"]]["trees"]
        assert r["value"] == pytest.approx(one[r["model"]]["value"], rel=1e-6, abs=1e-9)
    assert scores(table, large.where("model = 'm'")) == pytest.approx(scores(table, small.where("model = 'm'")), rel=1e-9)


def test_early_stopping_keeps_the_best_number(spark, table):
    row = bo.fit_boosted(table, {"m": (FEATURES, bo.Boost(400, 0.5, 6, patience=10))}, weight="w", holdout="held").first()
    assert row["trees"] < row["grown"] == row["trees"] + 10
    best = bo.fit_boosted(table, {"m": (FEATURES, bo.Boost(row["trees"], 0.5, 6))}, weight="w", holdout="held").first()
    assert best["held_mae"] == pytest.approx(row["held_mae"])


def test_folds_train_on_the_past_only(spark, table):
    df = table.withColumn("fold", F.floor(F.col("timestamp") / 500).cast("int"))
    got = {r["fold"]: r for r in bo.fit_boosted(df, {"m": (FEATURES, bo.Boost(5, 0.3, 3))}, weight="w", folds=[1, 2, 3]).collect()}
    assert sorted(got) == [1, 2, 3] and all(r["held_n"] == 500 for r in got.values())
    past = df.withColumn("held", F.col("fold") == 2).where("fold <= 2")
    # The borders come from all rows, so only a column with few values is the same in both.
    one = bo.fit_boosted(df, {"m": (["hour"], bo.Boost(5, 0.3, 3))}, weight="w", folds=[2]).first()
    two = bo.fit_boosted(past, {"m": (["hour"], bo.Boost(5, 0.3, 3))}, weight="w", holdout="held").first()
    assert one["held_mae"] == pytest.approx(two["held_mae"]) and one["value"] == pytest.approx(two["value"])


def test_many_zones_in_one_pass_and_without_a_model(spark, table):
    zones = F.explode(F.array(*[F.lit(f"z{i}") for i in range(7)], F.lit(None).cast("string")))
    df = table.where("timestamp < 200").drop("zone").withColumn("zone", zones).withColumn("load", F.col("load") + F.length("zone"))
    models = bo.fit_boosted(df.where("zone != 'z6'"), {"a": (FEATURES, bo.Boost(3)), "b": (FEATURES[:1], bo.Boost(2))})
    assert models.count() == 12
    sent = bo.score_boosted(df, models)
    assert sent.columns == [*df.columns, "a", "b"] and sent.where("a is null").count() == 400 and sent.where("a is not null and b is not null").count() == 1200
    scans = sent._jdf.queryExecution().executedPlan().toString().count("Scan")
    assert scans == 1
    limit, bo.SENT_NODES = bo.SENT_NODES, 1
    try:
        joined = bo.score_boosted(df, models)
    finally:
        bo.SENT_NODES = limit
    key = lambda r: (r["zone"] or "", r["timestamp"], r["a"], r["b"])
    assert sorted(map(str, map(key, sent.collect()))) == sorted(map(str, map(key, joined.collect())))
    total = {(r["zone"], r["model"]): r["s"] for r in bo.tree_importances(models).groupBy("zone", "model").agg(F.sum("importance").alias("s")).collect()}
    assert len(total) == 12 and all(v == pytest.approx(1) for v in total.values())


def test_awkward_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    models = bo.fit_boosted(empty, {"m": (FEATURES, bo.Boost(3))})
    assert models.count() == 0 and bo.score_boosted(empty, models).columns == empty.columns
    rows = [("A", 1, None, None, None, 5.0, 1.0, None), ("A", 1, 1, float("nan"), 2.0, 5.0, 1.0, False), (None, 1, 1, 1.0, 1.0, 1.0, 1.0, False), ("A", 2, 1, 1.0, 1.0, None, 1.0, False), ("B", 1, 1, 1.0, 1.0, 3.0, None, False)]
    df = spark.createDataFrame(rows, SCHEMA)
    models = bo.fit_boosted(df, {"m": (FEATURES, bo.Boost(3, patience=2))}, weight="w", holdout="held")
    assert [(r["zone"], r["base"], r["held_n"]) for r in models.collect()] == [("A", 5.0, 0)]
    assert [r["m"] for r in bo.score_boosted(df, models).collect()] == [5.0, 5.0, None, 5.0, None]
    with pytest.raises(ValueError):
        bo.score_boosted(df.withColumnRenamed("w", "m"), models)
