"""Checked queries of boosting: models of trees with one split, which SQL can grow as well."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from gridweave.functions import calendar as cal
from gridweave.operators import metrics as mt
from gridweave.operators import windows as wn
from gridweave.operators.joins import latest_per_key
from gridweave.plans import boosting as bo
from gridweave.plans import forecast as fc
from gridweave.plans import scoring as sc
from gridweave.plans import training as tr
from gridweave.session import stored
from workload.harness import query

#: Enough bins that each hour and day has its own.
BINS = 250
STEP = bo.Boost(trees=4, rate=0.5, depth=1, alpha=20.0, lam=3.0, least_weight=0.0)
BY_LEAF = replace(STEP, trees=3, depth=0, leaves=2, categories=("hour",))

LOAD = """SELECT zone, "timestamp", true AS tr, load AS y, CAST(isodow("timestamp") - 1 AS DOUBLE) AS day_of_week,
    CAST(extract(hour FROM "timestamp") AS DOUBLE) AS hour FROM load_hourly"""


def grown(rows: str, features: Sequence[str], s: bo.Boost, keys: Sequence[str] = ("zone",), numbers: tuple = (), at: str = "") -> str:
    """CTEs that boost one-split trees over ``rows`` (keys, tr, y, features); ``{at}s`` has the score of each row, training or not, and
    ``{at}gains`` the gain of each split. ``numbers`` replaces rate, alpha and lam by columns among the keys."""
    rate, alpha, lam = numbers or (s.rate, s.alpha, s.lam)
    k, p = ", ".join(keys), at
    shrunk = lambda g: f"sign({g}) * greatest(abs({g}) - {alpha}, 0)"
    strength = lambda g, h: f"({shrunk(g)}) * ({shrunk(g)}) / ({h} + {lam})"
    weight = lambda g, h: f"-{rate} * ({shrunk(g)}) / ({h} + {lam})"
    out = [f"{p}s0 AS (SELECT *, avg(CASE WHEN tr THEN y END) OVER (PARTITION BY {k}) AS score FROM ({rows}))"]
    for r in range(1, s.trees + 1):
        ranks = {c: "sum(score - y) / (count(*) + 10)" if c in s.categories else f"CAST({c} AS DOUBLE)" for c in features}
        sums = " UNION ALL ".join(
            f"SELECT {k}, {i} AS fi, {c} AS fv, {ranks[c]} AS rank, sum(score - y) AS g, count(*) AS h FROM {p}s{r - 1} WHERE tr GROUP BY {k}, {c}" for i, c in enumerate(features)
        )
        run = f"(PARTITION BY {k}, fi ORDER BY rank, fv ROWS UNBOUNDED PRECEDING)"
        out.append(
            f"{p}c{r} AS (SELECT *, row_number() OVER {run} AS pos, sum(g) OVER {run} AS gl, sum(h) OVER {run} AS hl,"
            f" sum(g) OVER (PARTITION BY {k}, fi) AS gt, sum(h) OVER (PARTITION BY {k}, fi) AS ht FROM ({sums}))"
        )
        gain = f"0.5 * ({strength('gl', 'hl')} + {strength('gt - gl', 'ht - hl')} - {strength('gt', 'ht')})"
        out.append(
            f"{p}b{r} AS (SELECT {k}, fi, fv AS bv, pos AS bpos, {gain} AS gain, {weight('gl', 'hl')} AS wl, {weight('gt - gl', 'ht - hl')} AS wr FROM {p}c{r}"
            f" WHERE hl < ht AND {gain} > 1e-12 QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY gain DESC, fi, pos) = 1)"
        )
        goes = " ".join(
            f"WHEN {i} THEN " + (f"coalesce((SELECT max(c.pos) FROM {p}c{r} c WHERE {' AND '.join(f'c.{x} = s.{x}' for x in keys)} AND c.fi = {i} AND c.fv = s.{c}) <= b.bpos, false)" if c in s.categories else f"s.{c} <= b.bv")
            for i, c in enumerate(features)
        )
        on = " AND ".join(f"b.{x} = s.{x}" for x in keys)
        out.append(
            f"{p}s{r} AS (SELECT s.* REPLACE (s.score + coalesce(CASE WHEN CASE b.fi {goes} END THEN b.wl ELSE b.wr END, 0) AS score)"
            f" FROM {p}s{r - 1} s LEFT JOIN {p}b{r} b ON {on})"
        )
    out.append(f"{p}s AS (SELECT * FROM {p}s{s.trees})")
    out.append(f"{p}gains AS ({' UNION ALL '.join(f'SELECT {k}, fi, gain FROM {p}b{r}' for r in range(1, s.trees + 1))})")
    return ",\n".join(out)


def calendar_rows(v):
    return cal.calendar_parts(v.load_hourly)


@query(
    "ml05_boosting_steps",
    f"""WITH {grown(LOAD, ["day_of_week", "hour"], STEP)} SELECT zone, "timestamp", score AS prediction FROM s""",
    dbl="prediction",
)
def _(v):
    df = calendar_rows(v)
    models = bo.fit_boosted(df, {"m": (["day_of_week", "hour"], STEP)}, bins=BINS)
    return tr.score_zones(df, models).select("zone", "timestamp", "prediction")


@query(
    "ml06_category_steps",
    f"""WITH {grown(LOAD, ["hour", "day_of_week"], BY_LEAF)} SELECT zone, "timestamp", score AS prediction FROM s""",
    dbl="prediction",
)
def _(v):
    df = calendar_rows(v)
    models = bo.fit_boosted(df, {"m": (["hour", "day_of_week"], BY_LEAF)}, bins=BINS)
    return tr.score_zones(df, models).select("zone", "timestamp", "prediction")


SETTINGS = [replace(STEP, trees=2, rate=r, alpha=float(a), lam=b) for r in (0.1, 0.3, 0.5) for a in (0, 5, 20) for b in (0.5, 2.0)]
GRID = ", ".join(f"({i}, {s.rate}, {s.alpha}, {s.lam})" for i, s in enumerate(SETTINGS))
FOLDED = f"""SELECT l.*, g.*, k FROM (SELECT * REPLACE (true AS tr), floor((row_number() OVER (PARTITION BY zone ORDER BY "timestamp") - 1) * 6 / count(*) OVER (PARTITION BY zone)) AS fold
        FROM ({LOAD})) l, (VALUES {GRID}) g(setting, rate, alpha, lam), (VALUES (1), (2), (3), (4), (5)) f(k) WHERE fold <= k"""
TESTED = f"SELECT * REPLACE (fold < k AS tr) FROM ({FOLDED})"


@query(
    "ml08_search_steps",
    f"""WITH {grown(TESTED, ["day_of_week", "hour"], SETTINGS[0], ("zone", "setting", "k", "rate", "alpha", "lam"), ("rate", "alpha", "lam"))},
        f AS (SELECT zone, setting, k, avg(abs(y - score) / abs(y)) * 100 AS mape FROM s WHERE NOT tr GROUP BY 1, 2, 3)
        SELECT zone, setting, avg(mape) AS mean_mape, count(*) AS folds FROM f GROUP BY 1, 2""",
    dbl="mean_mape",
    lng="folds setting",
)
def _(v):
    df = calendar_rows(v)
    return tr.search(df, ["day_of_week", "hour"], SETTINGS, folds=5).select("zone", "setting", "mean_mape", "folds")


PARTS = {"baseline": (["day_of_week"], STEP), "enhanced": (["hour"], BY_LEAF), "third": (["day_of_week", "hour"], replace(STEP, trees=2))}
AHEAD = f"""{LOAD} UNION ALL SELECT zone, t, false, NULL, isodow(t) - 1, extract(hour FROM t) FROM
        (SELECT zone, max("timestamp") + to_hours(h) AS t FROM load_hourly, (VALUES (1), (6), (12), (24), (48)) hs(h) GROUP BY zone, h)"""


@query(
    "ml12_steps_forecast",
    f"""WITH {", ".join(grown(AHEAD, names, s, at=m) for m, (names, s) in PARTS.items())},
        p AS (SELECT zone, "timestamp", b.score AS baseline, e.score AS enhanced, t.score AS third
            FROM baselines b JOIN enhanceds e USING (zone, "timestamp", tr) JOIN thirds t USING (zone, "timestamp", tr) WHERE NOT tr)
        SELECT *, 0.25 * baseline + 0.35 * enhanced + 0.40 * third AS prediction, (enhanced - baseline) / baseline * 100 AS improvement_pct,
            0.9 * (0.25 * baseline + 0.35 * enhanced + 0.40 * third) AS lo95 FROM p""",
    dbl="baseline enhanced third prediction improvement_pct lo95",
)
def _(v):
    models = bo.fit_boosted(calendar_rows(v), PARTS, bins=BINS)
    rows = sc.horizon_features(v.load_hourly, v.weather_hourly, (1, 6, 12, 24, 48))
    out = sc.direct_forecast(rows, models, weights=fc.ENSEMBLES["service"])
    lo = F.col("intervals")[F.lit(0.95)]["lo"].alias("lo95")
    return out.select("zone", "timestamp", "baseline", "enhanced", "third", "prediction", "improvement_pct", lo)


MOVED = f"""{LOAD} UNION ALL SELECT DISTINCT zone, NULL, false, NULL, d, h FROM load_hourly, (VALUES (0), (5)) ds(d), (VALUES (2), (6), (10), (14), (18), (22)) hs(h)"""


@query(
    "ml13_steps_sensitivity",
    f"""WITH {grown(MOVED, ["hour", "day_of_week"], replace(STEP, trees=6))}
        SELECT zone, count(*) AS n_points, (max(score) - min(score)) / avg(score) * 100 AS variation_pct FROM s WHERE NOT tr GROUP BY 1""",
    dbl="variation_pct",
    lng="n_points",
)
def _(v):
    df = calendar_rows(v)
    models = bo.fit_boosted(df, {"m": (["hour", "day_of_week"], replace(STEP, trees=6))}, bins=BINS)
    return tr.temporal_sensitivity(latest_per_key(df, ["zone"], ["timestamp"]), models, ["hour", "day_of_week"])


@query(
    "ml19_importance_steps",
    f"""WITH {grown(LOAD, ["day_of_week", "hour"], replace(STEP, trees=6))},
        f AS (SELECT zone, i, name FROM (SELECT DISTINCT zone FROM load_hourly), (VALUES (0, 'day_of_week'), (1, 'hour')) x(i, name))
        SELECT f.zone AS model, name AS feature, coalesce(sum(gain), 0) / sum(sum(gain)) OVER (PARTITION BY f.zone) AS importance
        FROM f LEFT JOIN gains g ON g.zone = f.zone AND g.fi = f.i GROUP BY 1, 2""",
    dbl="importance",
)
def _(v):
    models = bo.fit_boosted(calendar_rows(v), {"m": (["day_of_week", "hour"], replace(STEP, trees=6))}, bins=BINS)
    return tr.importances(v.spark, models)


SPLIT = f"""SELECT * REPLACE (nth < floor(n * 0.8) AS tr) FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY "timestamp") - 1 AS nth, count(*) OVER (PARTITION BY zone) AS n FROM ({LOAD}))"""


@query(
    "pip09_evaluation_steps",
    f"""WITH {", ".join(grown(SPLIT, names, s, at=m) for m, (names, s) in PARTS.items())},
        p AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, y, score FROM {m}s WHERE NOT tr" for m in PARTS)})
        SELECT model, avg(abs(y - score)) AS mae, sqrt(avg((y - score) * (y - score))) AS rmse, avg(abs(y - score) / greatest(abs(y), 1e-6)) * 100 AS mape,
            max(abs(y - score)) AS max_error, avg(score - y) AS bias, 1 - sum((y - score) * (y - score)) / (var_pop(y) * count(*)) AS r2,
            quantile_cont(abs(y - score), 0.5) AS median_ae FROM p GROUP BY 1""",
    dbl="mae rmse mape max_error bias r2 median_ae",
)
def _(v):
    df = wn.split_by_position(calendar_rows(v), [("train", 0.8), ("val", 1.0)])
    df = stored(df.withColumn("held", F.col("split") == "val"))
    models = bo.fit_boosted(df, PARTS, holdout="held", bins=BINS)
    return sc.evaluate(df.where("held"), models).select("model", "mae", "rmse", "mape", "max_error", "bias", "r2", "median_ae")
