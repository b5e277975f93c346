"""Training: scaling, forests and linear models with MLlib, fits for each zone, search, importances. Boosting is in boosting.py."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler, VectorIndexer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.core.quantiles import with_quantiles
from gridweave.core.series import with_position
from gridweave.functions import calendar as cal
from gridweave.plans.boosting import SEARCH_SPACE, Boost, fit_boosted, score_boosted, tree_importances

CALENDAR = ["hour", "day_of_week", "month", "is_weekend"]
CYCLIC = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]
LAGS = ["load_lag_1h", "load_lag_24h"]


@dataclass(frozen=True)
class Profile:
    """Settings of a boosted learner."""

    trees: int = 20
    depth: int = 4
    rate: float = 0.1
    subsample: float = 1.0
    columns: str = "all"
    scaler: str | None = "robust"
    lag_weight: float = 1.0
    categorical: bool = False
    bins: int = 32


# Performance profiles (trees, depth, learning rate, row share, column share, lag weight).
PROFILES = {
    "conservative": Profile(1000, 5, 0.05, 0.8, "0.8", lag_weight=0.5),
    "balanced": Profile(1500, 5, 0.04, 0.8, "0.8", lag_weight=0.3),
    "aggressive": Profile(2500, 4, 0.03, 0.7, "0.7", lag_weight=0.05),
    "ultra_temporal": Profile(5000, 3, 0.01, 0.6, "0.6", lag_weight=0.01),
    "extreme_temporal": Profile(8000, 2, 0.005, 0.5, "0.5", lag_weight=0.001),
}


def weigh_lags(df: DataFrame, features: Sequence[str], weight: float) -> DataFrame:
    """Lag columns times the weight, so that trees and scalers see them smaller."""
    if weight >= 1:
        return df
    return df.withColumns({c: F.col(c) * weight for c in features if "lag" in c})


def scaling_stages(features: Sequence[str], scaler: str | None) -> tuple[list[Estimator], str]:
    """Assembler and scaler stages, and the name of their output."""
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="skip")]
    if scaler == "robust":
        stages.append(RobustScaler(inputCol="raw_features", outputCol="features", withCentering=True))
    elif scaler == "standard":
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    else:
        return stages, "raw_features"
    return stages, "features"


def boosted(features: Sequence[str], profile: Profile, target: str = "load", weight: str | None = None, holdout: str | None = None, seed: int = 42) -> Pipeline:
    """Scaling and gradient boosting; ``holdout`` marks rows that stop the boosting early."""
    stages, column = scaling_stages(features, None if profile.categorical else profile.scaler)
    if profile.categorical:
        # Calendar columns with few values are treated as categories.
        stages.append(VectorIndexer(inputCol=column, outputCol="indexed", maxCategories=profile.bins, handleInvalid="keep"))
        column = "indexed"
    gbt = GBTRegressor(
        featuresCol=column, labelCol=target, maxIter=profile.trees, maxDepth=profile.depth, stepSize=profile.rate,
        subsamplingRate=profile.subsample, featureSubsetStrategy=profile.columns, maxBins=max(profile.bins, 40), seed=seed,
    )
    if weight:
        gbt = gbt.setWeightCol(weight)
    if holdout:
        gbt = gbt.setValidationIndicatorCol(holdout)
    return Pipeline(stages=[*stages, gbt])


def forest(features: Sequence[str], trees: int = 100, depth: int = 15, least: int = 2, target: str = "load", seed: int = 42) -> Pipeline:
    stages, column = scaling_stages(features, None)
    learner = RandomForestRegressor(
        featuresCol=column, labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed
    )
    return Pipeline(stages=[*stages, learner])


def robust_scaled(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("zone",)) -> DataFrame:
    """{column}_scaled: distance from the exact median in interquartile ranges; null where the range is zero."""
    wanted = {f"_{c}_{q}": (c, q / 100) for c in columns for q in (25, 50, 75)}
    out = with_quantiles(df, list(keys), wanted)
    scaled = {}
    for c in columns:
        width = F.col(f"_{c}_75") - F.col(f"_{c}_25")
        scaled[f"{c}_scaled"] = F.when(width > 0, (F.col(c) - F.col(f"_{c}_50")) / width)
    return out.withColumns(scaled).drop(*wanted)


def linear(features: Sequence[str], target: str = "load", weight: str | None = None) -> Pipeline:
    stages, column = scaling_stages(features, "standard")
    learner = LinearRegression(featuresCol=column, labelCol=target)
    return Pipeline(stages=[*stages, learner.setWeightCol(weight) if weight else learner])


def in_threads(spark: SparkSession, jobs: Sequence[Callable], threads: int = 4) -> list:
    """Submit Spark jobs side by side from the driver; the work itself runs on the executors."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


def zones_of(df: DataFrame, least_rows: int = 1) -> list[str]:
    """Zones with enough rows; one short name each, bounded by the zone catalogue."""
    counts = df.where("zone is not null").groupBy("zone").count().where(F.col("count") >= least_rows)
    return sorted(r[0] for r in counts.select("zone").collect())


def fit_zones(df: DataFrame, make: Callable[[str], Pipeline], zones: Sequence[str], threads: int = 4) -> dict[str, PipelineModel]:
    """One model per zone. Each fit is a distributed job over the zone's rows."""
    jobs = [lambda z=z: make(z).fit(df.where(F.col("zone") == z)) for z in zones]
    return dict(zip(zones, in_threads(df.sparkSession, jobs, threads)))


def score_zones(df: DataFrame, models: dict[str, PipelineModel] | DataFrame, name: str = "prediction") -> DataFrame:
    """Rows of each zone scored by its own model; rows of a zone without one, or of none, keep a null prediction.

    A table of models has one model for each zone here.
    """
    if isinstance(models, DataFrame):
        return score_boosted(df, models.withColumn("model", F.lit(name)))
    return score_zones_by(df, {name: models})


def score_zones_by(df: DataFrame, models: dict[str, dict[str, PipelineModel]] | DataFrame) -> DataFrame:
    """Rows scored by several models of their zone at once: a table of boosted models, in one pass, or {column: {zone: model}}.

    With the latter a zone is one branch for all its models, so the number of scans is that of the zones.
    """
    if isinstance(models, DataFrame):
        return score_boosted(df, models)
    zones = sorted({z for per_zone in models.values() for z in per_zone})
    known = F.coalesce(F.col("zone").isin(zones), F.lit(False))
    nothing = F.lit(None).cast("double")
    parts = [df.where(~known).withColumns({name: nothing for name in models})]
    for zone in zones:
        own, kept = df.where(F.col("zone") == zone), list(df.columns)
        for name, per_zone in models.items():
            if zone in per_zone:
                own = per_zone[zone].transform(own).withColumnRenamed("prediction", name)
            else:
                own = own.withColumn(name, nothing)
            kept.append(name)
            own = own.select(*kept)
        parts.append(own)
    return reduce(lambda a, b: a.unionByName(b), parts)


def time_folds(df: DataFrame, folds: int, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Block number 0..folds of each row by position; fold k trains on blocks < k and tests on block k."""
    df = with_position(df, "fold_pos", "fold_n", order=order)
    return df.withColumn("fold", F.floor(F.col("fold_pos") * (folds + 1) / F.col("fold_n")).cast("int")).drop("fold_pos", "fold_n")


def random_settings(n: int, space: dict[str, Sequence] = SEARCH_SPACE, base: Boost = Boost(), seed: int = 42) -> list[Boost]:
    """n distinct settings drawn from the space."""
    sizes = [len(v) for v in space.values()]
    drawn = random.Random(seed).sample(range(math.prod(sizes)), min(n, math.prod(sizes)))
    out = []
    for number in drawn:
        values = {}
        for name, choices in space.items():
            number, at = divmod(number, len(choices))
            values[name] = choices[at]
        out.append(replace(base, **values))
    return out


def search(df: DataFrame, features: Sequence[str], settings: Sequence[Boost], folds: int = 5, target: str = "load", weight: str | None = None) -> DataFrame:
    """Mean MAPE of each setting over expanding time folds, for each zone and best first.

    All settings and folds are trained together, so the rows are read as often as for one of them.
    """
    models = {f"{i:05d}": (features, s) for i, s in enumerate(settings)}
    fitted = fit_boosted(time_folds(df, folds), models, target, weight, folds=range(1, folds + 1))
    named = df.sparkSession.createDataFrame(
        [(f"{i:05d}", i, s.trees, s.depth, float(s.rate), float(s.row_share), float(s.column_share), float(s.alpha), float(s.lam)) for i, s in enumerate(settings)],
        "model string, setting int, trees int, depth int, rate double, row_share double, column_share double, alpha double, lam double",
    )
    best = fitted.where("held_n > 0").groupBy("zone", "model").agg(F.avg("held_mape").alias("mean_mape"), F.count("fold").alias("folds"))
    return best.join(named, "model").drop("model").orderBy("zone", "mean_mape", "setting")


def importances(spark: SparkSession, models: dict[str, PipelineModel] | DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """Importance (trees) or |coefficient| (linear) of each feature of each model; a table of models is named by its zones."""
    if isinstance(models, DataFrame):
        return tree_importances(models).select(F.col("zone").alias("model"), "feature", "importance")
    rows = []
    for name, model in models.items():
        last = model.stages[-1]
        values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
        rows += [(name, f, abs(float(x))) for f, x in zip(features, values.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


# Name patterns of the balance test.
LAG_PATTERN = "(?i)lag"
TEMPORAL_PATTERN = "(?i)hour|day|month|peak|weekend|business"


def importance_balance(table: DataFrame, max_lag: float = 60.0, least_temporal: float = 35.0) -> DataFrame:
    """Share of lag, temporal and weather features per model, and the balance gate.

    A model in which no feature has importance (boosting that kept no tree) has null shares and is not balanced.
    """
    total = F.sum("importance")
    share = lambda p: F.try_divide(F.sum(F.when(F.col("feature").rlike(p), F.col("importance")).otherwise(0.0)), total) * 100
    out = table.groupBy("model").agg(
        share(LAG_PATTERN).alias("lag_share"),
        share(TEMPORAL_PATTERN).alias("temporal_share"),
        share("temp|humidity|wind|degree").alias("weather_share"),
    )
    ok = (F.col("lag_share") <= max_lag) & (F.col("temporal_share") >= least_temporal)
    return out.withColumn("balanced", F.coalesce(ok, F.lit(False)).cast("int"))


def top_features(table: DataFrame, k: int = 10) -> DataFrame:
    """The k most important features of each model."""
    ranked = with_position(table.withColumn("minus", -F.col("importance")), "rank", None, keys=("model",), order=("minus", "feature"))
    return ranked.where(F.col("rank") < k).drop("minus")


def compare_importances(table: DataFrame, first: str, second: str) -> DataFrame:
    """Two models side by side."""
    wide = table.groupBy("feature").pivot("model", [first, second]).agg(F.first("importance"))
    return wide.withColumn("change", F.col(second) - F.col(first))


def temporal_sensitivity(base: DataFrame, models: dict[str, PipelineModel] | DataFrame, features: Sequence[str], hours: Sequence[int] = (2, 6, 10, 14, 18, 22), weekend: bool = True) -> DataFrame:
    """Prediction for a base row per zone with the hour (and weekend) replaced; variation in percent."""
    days = [0, 5] if weekend else [0]
    grid = F.explode(F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(d).alias("day_of_week")) for h in hours for d in days]))
    rows = base.drop("hour", "day_of_week", "is_weekend").withColumn("g", grid).select("*", "g.*").drop("g")
    rows = rows.withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
    rows = cal.extreme_temporal_features(cal.cyclic_parts(rows))
    scored = score_zones(rows, models)
    span = F.max("prediction") - F.min("prediction")
    return scored.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_points"), (span / F.avg("prediction") * 100).alias("variation_pct")
    )
