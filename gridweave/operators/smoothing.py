"""Smoothing and calibration of predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.core.series import Series, join_keys, over_series, series
from gridweave.functions.expr import clip
from gridweave.session import stored


def trailing_mean(s: Series, value: Column | str, n: int) -> Column:
    """Mean of the last n rows; the first n - 1 rows of a series keep their value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(s.pos >= n - 1, F.avg(v).over(s.rows(n - 1))).otherwise(v)


def smooth_twice(df: DataFrame, value: str, first: int = 5, second: int = 3, **layout) -> DataFrame:
    """A trailing mean of 5 rows and then of 3 rows, with warm-up rows passed through."""
    s = series(df, back=first + second - 2, **layout)
    out = s.df.withColumns({"series_at": s.pos}).withColumn(
        "smooth_1",
        F.when(F.col("series_at") >= first - 1, F.avg(value).over(s.rows(first - 1))).otherwise(F.col(value)),
    )
    out = out.withColumn(
        f"{value}_smoothed",
        F.when(F.col("series_at") >= second - 1, F.avg("smooth_1").over(s.rows(second - 1))).otherwise(F.col("smooth_1")),
    )
    return s.finish(out).drop("series_at", "smooth_1")


def constrain(df: DataFrame, actual: str, predicted: str, **layout) -> DataFrame:
    """Prediction inside mean ± 2σ of the last six actuals and ±5 %; the first five rows ±10 %."""

    def build(s: Series) -> dict[str, Column]:
        frame = s.rows(5)
        mean, std = F.avg(actual).over(frame), F.stddev_pop(actual).over(frame)
        a, p = F.col(actual), F.col(predicted)
        late = clip(p, F.greatest(mean - 2 * std, a - 0.05 * a), F.least(mean + 2 * std, a + 0.05 * a))
        early = clip(p, a - 0.10 * a, a + 0.10 * a)
        return {f"{predicted}_constrained": F.when(s.pos >= 5, late).otherwise(early)}

    return over_series(df, build, back=5, **layout)


def trend_smoothing(df: DataFrame, actual: str, predicted: str, alpha: float = 0.7, **layout) -> DataFrame:
    """s_i = a p_i + (1 - a)(s_{i-1} + actual step), for any a in (0, 1].

    s - actual is an exponential mean of (p - actual). Its weights fall by (1 - a) per
    row; rows whose weight is below 1e-17 cannot change a double, so with a large a a bounded frame
    gives the same value. Otherwise the recurrence runs over chunks. The first row of a series has weight (1 - a)^i. Rows where actual or
    prediction is null or NaN have a null output, and the others go on as if they were not there.
    """
    name = f"{predicted}_smoothed"
    return _with_unknown(df, _known(df, actual, predicted), name, lambda rows: _trend_smoothed(rows, actual, predicted, alpha, name, **layout))


def _trend_smoothed(df: DataFrame, actual: str, predicted: str, alpha: float, name: str, **layout) -> DataFrame:
    keep = 1 - alpha
    if keep <= 0:
        return df.withColumn(name, F.col(predicted).cast("double"))
    depth = math.ceil(math.log(1e-17) / math.log(keep))
    if depth > 64:
        return _recursive(df, Recurrence((keep,), 1, alpha), actual, predicted, name, **layout)
    df = df.withColumn("raw_gap", F.col(predicted) - F.col(actual))

    s = series(df, back=depth, **layout)
    out = s.df.withColumns(
        {"series_at": s.pos, **{f"gap_{j}": F.lag("raw_gap", j).over(s.w) for j in range(depth)}}
    )
    total = F.lit(0.0)
    for j in range(depth):
        weight = F.when(F.col("series_at") == j, F.lit(keep**j)).otherwise(F.lit(alpha * keep**j))
        total = total + F.coalesce(F.col(f"gap_{j}") * weight, F.lit(0.0))
    out = out.withColumn(name, F.col(actual) + total)
    return s.finish(out).drop("raw_gap", "series_at", *[f"gap_{j}" for j in range(depth)])


def recursive_smoothing(df: DataFrame, predicted: str, **layout) -> DataFrame:
    """out = (prediction + last three outputs) / 4; the first three rows pass through.

    Chunks run side by side from the outputs before them (see ``_recursive``), so the series need not run through one task.
    A null or NaN prediction has a null output, and the others go on as if it were not there.
    """
    name = f"{predicted}_smoothed"
    return _with_unknown(
        df, _known(df, predicted), name, lambda rows: _recursive(rows, Recurrence((0.25, 0.25, 0.25), 3, 0.25), predicted, predicted, name, **layout)
    )


def _known(df: DataFrame, *names: str) -> Column:
    """Rows where none of the columns is null or NaN."""
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return known


def _with_unknown(df: DataFrame, known: Column, name: str, smooth) -> DataFrame:
    """Smooth the known rows only; the others keep a null output and have no part in the recurrence."""
    left_out = df.where(~known).withColumn(name, F.lit(None).cast("double"))
    return smooth(df.where(known)).unionByName(left_out)


# Rows of a chunk that is taken whole by a Python worker.
ROWS_IN_PYTHON = 100_000


@dataclass(frozen=True)
class Recurrence:
    """y_i = inflow_i + sum of weights[k] * y_(i-1-k) from row ``given`` of a series on; the rows before it are given as they are."""

    weights: tuple[float, ...]
    given: int
    scale: float

    def outputs(self, x: np.ndarray, at: int, before: np.ndarray) -> np.ndarray:
        """Outputs of consecutive rows, the first of which is row ``at`` of its series; ``before`` has the outputs before, latest first."""
        given = min(max(self.given - at, 0), len(x))
        before = np.concatenate([x[:given][::-1], before])[: len(self.weights)]
        return np.concatenate([x[:given], linear_recurrence(self.scale * x[given:], self.weights, before)])

    def map_of(self, x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(A, c): the latest outputs after these rows are ``A @ before + c``."""
        order = len(self.weights)
        shift = np.eye(order, k=-1)
        step = shift.copy()
        step[0] = self.weights
        given = min(max(self.given - at, 0), len(x))
        matrix = np.linalg.matrix_power(step, len(x) - given) @ np.linalg.matrix_power(shift, given)
        own = self.outputs(x, at, np.zeros(order))
        return matrix, np.concatenate([own[-order:][::-1], np.zeros(order)])[:order]


def _recursive(df, recurrence: Recurrence, actual: str, predicted: str, name: str, **layout) -> DataFrame:
    """Run a linear recurrence over series of any length: each chunk is an affine map of the outputs before it.

    The maps of a series are composed in order, which gives every chunk the outputs before it; then all chunks run side by side.
    A chunk is a table in a Python worker, so it has fewer rows than those of windows.
    What recurs is prediction minus ``actual`` (nothing if they are the same column); ``actual`` is added back.
    """
    s = series(df, most=ROWS_IN_PYTHON, **layout)
    keep, order = list(s.columns), len(recurrence.weights)
    chunk = F.col("_chunk") if s.chunked else F.lit(0).cast("bigint")
    rows = s.df.withColumns({"run_at": s.pos, "run_chunk": chunk}).select(*keep, "run_at", "run_chunk")
    by = [*s.keys, "run_chunk"]
    same = actual == predicted

    def values(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        part = part.sort_values("run_at")
        p = part[predicted].to_numpy(float)
        a = np.zeros(len(p)) if same else part[actual].to_numpy(float)
        return part, a, p - a

    if s.chunked:
        fields = [T.StructField(f.name, f.dataType, True) for f in df.select(*s.keys).schema] + [T.StructField("run_chunk", T.LongType())]
        numbers = T.ArrayType(T.DoubleType())
        maps = T.StructType([*fields, T.StructField("matrix", numbers), T.StructField("offset", numbers)])

        def summary(part: pd.DataFrame) -> pd.DataFrame:
            part, _, x = values(part)
            matrix, offset = recurrence.map_of(x, int(part["run_at"].iloc[0]))
            return part[by][:1].assign(matrix=[matrix.ravel()], offset=[offset])

        def composed(part: pd.DataFrame) -> pd.DataFrame:
            part, state, starts = part.sort_values("run_chunk"), np.zeros(order), []
            for matrix, offset in zip(part["matrix"], part["offset"]):
                starts.append(state)
                state = np.reshape(matrix, (order, order)) @ state + np.asarray(offset)
            return part[by].assign(run_before=starts)

        columns = list(dict.fromkeys([*by, "run_at", actual, predicted]))
        found = stored(rows.select(*columns).groupBy(*by).applyInPandas(summary, maps))
        starts = stored(found.groupBy(*s.keys).applyInPandas(composed, T.StructType([*fields, T.StructField("run_before", numbers)])))
        rows = join_keys(rows, starts, by, "left")

    nullable = [T.StructField(f.name, f.dataType, True) for f in df.select(*keep).schema]
    schema = T.StructType([*nullable, T.StructField(name, T.DoubleType(), True)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, a, x = values(part)
        before = np.asarray(part["run_before"].iloc[0], float) if "run_before" in part else np.zeros(order)
        part[name] = a + recurrence.outputs(x, int(part["run_at"].iloc[0]), before)
        return part[[*keep, name]]

    return rows.groupBy(*by).applyInPandas(run, schema)


BLOCK = 256


def linear_recurrence(x: np.ndarray, weights: Sequence[float], before: Sequence[float]) -> np.ndarray:
    """y_i = x_i + sum of weights[k] * y_(i-1-k); ``before`` holds y_(-1), y_(-2) and so on.

    Blocks of rows at a time: what a block's own rows add is one product with their impulse responses, what came
    before it enters by its last outputs.
    """
    order = len(weights)
    unit = np.zeros((BLOCK + order, order + 1))  # columns: an impulse, and each of the outputs before
    unit[order - 1 :: -1, 1:][:order] = np.eye(order)
    unit[order, 0] = 1.0
    for i in range(order, BLOCK + order):
        unit[i] += sum(w * unit[i - 1 - k] for k, w in enumerate(weights))
    impulse, memory = unit[order:, 0], unit[order:, 1:]
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
    response = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    out, last = np.empty(len(x)), np.asarray(before, dtype=float)
    for at in range(0, len(x), BLOCK):
        own = x[at : at + BLOCK]
        n = len(own)
        out[at : at + n] = response[:n, :n] @ own + memory[:n] @ last
        last = np.concatenate([out[max(at + n - order, 0) : at + n][::-1], last])[:order]
    return out


def uniform_smoothing(df: DataFrame, value: str, size: int = 5, edge: str = "nearest", **layout) -> DataFrame:
    """Centred mean over min(size, n // 4) rows; beyond the ends the edge value (or zero) counts.

    Series with a window below three rows stay as they are. An even window reaches one
    row further back.
    """

    s = series(df, back=size // 2, ahead=size // 2, **layout)
    out = s.df.withColumns({"series_at": s.pos, "series_n": s.n})
    n, at, v = F.col("series_n"), F.col("series_at"), F.col(value)
    window = F.least(F.lit(size), F.floor(n / 4))
    result = v
    for k in range(3, size + 1):
        back, ahead = k // 2, k - 1 - k // 2
        frame = s.rows(back, ahead)
        total = F.sum(v).over(frame)
        if edge == "nearest":
            # Rows missing before the start repeat the first value, after the end the last one.
            total = total + F.first(v).over(frame) * F.greatest(F.lit(back) - at, F.lit(0))
            total = total + F.last(v).over(frame) * F.greatest(F.lit(ahead) - (n - 1 - at), F.lit(0))
        result = F.when(window == k, total / k).otherwise(result)
    out = out.withColumn(f"{value}_uniform", result)
    return s.finish(out).drop("series_at", "series_n")


def zero_padded_mean(df: DataFrame, value: str, size: int = 3, **layout) -> DataFrame:
    """Centred sum divided by the window size, so the ends count missing rows as zero."""
    half = size // 2
    return over_series(
        df, lambda s: {f"{value}_padded": F.sum(value).over(s.rows(half, half)) / size}, back=half, ahead=half, **layout
    )


def calibrate(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Undo a linear bias: fit predicted = a x actual + b per series and return (p - b) / a."""
    line = stored(
        df.groupBy(*keys).agg(
            F.regr_slope(predicted, actual).alias("cal_slope"), F.regr_intercept(predicted, actual).alias("cal_intercept")
        )
    )
    out = join_keys(df, line, list(keys), "left")
    fitted = F.try_divide(F.col(predicted) - F.col("cal_intercept"), F.col("cal_slope"))
    return out.withColumn(f"{predicted}_calibrated", fitted).drop("cal_slope", "cal_intercept")
