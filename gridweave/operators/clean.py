"""Row filters, mapping, deduplication and repair."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.core.quantiles import with_quantiles
from gridweave.core.scalars import beside
from gridweave.core.series import join_keys
from gridweave.functions.expr import clip
from gridweave.operators.windows import fill_zeros, last_rows, light_smoothing
from gridweave.session import stored


def recent(df: DataFrame, span: str, as_of: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows within ``span`` (an interval text) of ``as_of``, by default of the latest row."""
    if as_of is not None:
        return df.where(F.col(ts) >= as_of - F.expr(f"interval {span}"))
    latest = df.agg(F.max(ts).alias("latest")).scalar()
    return df.where(F.col(ts) >= latest - F.expr(f"interval {span}"))


def calendar_sample(
    df: DataFrame, years: Sequence[int], tail: int = 10080, order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """First half of January, April, July and October of the years plus the last rows, one row per time."""
    starts = [F.lit(f"{y}-{m:02d}-01").cast("timestamp") for y in years for m in (1, 4, 7, 10)]
    inside = reduce(
        lambda a, b: a | b, [F.col("timestamp").between(s, s + F.expr("interval 14 days")) for s in starts]
    )
    both = df.where(inside).unionByName(last_rows(df, tail, order=order))
    rest = [c for c in df.columns if c not in ("zone", "timestamp")]
    first = F.min_by(F.struct(*rest), F.struct(*order[1:] or rest)).alias("_r")
    return both.groupBy("zone", "timestamp").agg(first).select("zone", "timestamp", "_r.*").select(*df.columns)


def in_load_range(df: DataFrame, ranges: DataFrame, value: str = "load") -> DataFrame:
    """Rows inside the physical range of their zone; zones without a range pass."""
    joined = df.join(stored(ranges), "zone", "left")
    return joined.where(F.col("lo").isNull() | F.col(value).between(F.col("lo"), F.col("hi"))).select(*df.columns)


def proxy_zone(df: DataFrame, zone: str, source: str, lo: float, hi: float) -> DataFrame:
    """Rows of ``zone``; if it has none, ``source`` scaled so that its mean is the middle of the range."""
    facts = df.agg(
        F.count_if(F.col("zone") == zone).alias("_own"),
        F.avg(F.when(F.col("zone") == source, F.col("load"))).alias("_mean"),
    )
    rows = beside(df, facts)
    own = F.col("_own") > 0
    rows = rows.where(F.when(own, F.col("zone") == zone).otherwise(F.col("zone") == source))
    load = F.when(own, F.col("load")).otherwise(F.col("load") * ((lo + hi) / 2) / F.col("_mean"))
    rows = rows.withColumns({"load": load, "zone": F.lit(zone)})
    return rows.where((F.col("load") > 0) & F.col("load").between(0.8 * lo, 1.2 * hi)).select(*df.columns)


def valid_forecasts(df: DataFrame) -> DataFrame:
    """Drop temperatures outside -20..60; empty humidity outside 0..100 and wind outside 0..200."""
    cols = {c: F.when(F.col(c).between(0, top), F.col(c)) for c, top in (("humidity", 100), ("wind_speed_kmh", 200))}
    return df.where(F.col("temp_c").between(-20, 60)).withColumns({c: v for c, v in cols.items() if c in df.columns})


def to_utc(df: DataFrame, column: str, zone: str) -> DataFrame:
    """Local wall-clock time to UTC."""
    return df.withColumn(column, F.to_utc_timestamp(column, zone))


def select_features(df: DataFrame, requested: Sequence[str], target: str) -> DataFrame:
    """Requested columns the table has, rows with a target; an error if none is left."""
    have = [c for c in requested if c in df.columns]
    if not have:
        raise ValueError("none of the requested features is available")
    return df.where(F.col(target).isNotNull()).select(*have, target)


def numeric_features(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric columns but the excluded ones, rows without any null."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (*exclude, target)]
    return df.select(*cols, target).dropna()


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns in order; absent columns and nulls become 0."""
    cols = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in names
    ]
    return df.select(*keep, *cols)


def clip_predictions(df: DataFrame, ranges: DataFrame, value: str = "prediction", lo: float = 0.0, hi: float = 50000.0) -> DataFrame:
    """Prediction limited to the zone range, else to 0..50000."""
    joined = df.join(stored(ranges), "zone", "left")
    bounded = clip(F.col(value), F.coalesce("lo", F.lit(lo)), F.coalesce("hi", F.lit(hi)))
    return joined.withColumn(value, bounded).select(*df.columns)


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last arrival of each key; equal arrivals are told apart by their other columns, so reruns agree.

    Copies combine on the map side, so a hot key is no burden.
    """
    rest = [c for c in df.columns if c not in keys]
    unordered = (T.MapType, T.VariantType)
    tie = [c for c in rest if c not in order and not isinstance(df.schema[c].dataType, unordered)]
    best = F.max_by(F.struct(*rest), F.struct(*order, *tie)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Union by name; ``source_rank`` tells later sources from earlier ones."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def without_extremes(df: DataFrame, value: str = "load", factor: float = 3.0, zones: Sequence[str] | None = None) -> DataFrame:
    """Drop negatives everywhere, and values beyond the IQR fence in the listed zones."""
    df = df.where((F.col(value) >= 0) | F.col(value).isNull())
    df = with_quantiles(df, ["zone"], {"q_1": (value, 0.25), "q_3": (value, 0.75)})
    iqr = F.col("q_3") - F.col("q_1")
    inside = F.col(value).between(F.col("q_1") - factor * iqr, F.col("q_3") + factor * iqr) | F.col(value).isNull()
    if zones is not None:
        inside = inside | ~F.col("zone").isin(list(zones))
    return df.where(inside).drop("q_1", "q_3")


def without_outliers(df: DataFrame, value: str = "load", limit: float = 3.5, least: int = 10) -> DataFrame:
    """Drop rows with a modified z-score above the limit; not where MAD is 0 or rows are few."""
    df = with_quantiles(df, ["zone"], {"med": (value, 0.5)})
    df = df.withColumn("off_med", F.abs(F.col(value) - F.col("med")))
    df = with_quantiles(df, ["zone"], {"mad": ("off_med", 0.5)})
    sizes = stored(df.groupBy("zone").agg(F.count(F.lit(1)).alias("zone_rows")))
    df = join_keys(df, sizes, ["zone"], "left")
    tested = (F.col("zone_rows") > least) & (F.col("mad") > 0)
    far = tested & (0.6745 * F.col("off_med") / F.col("mad") > limit)
    return df.where(~F.coalesce(far, F.lit(False))).drop("med", "off_med", "mad", "zone_rows")


def winsorise(df: DataFrame, columns: Sequence[str], lo: float = 0.01, hi: float = 0.99, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Limit columns to their own p01-p99."""
    wanted = {}
    for c in columns:
        wanted |= {f"lo_{c}": (c, lo), f"hi_{c}": (c, hi)}
    out = with_quantiles(df, list(keys), wanted)
    return out.withColumns({c: clip(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in columns}).drop(*wanted)


def preprocess_zones(
    df: DataFrame,
    fenced: Sequence[str] = ("NP15", "SCE", "SMUD"),
    repaired: Sequence[str] = ("SCE",),
    smoothed: Sequence[str] = ("NP15", "SMUD"),
    order: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """Zone rules in turn: negatives and fence, zeros on the line, light smoothing."""
    df = without_extremes(df, zones=fenced)
    is_repaired, is_smoothed = F.col("zone").isin(list(repaired)), F.col("zone").isin(list(smoothed))
    parts = [
        fill_zeros(df.where(is_repaired), order=order),
        light_smoothing(df.where(is_smoothed), order=order),
        df.where(~is_repaired & ~is_smoothed),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
