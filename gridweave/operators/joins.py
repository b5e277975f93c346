"""Equi joins, as-of and nearest joins, horizon expansion and composite zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.core.series import Series, join_keys, series, with_position
from gridweave.operators.clean import deduplicate
from gridweave.session import stored


def suffixed(df: DataFrame, other: DataFrame, on: Sequence[str], suffix: str) -> DataFrame:
    """Rename the non-key columns that ``other`` has as well."""
    clash = (set(df.columns) & set(other.columns)) - set(on)
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in clash})


def merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    suffixes: tuple[str, str] = ("_power", "_weather"),
) -> DataFrame:
    """Equi join; columns both sides have get a suffix."""
    lhs = suffixed(left, right, on, suffixes[0]) if suffixes[0] else left
    rhs = suffixed(right, left, on, suffixes[1])
    return lhs.join(rhs, list(on), how)


def _time_line(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, seq: str | None, right_first: bool) -> Series:
    """Both sides on one time line per key, the right row packed so that it can be carried along."""
    packed = F.struct(F.col(ts).alias("at"), *[c for c in right.columns if c not in (*keys, ts)])
    whole = F.struct(*left.columns)
    hit_type = right.select(packed.alias("p")).schema["p"].dataType
    row_type = left.select(whole.alias("p")).schema["p"].dataType
    no_seq = F.lit(0).cast("double")
    rhs = right.select(
        *keys,
        ts,
        F.lit(0 if right_first else 1).alias("_side"),
        (F.col(seq).cast("double") if seq else no_seq).alias("_seq"),
        packed.alias("_hit"),
        F.lit(None).cast(row_type).alias("_row"),
    )
    lhs = left.select(
        *keys,
        ts,
        F.lit(1 if right_first else 0).alias("_side"),
        no_seq.alias("_seq"),
        F.lit(None).cast(hit_type).alias("_hit"),
        whole.alias("_row"),
    )
    return series(lhs.unionByName(rhs), keys=keys, order=(ts, "_side", "_seq")).carrying("_hit")


def _payload(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, hit: str) -> list[Column]:
    names = [c for c in right.columns if c not in (*keys, ts)]
    return [F.col(f"{hit}.{c}").alias(c if c not in left.columns else f"{c}_right") for c in names]


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("zone",),
    ts: str = "timestamp",
    seq: str | None = None,
    tolerance_seconds: float | None = None,
    direction: str = "backward",
    match_ts: str | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it (``forward``: first at or after).

    The right row is carried along one time line per key, so nothing is joined pairwise.
    At equal time the right row counts, and among equal right rows the one with the
    largest ``seq``. Unmatched rows get nulls.
    """
    keys = list(keys)
    forward = direction == "forward"
    s = _time_line(left, right, keys, ts, seq, right_first=not forward)
    found = s.next_known("_hit") if forward else s.last_known("_hit")
    out = s.df.withColumn("_found", found).where(F.col("_row").isNotNull())
    hit = F.col("_found")
    if tolerance_seconds is not None:
        gap = F.abs(F.unix_micros(ts) - F.unix_micros("_found.at"))
        hit = F.when(gap <= F.lit(int(tolerance_seconds * 1_000_000)), hit)
    out = out.select("_row.*", hit.alias("_m"))
    cols = _payload(left, right, keys, ts, "_m")
    if match_ts:
        cols.append(F.col("_m.at").alias(match_ts))
    return out.select(*left.columns, *cols)


def nearest_join(
    left: DataFrame, right: DataFrame, *, keys: Sequence[str] = ("zone",), ts: str = "timestamp", seq: str | None = None
) -> DataFrame:
    """Each left row with the right row nearest in time; the earlier one wins a tie.

    One pass over the time line carries the right row both ways.
    """
    keys = list(keys)
    s = _time_line(left, right, keys, ts, seq, right_first=True)
    both = s.df.withColumns({"_before": s.last_known("_hit"), "_after": s.next_known("_hit")})
    both = both.where(F.col("_row").isNotNull())
    now = F.unix_micros(ts)
    back, ahead = now - F.unix_micros("_before.at"), F.unix_micros("_after.at") - now
    use_back = F.coalesce(back <= ahead, F.col("_before").isNotNull())
    out = both.select("_row.*", F.when(use_back, F.col("_before")).otherwise(F.col("_after")).alias("_m"))
    return out.select(*left.columns, *_payload(left, right, keys, ts, "_m"), F.col("_m.at").alias("matched_at"))


def expand_horizons(df: DataFrame, horizons: Sequence[int], ts: str = "timestamp") -> DataFrame:
    """One row per horizon with target_time = time + horizon hours."""
    out = df.withColumn("horizon_hours", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return out.withColumn("target_time", F.col(ts) + F.make_dt_interval(hours=F.col("horizon_hours")))


def latest_lags(df: DataFrame, rows: Sequence[int] = (1, 24), ts: str = "timestamp", default: float = 0.0) -> DataFrame:
    """Per zone the k-th row from the end as load_lag_{k}h; the default where there is none."""
    ranked = with_position(df.select("zone", ts, "load"), order=(ts,))
    back = F.col("n") - F.col("pos")
    return ranked.groupBy("zone").agg(
        F.max(ts).alias(ts),
        *[F.coalesce(F.max(F.when(back == k, F.col("load"))), F.lit(default)).alias(f"load_lag_{k}h") for k in rows],
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; nulls in keys are equal."""
    return deduplicate(df, keys, order)


def composite_forecast(
    preds: DataFrame, composition: DataFrame, value: str = "prediction", band: float = 0.05, by: Sequence[str] = ("target_time",)
) -> DataFrame:
    """Sum of the component zones; their bands add in quadrature; all components are needed."""
    composition = stored(composition)
    parts = composition.groupBy("composite").agg(F.count(F.lit(1)).alias("_parts"))
    joined = preds.where(F.col(value).isNotNull()).join(composition, "zone")
    v = F.col(value)
    out = joined.groupBy("composite", *by).agg(
        F.sum(v).alias("predicted_load"),
        F.sqrt(F.sum((v * band) * (v * band))).alias("_half"),
        F.countDistinct("zone").alias("_have"),
    )
    out = out.join(parts, "composite").where("_have = _parts")
    return out.select(
        "composite",
        *by,
        "predicted_load",
        (F.col("predicted_load") - F.col("_half")).alias("confidence_lower"),
        (F.col("predicted_load") + F.col("_half")).alias("confidence_upper"),
    )


def weather_with_fallback(
    zones: DataFrame, current: DataFrame, fallback: dict[str, str], defaults: dict[str, float]
) -> DataFrame:
    """Latest weather of the zone, else of its stand-in zone, else default values."""
    values = list(defaults)
    own = current.select("zone", *[F.col(c).alias(f"_own_{c}") for c in values])
    stand_in = current.select(F.col("zone").alias("_stand_in"), *[F.col(c).alias(f"_alt_{c}") for c in values])
    pairs = [F.lit(x) for kv in fallback.items() for x in kv]
    out = zones.withColumn("_stand_in", F.create_map(*pairs)[F.col("zone")] if pairs else F.lit(None).cast("string"))
    out = out.join(own, "zone", "left").join(stand_in, "_stand_in", "left")
    source = (
        F.when(F.col(f"_own_{values[0]}").isNotNull(), "zone")
        .when(F.col(f"_alt_{values[0]}").isNotNull(), "component")
        .otherwise("default")
    )
    filled = [F.coalesce(f"_own_{c}", f"_alt_{c}", F.lit(defaults[c])).alias(c) for c in values]
    return out.select("zone", *filled, source.alias("weather_source"))


def map_values(df: DataFrame, mapping: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Dictionary lookup by join; the mapping is stored first, so its size is known."""
    return df.join(stored(mapping), on, how)


def lag_by_time(df: DataFrame, value: str, hours: Sequence[int], keys: Sequence[str] = ("zone",), ts: str = "timestamp") -> DataFrame:
    """Value exactly k hours earlier (null over gaps), unlike the row lag; the largest where a time stands more than once.

    The shifted rows of all lags are grouped by their time and joined once.
    """
    shift = F.explode(F.array(*[F.lit(k) for k in hours]))
    past = df.select(*keys, F.col(ts).alias("_at"), F.col(value).alias("_v"), shift.alias("_k"))
    past = past.withColumn(ts, F.col("_at") + F.make_dt_interval(hours=F.col("_k")))
    lags = [F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"{value}_lag_{k}h") for k in hours]
    return join_keys(df, past.groupBy(*keys, ts).agg(*lags), [*keys, ts], "left")
