"""Ordered work on long series without putting a series into one task.

A table holds few series (zones) and one of them may hold a third of all rows, so
Window.partitionBy(zone) alone does not scale. Here a series is cut into chunks of
about ``gridweave.rowsPerChunk`` rows:

1. a histogram counts the rows per series and time bucket (map-side combined, two
   columns read) and is stored; buckets above the limit are split again by range, on
   the first order column that still differs in them;
2. running sums over the histogram give each bucket its first row position and its
   chunk; buckets whose rows lie within ``back`` rows before (``ahead`` rows after) a
   chunk are also copied into it as halo, so a frame of that many rows is complete;
3. the window runs on (series, chunk) and halo rows are dropped afterwards.

The result equals the plain window. When the histogram shows that every series fits
in one chunk, the plain window is used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.session import setting, stored

ROWS_PER_CHUNK = 1_000_000
# Shares at which a bucket above the limit is cut.
CUTS = [i / 64 for i in range(1, 64)]

FIRST = Window.unboundedPreceding


def order_levels(df: DataFrame, name: str) -> list[Column]:
    """The order column as doubles that, compared one after the other, never contradict its order.

    Strings are taken six bytes at a time, long integers by their halves. Values that no level tells apart (strings
    equal in their first 24 bytes, decimals equal as doubles) stay in one bucket, where the column itself orders them.
    """
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        digits = F.rpad(F.hex(F.substring(col.cast("binary"), 1, 24)), 48, "0")
        return [F.conv(F.substring(digits, at, 12), 16, 10).cast("double") for at in (1, 13, 25, 37)]
    if isinstance(kind, T.LongType):
        return [F.shiftright(col, 32).cast("double"), col.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return [F.unix_micros(col.cast("timestamp")).cast("double")]
    if isinstance(kind, T.DateType):
        return [F.unix_date(name).cast("double")]
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return [col.cast("double")]
    raise TypeError(f"cannot order a series by {name}: {kind.simpleString()}")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that treats null keys as equal and keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


@dataclass(frozen=True)
class Histogram:
    """Row counts per (series, bucket), and the rows with their bucket."""

    rows: DataFrame
    table: DataFrame
    keys: tuple[str, ...]
    series_max: int


def _count(rows: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    at = range(levels)
    return rows.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_cnt"),
        *[F.min(F.col("_lv")[i]).alias(f"_lo{i}") for i in at],
        *[F.max(F.col("_lv")[i]).alias(f"_hi{i}") for i in at],
        F.count_if(F.col("_lv")[0].isNull()).alias("_nulls"),
    )


def histogram(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    limit: int,
    bucket: Column | None = None,
) -> Histogram:
    """Count rows per bucket; split buckets above the limit until none is left.

    ``bucket`` must rise with the first order column; without it a series starts as one
    bucket. A bucket is split by the first level of its order columns that differs in it;
    one in which all order values are equal cannot be split.
    """
    levels = [level for name in order for level in order_levels(df, name)]
    start = bucket.cast("bigint") if bucket is not None else F.lit(0).cast("bigint")
    rows = df.withColumns({"_lv": F.array(*levels), "_b": F.array(start)})
    table = stored(_count(rows, keys, len(levels)))
    at = F.coalesce(*[F.when(F.col(f"_lo{i}") < F.col(f"_hi{i}"), F.lit(i)) for i in range(len(levels))])
    wide = (F.col("_cnt") > limit) & at.isNotNull()
    while True:
        # Every round cuts each wide bucket: the cuts are values of it, and not all of its values are equal.
        sizes = table.groupBy(*keys).agg(F.sum("_cnt").alias("n"), F.max(wide).alias("hot"))
        top, any_hot = sizes.agg(F.max("n"), F.max("hot")).first()
        if not any_hot:
            break
        hot = table.where(wide).select(
            *[F.col(k).alias(f"_r_{k}") for k in keys],
            F.col("_b").alias("_hb"),
            at.alias("_at"),
        )
        here = (F.col("_b") == F.col("_hb")) & _null_safe(keys)
        value = F.get("_lv", F.col("_at"))
        # Approximate quantiles combine on the map side and fit any distribution.
        cuts = rows.join(hot, here).groupBy(*[f"_r_{k}" for k in keys], "_hb", "_at")
        cuts = stored(cuts.agg(F.percentile_approx(value, CUTS, 1000).alias("_cuts")))
        # Values equal to a cut form their own piece, so one crowded value is set apart.
        below = F.size(F.filter("_cuts", lambda c: c < value))
        upto = F.size(F.filter("_cuts", lambda c: c <= value))
        piece = F.when(value.isNull(), -1).otherwise(below + upto).cast("bigint")
        split = F.when(F.col("_hb").isNotNull(), F.concat("_b", F.array(piece))).otherwise(F.col("_b"))
        rows = rows.join(cuts, here, "left").withColumn("_b", split).select(*rows.columns)
        # Only the rows of split buckets are counted again.
        again = rows.join(
            hot.select(*[f"_r_{k}" for k in keys], "_hb"),
            (F.slice("_b", 1, F.size("_hb")) == F.col("_hb")) & _null_safe(keys),
            "left_semi",
        )
        calm = table.join(hot, here, "left_anti")
        table = stored(calm.unionByName(_count(again, keys, len(levels))))
    table = table.withColumnsRenamed({"_lo0": "_k0", "_hi0": "_k1"})
    return Histogram(rows, table, tuple(keys), int(top or 0))


def _null_safe(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return cond


def positions(hist: Histogram) -> DataFrame:
    """First row position of each bucket and the length of its series."""
    by_bucket = Window.partitionBy(*hist.keys).orderBy("_b")
    return hist.table.select(
        *hist.keys,
        "_b",
        "_cnt",
        "_k0",
        "_k1",
        (F.sum("_cnt").over(by_bucket.rowsBetween(FIRST, 0)) - F.col("_cnt")).alias("_base"),
        F.sum("_cnt").over(Window.partitionBy(*hist.keys)).alias("_n"),
    )


@dataclass(frozen=True)
class Series:
    """Rows of many series cut into chunks, ready for window expressions."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool
    halo: bool
    columns: tuple[str, ...]
    carried: dict[str, str] = field(default_factory=dict)

    @property
    def by(self) -> tuple[str, ...]:
        return (*self.keys, "_chunk") if self.chunked else self.keys

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def pos(self) -> Column:
        """0-based position of the row in its whole series."""
        here = F.row_number().over(self.w) - 1
        if not self.chunked:
            return here.cast("bigint")
        return F.first("_base").over(self.w.rowsBetween(FIRST, 0)) + here

    @property
    def n(self) -> Column:
        """Number of rows of the whole series."""
        if self.chunked:
            return F.col("_n")
        return F.count(F.lit(1)).over(Window.partitionBy(*self.keys))

    def rows(self, back: int, ahead: int = 0) -> WindowSpec:
        return self.w.rowsBetween(-back, ahead)

    def lag(self, name: str, k: int = 1) -> Column:
        return F.lag(name, k).over(self.w)

    def lead(self, name: str, k: int = 1) -> Column:
        return F.lead(name, k).over(self.w)

    def carrying(self, *names: str, sums: Sequence[str] = ()) -> Series:
        """Prepare unbounded scans: what earlier and later chunks hand to each chunk.

        One small row per chunk travels; the chunk table is scanned per series.
        """
        if not self.chunked:
            return self
        if self.halo:
            raise ValueError("unbounded scans take chunks without halo")
        place = F.struct(*self.order)
        aggs = []
        for name in names:
            known = F.when(F.col(name).isNotNull(), place)
            aggs += [
                F.max_by(name, known).alias(f"_l_{name}"),
                F.min_by(name, known).alias(f"_f_{name}"),
            ]
        aggs += [F.sum(name).alias(f"_s_{name}") for name in sums]
        per_chunk = self.df.groupBy(*self.by).agg(*aggs)
        scan = Window.partitionBy(*self.keys).orderBy("_chunk")
        reverse = Window.partitionBy(*self.keys).orderBy(F.desc("_chunk"))
        hand = []
        for name in names:
            hand.append(F.last(f"_l_{name}", True).over(scan.rowsBetween(FIRST, -1)).alias(f"_before_{name}"))
            hand.append(F.last(f"_f_{name}", True).over(reverse.rowsBetween(FIRST, -1)).alias(f"_after_{name}"))
        for name in sums:
            hand.append(F.sum(f"_s_{name}").over(scan.rowsBetween(FIRST, -1)).alias(f"_sum_{name}"))
        table = stored(per_chunk.select(*self.by, *hand))
        return replace(self, df=join_keys(self.df, table, self.by, "left"))

    def last_known(self, name: str) -> Column:
        """Latest non-null value up to and including the row."""
        here = F.last(name, True).over(self.w.rowsBetween(FIRST, 0))
        return F.coalesce(here, F.col(f"_before_{name}")) if self.chunked else here

    def next_known(self, name: str) -> Column:
        """First non-null value from the row on.

        Written as the last value of the reversed series: Spark rescans a frame that
        is open at its end for every row.
        """
        reverse = Window.partitionBy(*self.by).orderBy(*[F.desc(c) for c in self.order])
        here = F.last(name, True).over(reverse.rowsBetween(FIRST, 0))
        return F.coalesce(here, F.col(f"_after_{name}")) if self.chunked else here

    def running_sum(self, name: str) -> Column:
        here = F.sum(name).over(self.w.rowsBetween(FIRST, 0))
        return here + F.coalesce(F.col(f"_sum_{name}"), F.lit(0)) if self.chunked else here

    def finish(self, out: DataFrame) -> DataFrame:
        """Drop halo rows and working columns."""
        if self.halo:
            out = out.where("_own")
        return out.drop(*[c for c in out.columns if c.startswith("_")])


def series(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("zone",),
    order: Sequence[str] = ("timestamp",),
    back: int = 0,
    ahead: int = 0,
    bucket: Column | None = None,
    most: int | None = None,
) -> Series:
    """Cut the series of ``df`` into chunks with a halo of ``back``/``ahead`` rows; ``most`` asks for smaller chunks than the setting."""
    keys, order = tuple(keys), tuple(order)
    limit = setting(df.sparkSession, "gridweave.rowsPerChunk", ROWS_PER_CHUNK)
    limit = max(limit if most is None else min(limit, most), back, ahead)
    if bucket is None and isinstance(df.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
        bucket = F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / 3600)
    hist = histogram(df, keys, order, limit, bucket)
    if hist.series_max <= limit:
        return Series(df, keys, order, False, False, tuple(df.columns))
    plan = positions(hist).withColumn("_home", F.floor(F.col("_base") / limit))
    by_key = Window.partitionBy(*keys)
    nothing = F.array().cast("array<bigint>")
    plan = plan.withColumns(
        {
            "_fwd": F.collect_set("_home").over(by_key.orderBy("_base").rangeBetween(0, max(back - 1, 0))),
            "_bwd": F.collect_set("_home").over(
                by_key.orderBy(F.col("_base") + F.col("_cnt")).rangeBetween(-max(ahead - 1, 0), 0)
            ),
        }
    )
    steps = by_key.orderBy("_b")
    targets = [F.array("_home")]
    if back:
        targets.append(F.coalesce(F.lead("_fwd", 1).over(steps), nothing))
    if ahead:
        targets.append(F.coalesce(F.lag("_bwd", 1).over(steps), nothing))
    plan = stored(
        plan.select(*keys, "_b", "_base", "_n", "_home", F.array_distinct(F.concat(*targets)).alias("_to"))
    )
    rows = join_keys(hist.rows, plan, [*keys, "_b"], "left").drop("_lv", "_b")
    # The layout was counted in an earlier read; a row that it lacks means that the input has changed since.
    lost = F.raise_error(F.lit("the rows of a series changed between two reads of its input"))
    rows = rows.withColumn("_home", F.when(F.col("_home").isNull(), lost.cast("bigint")).otherwise(F.col("_home")))
    if back or ahead:
        rows = rows.withColumn("_chunk", F.explode("_to"))
        rows = rows.withColumn("_own", F.col("_chunk") == F.col("_home"))
    else:
        rows = rows.withColumn("_chunk", F.col("_home"))
    return Series(rows.drop("_to", "_home"), keys, order, True, bool(back or ahead), tuple(df.columns))


def over_series(
    df: DataFrame,
    build: Callable[[Series], dict[str, Column] | DataFrame],
    **layout,
) -> DataFrame:
    """Add window columns: ``build`` gets the Series, returns columns or a DataFrame."""
    s = series(df, **layout)
    out = build(s)
    if isinstance(out, dict):
        out = s.df.withColumns(out)
    return s.finish(out)


def with_position(df: DataFrame, pos: str = "pos", n: str | None = "n", **layout) -> DataFrame:
    """Add the 0-based position in the series and, if asked, the series length."""

    def build(s: Series) -> dict[str, Column]:
        cols = {pos: s.pos}
        if n:
            cols[n] = s.n
        return cols

    return over_series(df, build, **layout)
