"""Exact quantiles per group without collecting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.core.scalars import beside
from gridweave.core.series import join_keys
from gridweave.session import setting, stored

ROWS_PER_CHUNK = 1_000_000
# Accuracy of the approximate quantiles that cut a group: a rank is off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000


def group_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Linear quantiles: ``wanted`` maps an output name to (column, q). One row per group.

    Groups within the chunk limit use ``percentile``. Beyond it the wanted ranks are enclosed between approximate
    quantiles, the rows below them are counted, and only the rows between them are sorted.
    """
    limit = setting(df.sparkSession, "gridweave.rowsPerChunk", ROWS_PER_CHUNK)
    keys = list(keys)
    by_column: dict[str, list[tuple[str, float]]] = {}
    for name, (c, q) in wanted.items():
        by_column.setdefault(c, []).append((name, q))
    known = {c: f"_n{i}" for i, c in enumerate(by_column)}
    sizes = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(n) for c, n in known.items()]))
    top = sizes.agg(F.max("_n")).first()[0] or 0
    if top <= limit:
        return df.groupBy(*keys).agg(*[F.percentile(c, q).alias(name) for name, (c, q) in wanted.items()])
    work_keys = keys or ["_all"]
    if not keys:
        sizes = sizes.withColumn("_all", F.lit(1))
    out = sizes.select(*work_keys)
    for c, asked in by_column.items():
        rows = df.where(F.col(c).isNotNull()).select(*keys, F.col(c).cast("double").alias("_v"))
        if not keys:
            rows = rows.withColumn("_all", F.lit(1))
        counts = sizes.where(F.col(known[c]) > 0).select(*work_keys, F.col(known[c]).alias("_cnt"))
        ranks = counts.withColumn(
            "_q", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in asked]))
        )
        exact = (F.col("_cnt") - 1) * F.col("_q.q")
        ranks = ranks.select(*work_keys, F.col("_q.name").alias("_name"), exact.alias("_at")).withColumn(
            "_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))
        )
        ranks = stored(ranks)
        values = _values_at(rows, counts, ranks.select(*work_keys, "_rank").distinct(), work_keys, [q for _, q in asked], limit)
        found = join_keys(ranks, values, [*work_keys, "_rank"]).groupBy(*work_keys, "_name", "_at").agg(
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        # As ``percentile`` does it, so that equal infinities stay what they are.
        between = (F.ceil("_at") - F.col("_at")) * F.col("_lo") + (F.col("_at") - F.floor("_at")) * F.col("_hi")
        value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between)
        wide_out = (
            found.withColumn("_val", value)
            .groupBy(*work_keys)
            .pivot("_name", [n for n, _ in asked])
            .agg(F.first("_val"))
        )
        out = join_keys(out, wide_out, work_keys, "left")
    return stored(out.select(*keys, *wanted))


def _values_at(rows: DataFrame, counts: DataFrame, ranks: DataFrame, keys: list[str], near: Sequence[float], limit: int) -> DataFrame:
    """(keys, _rank, _v): the values at some ranks of each group.

    A range is a part of a group between two of its values, with the number of rows before it. A range above the limit
    is cut at values of its own, so every round leaves fewer rows in it; one that holds no wanted rank is not read again.
    """
    shares = {i / 8 for i in range(1, 8)} | {min(max(q + d * 1.5 / ACCURACY, 0.0), 1.0) for q in near for d in (-1, 1)}
    nothing = F.lit(None).cast("double")
    start = {"_b": F.array(F.lit(0).cast("bigint")), "_from": nothing, "_to": nothing, "_base": F.lit(0).cast("bigint")}
    asked = stored(join_keys(ranks, counts, keys).withColumns(start))
    done = None
    while True:
        ranges = asked.select(*keys, "_b", "_from", "_to", "_base", "_cnt").distinct()
        hot = stored(ranges.where(F.col("_cnt") > limit))
        if hot.isEmpty():
            break
        cuts = _inside(rows, hot.select(*keys, "_b", "_from", "_to"), keys).groupBy(*keys, "_b").agg(
            F.array_sort(F.array_distinct(F.percentile_approx("_v", sorted(shares), ACCURACY))).alias("_cuts")
        )
        cuts = stored(join_keys(hot, stored(cuts), [*keys, "_b"]))
        # Even pieces lie between cuts, odd ones equal a cut.
        piece = F.lit(0)
        for i in range(len(shares)):
            cut = F.get("_cuts", F.lit(i))
            piece = piece + F.when(F.col("_v") > cut, 2).when(F.col("_v") == cut, 1).otherwise(0)
        pieces = _inside(rows, cuts.select(*keys, "_b", "_from", "_to", "_cuts"), keys)
        pieces = stored(pieces.withColumn("_piece", piece.cast("bigint")).groupBy(*keys, "_b", "_piece").agg(F.count(F.lit(1)).alias("_k")))
        before = F.sum("_k").over(Window.partitionBy(*keys, "_b").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
        pieces = join_keys(pieces.withColumn("_before", before), cuts, [*keys, "_b"])
        lower, upper = F.get("_cuts", (F.col("_piece") / 2).cast("int") - 1), F.get("_cuts", (F.col("_piece") / 2).cast("int"))
        parts = pieces.select(
            *keys, "_b", "_piece",
            (F.col("_base") + F.col("_before")).alias("_start"),
            F.col("_k").alias("_size"),
            F.when(F.col("_piece") % 2 == 1, upper).alias("_v"),
            F.when(F.col("_piece") > 0, lower).otherwise(F.col("_from")).alias("_above"),
            F.coalesce(upper, F.col("_to")).alias("_below"),
        )
        placed = join_keys(asked.where(F.col("_cnt") > limit).select(*keys, "_rank", "_b"), parts, [*keys, "_b"])
        placed = stored(placed.where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_size"))))
        answered = placed.where("_v is not null").select(*keys, "_rank", "_v")
        done = answered if done is None else done.unionByName(answered)
        narrower = placed.where("_v is null").select(
            *keys, "_rank", F.concat("_b", F.array("_piece")).alias("_b"), F.col("_above").alias("_from"), F.col("_below").alias("_to"),
            F.col("_start").alias("_base"), F.col("_size").alias("_cnt"),
        )
        asked = stored(asked.where(F.col("_cnt") <= limit).unionByName(narrower))
    if not asked.isEmpty():
        inside = _inside(rows, ranges.select(*keys, "_b", "_from", "_to", "_base"), keys)
        spot = Window.partitionBy(*keys, "_b").orderBy("_v")
        picked = inside.withColumn("_rank", F.col("_base") + F.row_number().over(spot) - 1).select(*keys, "_rank", "_v")
        picked = join_keys(asked.select(*keys, "_rank"), picked, [*keys, "_rank"])
        done = picked if done is None else done.unionByName(picked)
    return done


def _inside(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The rows between the ends of a range of their group, with the range."""
    v = F.col("_v")
    ends = (F.col("_from").isNull() | (v > F.col("_from"))) & (F.col("_to").isNull() | (v < F.col("_to")))
    return join_keys(rows, ranges, keys).where(ends)


def with_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Attach group quantiles to every row; the quantile table is stored first."""
    if not keys:
        return beside(df, stored(group_quantiles(df, [], wanted)))
    return join_keys(df, stored(group_quantiles(df, keys, wanted)), keys, "left")
