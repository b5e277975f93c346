"""Chunked windows equal plain windows, also with hot series, hot buckets and ties."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridweave.core.quantiles import group_quantiles
from gridweave.core.series import over_series, series, with_position


def skewed(spark, n=1200):
    """A hot zone with half of all rows, a third of the rows in one hour, many at one instant, gaps and a null zone."""
    i = F.col("id")
    base = F.lit("2024-01-01").cast("timestamp")
    seconds = F.when(i % 3 == 0, F.lit(7200)).when(i % 3 == 1, i * 600).otherwise(i * 7200)
    return spark.range(n).select(
        i.alias("seq"),
        F.when(i % 2 == 0, "HOT").when(i % 11 == 0, F.lit(None)).when(i % 5 == 0, "B").otherwise("C").alias("zone"),
        (base + F.make_dt_interval(secs=seconds)).alias("timestamp"),
        ((i * 7919) % 1009).cast("double").alias("load"),
    )


def rows(df):
    return sorted(df.collect(), key=str)


ORDER = ("timestamp", "seq")


def test_chunks_are_used_and_bounded(small_chunks):
    s = series(skewed(small_chunks), order=ORDER, back=7, ahead=2)
    assert s.chunked
    sizes = s.df.where("_own").groupBy("zone", "_chunk").count()
    # Buckets are split until none is above the limit, so a chunk holds at most about two limits.
    assert sizes.agg(F.max("count")).first()[0] <= 150


@pytest.mark.parametrize("back,ahead", [(1, 0), (7, 2), (0, 3), (45, 0)])
def test_bounded_frames(small_chunks, back, ahead):
    df = skewed(small_chunks)
    got = over_series(
        df,
        lambda s: {
            "total": F.sum("load").over(s.rows(back, ahead)),
            "before": s.lag("load", max(back, 1)) if back else F.lit(0.0),
            "after": s.lead("load", max(ahead, 1)) if ahead else F.lit(0.0),
        },
        order=ORDER,
        back=back,
        ahead=ahead,
    )
    w = Window.partitionBy("zone").orderBy(*ORDER)
    want = df.withColumns(
        {
            "total": F.sum("load").over(w.rowsBetween(-back, ahead)),
            "before": F.lag("load", max(back, 1)).over(w) if back else F.lit(0.0),
            "after": F.lead("load", max(ahead, 1)).over(w) if ahead else F.lit(0.0),
        }
    )
    assert rows(got) == rows(want)


def test_positions_and_lengths(small_chunks):
    df = skewed(small_chunks)
    got = with_position(df, order=ORDER)
    w = Window.partitionBy("zone").orderBy(*ORDER)
    want = df.withColumns(
        {
            "pos": (F.row_number().over(w) - 1).cast("bigint"),
            "n": F.count(F.lit(1)).over(Window.partitionBy("zone")),
        }
    )
    assert rows(got) == rows(want)


def test_unbounded_scans(small_chunks):
    df = skewed(small_chunks).withColumn("x", F.when(F.col("load") % 7 == 0, F.col("load")))
    s = series(df, order=ORDER).carrying("x", sums=["load"])
    assert s.chunked
    got = s.finish(s.df.withColumns({"a": s.last_known("x"), "b": s.next_known("x"), "c": s.running_sum("load")}))
    w = Window.partitionBy("zone").orderBy(*ORDER)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.withColumns(
        {"a": F.last("x", True).over(up), "b": F.first("x", True).over(down), "c": F.sum("load").over(up)}
    )
    assert rows(got) == rows(want)


def test_halo_and_scans_do_not_mix(small_chunks):
    with pytest.raises(ValueError):
        series(skewed(small_chunks), order=ORDER, back=1).carrying("load")


def test_exact_quantiles_in_chunks(small_chunks):
    small_chunks.conf.set("gridweave.rowsPerChunk", "150")
    df = skewed(small_chunks).withColumn("flat", F.lit(4.0)).withColumn("far", F.pow(F.lit(10.0), F.col("load") / 40))
    wanted = {"a": ("load", 0.5), "b": ("load", 0.013), "c": ("flat", 0.3), "d": ("far", 0.99), "e": ("far", 1.0)}
    got = {r["zone"]: r for r in group_quantiles(df, ["zone"], wanted).collect()}
    want = df.groupBy("zone").agg(*[F.percentile(c, q).alias(n) for n, (c, q) in wanted.items()]).collect()
    assert len(got) == len(want) == 4
    for r in want:
        for n in wanted:
            assert got[r["zone"]][n] == pytest.approx(r[n], rel=1e-12)
    total = group_quantiles(df, [], wanted).first()
    assert total["a"] == df.agg(F.percentile("load", 0.5)).first()[0]


def test_only_ranges_with_wanted_ranks_are_cut(small_chunks, monkeypatch):
    calls, cut = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a, **k: calls.append(a) or cut(*a, **k))
    df = small_chunks.range(40_000).select(F.when(F.col("id") % 100 > 0, F.sin("id")).alias("x"))
    got = group_quantiles(df, [], {"a": ("x", 0.5), "b": ("x", 0.9)}).first()
    assert got == df.agg(F.percentile("x", 0.5).alias("a"), F.percentile("x", 0.9).alias("b")).first()
    assert len(calls) == 1


def test_exact_quantiles_of_ties_nan_and_infinity(small_chunks):
    values = [float("nan")] * 70 + [float("inf")] * 3 + [-float("inf")] * 90 + [-0.0, 0.0] * 60 + [i / 7 for i in range(-300, 500)] + [None] * 80
    df = small_chunks.createDataFrame([("A", x) for x in values] + [("B", None)] * 70 + [(None, 1.5), (None, 2.5)], "g string, x double")
    wanted = {f"q{i}": ("x", i / 8) for i in range(1, 8)} | {"least": ("x", 0.0), "most": ("x", 1.0)}
    got = {r["g"]: r for r in group_quantiles(df, ["g"], wanted).collect()}
    for r in df.groupBy("g").agg(*[F.percentile(c, q).alias(n) for n, (c, q) in wanted.items()]).collect():
        for n in wanted:
            assert (got[r["g"]][n] is None and r[n] is None) or got[r["g"]][n] == pytest.approx(r[n], rel=1e-12, nan_ok=True), n


def test_empty_and_single_rows(spark):
    schema = "zone string, timestamp timestamp, load double"
    empty = spark.createDataFrame([], schema)
    assert over_series(empty, lambda s: {"x": s.lag("load")}, back=1).count() == 0
    one = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0), (None, dt.datetime(2024, 1, 1), 2.0)], schema)
    got = over_series(one, lambda s: {"x": s.lag("load"), "sd": F.stddev_samp("load").over(s.rows(2))}, back=2)
    assert [(r["x"], r["sd"]) for r in got.collect()] == [(None, None)] * 2


def test_result_does_not_depend_on_partitioning(small_chunks):
    df = skewed(small_chunks)
    build = lambda s: {"m": F.avg("load").over(s.rows(5))}
    a = over_series(df.repartition(1), build, order=ORDER, back=5)
    b = over_series(df.repartition(13, "seq"), build, order=ORDER, back=5)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("kind", ["string", "bigint", "decimal", "third"])
def test_order_columns_of_every_type(small_chunks, kind):
    """Many rows at one time, told apart by texts, large integers, decimals or a third column only."""
    small_chunks.conf.set("gridweave.rowsPerChunk", "20")
    df = small_chunks.range(300).select(F.lit("A").alias("zone"), F.lit(dt.datetime(2024, 1, 1)).alias("timestamp"), F.xxhash64("id").alias("h"), "id")
    tie = {
        "string": F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).when(F.col("id") % 3 == 1, F.concat(F.lit("same long prefix "), "id")).otherwise(F.concat(F.lit("a\u00e9"), F.col("id") * 7)),
        "bigint": F.lit(2**53) * F.lit(512) + F.col("id") - 150,
        "decimal": (F.col("id") / 7 - 20).cast("decimal(20,6)"),
        "third": F.col("id") % 2,
    }[kind]
    df = df.withColumn("tie", tie)
    order = ("timestamp", "tie", "h") if kind == "third" else ("timestamp", "tie")
    got = {r["id"]: r["prev"] for r in over_series(df, lambda s: {"prev": s.lag("id")}, order=order, back=1).collect()}
    plain = Window.partitionBy("zone").orderBy(*order)
    assert got == {r["id"]: r["prev"] for r in df.withColumn("prev", F.lag("id").over(plain)).collect()}


def test_order_column_without_a_number_is_refused(spark):
    df = spark.range(3).select(F.lit("A").alias("zone"), F.array("id").alias("timestamp"))
    with pytest.raises(TypeError):
        series(df)
