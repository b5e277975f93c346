"""Sources, streams and training on small inputs."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from gridweave.functions.calendar import calendar_parts
from gridweave.operators import joins
from gridweave.plans import scoring as sc
from gridweave.plans import training as tr
from gridweave.session import shared_dir, stored
from gridweave.sources import files as fs
from gridweave.streaming import jobs as st
from tests.test_features import T0, hours


class Named:
    """A session as ``shared_dir`` sees it."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})
        self.conf = type("F", (), {"get": staticmethod(lambda name, default=None: folder or default)})


def test_shared_dir_is_the_named_folder():
    assert shared_dir(Named("yarn", "hdfs://x/check/")) == "hdfs://x/check"
    assert shared_dir(Named("local[2]", "/mnt/check")) == "/mnt/check"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Named("spark://host:7077"))


def test_stored_table_lies_in_the_shared_folder(spark):
    assert shared_dir(spark) in stored(spark.range(3)).inputFiles()[0]


def test_region_csv_sums_zones_per_time(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Time Stamp,Name,PTID,Load\n01/01/2024 00:00:00,X,1,10\n01/01/2024 00:00:00,Y,2,5\nbad,Y,2,5\n01/01/2024 00:05:00,X,1,\n"
    )
    got = fs.read_region_csv(spark, str(tmp_path)).collect()
    assert [(r["timestamp"], r["load"], r["region"]) for r in got] == [(T0, 15.0, "NYISO")]


def test_xml_report_skips_other_items_and_error_documents(spark, tmp_path):
    row = "<REPORT_DATA><DATA_ITEM>{}</DATA_ITEM><RESOURCE_NAME>{}</RESOURCE_NAME><INTERVAL_START_GMT>2024-01-01T00:00:00-00:00</INTERVAL_START_GMT><VALUE>{}</VALUE></REPORT_DATA>"
    body = row.format("SYS_FCST_5MIN_MW", "SCE-TAC", "7.5") + row.format("OTHER", "SCE-TAC", "1") + row.format("LOAD_5MIN_MW", "PGE-TAC", "none")
    (tmp_path / "a.xml").write_text(f"<R>{body}</R>")
    (tmp_path / "b.xml").write_text("<R><ERROR><ERR_CODE>1000</ERR_CODE></ERROR></R>")
    got = fs.read_report_xml(spark, str(tmp_path)).collect()
    assert [(r["timestamp"], r["load"], r["zone"]) for r in got] == [(T0, 7.5, "SCE")]


def test_absent_weather_is_empty(spark, tmp_path):
    out = fs.read_weather(spark, str(tmp_path / "none"))
    assert out.count() == 0 and "temp_c" in out.columns
    assert fs.read_forecasts(spark, str(tmp_path / "none")).count() == 0


def test_zone_and_column_pruning_reach_the_scan(spark, tmp_path):
    rows = hours(spark, 5, zone="SCE").unionByName(hours(spark, 5, zone="NP15")).withColumn("extra", F.lit(1))
    fs.write_by_zone(rows, str(tmp_path / "load"))
    df = fs.read_load(spark, str(tmp_path / "load"), ["SCE"], "timestamp timestamp, load double, zone string, extra int")
    df = df.where(F.col("timestamp") >= F.lit(T0)).select("zone", "load")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 5
    assert "PartitionFilters: [isnotnull(zone" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert "ReadSchema: struct<timestamp:timestamp,load:double>" in plan


def test_upsert_retry_is_harmless(spark, tmp_path):
    root, keys, order = str(tmp_path / "t"), ["timestamp", "zone"], ["seq"]
    first = hours(spark, 5).withColumn("seq", F.lit(0))
    late = hours(spark, 2, lambda i: -1).withColumn("seq", F.lit(1))
    for _ in range(2):
        st.upsert(first, 0, root, keys, order)
        st.upsert(late, 1, root, keys, order)
    got = st.current(spark, root, first.schema, keys, order)
    assert got.count() == 5 and got.where("load = -1").count() == 2
    want = sorted(got.collect())
    st.compact(spark, root, first.schema, keys, order)
    assert sorted(st.current(spark, root, first.schema, keys, order).collect()) == want
    # A folded batch that is repeated changes nothing, nor does a compaction without new batches.
    st.upsert(late, 1, root, keys, order)
    st.compact(spark, root, first.schema, keys, order)
    assert sorted(st.current(spark, root, first.schema, keys, order).collect()) == want
    assert [n for n, *_ in st.Log(spark, root, first.schema).manifests()] == [1]


def test_compaction_is_seen_at_once(spark, tmp_path):
    root, keys, order = str(tmp_path / "t"), ["timestamp", "zone"], ["seq"]
    rows = hours(spark, 60).withColumn("seq", F.lit(0))
    log = st.Log(spark, root, rows.schema)
    st.upsert(rows, 0, root, keys, order)
    before = log.rows()
    st.compact(spark, root, rows.schema, keys, order)
    assert before.count() == 60 and log.rows().count() == 60
    # A compaction that died before its commit left files that no one reads.
    last = hours(spark, 3, lambda i: -1).withColumn("seq", F.lit(2))
    st.upsert(last, 1, root, keys, order)
    last.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").parquet(f"{root}/compacted/generation=2")
    assert log.rows().count() == 63
    held = log.rows()
    st.compact(spark, root, rows.schema, keys, order)
    assert held.count() == 63 and log.rows().count() == 60 and st.current(spark, root, rows.schema, keys, order).where("load = -1").count() == 3
    (n, upto, days), day = log.manifests()[-1], str(rows.agg(F.min(F.to_date("timestamp"))).first()[0])
    assert (n, upto, days[day]) == (2, 1, 2) and sorted(set(days.values())) == [1, 2]
    st.upsert(rows.limit(0), 2, root, keys, order)
    st.upsert(hours(spark, 1, lambda i: -5).withColumn("seq", F.lit(3)), 3, root, keys, order)
    st.compact(spark, root, rows.schema, keys, order)
    assert sorted(f.name for f in (tmp_path / "t/batches").glob("batch_id=*")) == ["batch_id=2", "batch_id=3"]
    assert st.current(spark, root, rows.schema, keys, order, [day]).where("load = -5").count() == 1


def test_sums_are_compacted(spark, tmp_path):
    df, root = hours(spark, 50), str(tmp_path / "sums")
    st.upsert_sums(shuffled_feed(spark, df, str(tmp_path / "in")), root)
    want = sorted(st.merged_means(spark, root).collect())
    st.compact_sums(spark, root)
    assert sorted(st.merged_means(spark, root).collect()) == want


def test_rejected_rows_of_all_batches_are_counted(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        rows = hours(spark, 1, lambda i: 1)
        for k in range(6):
            day = rows.withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(days=F.lit(10 if k == 0 else 0)))
            day.coalesce(1).write.parquet(str(tmp_path / f"in/f={k}"))
            time.sleep(1.1)  # files are taken in the order of their times
        feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got, rejected = st.run_counting(st.tumbling_mean(feed), "append", str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert rejected == 4  # the watermark of the first batch holds from the third on


def shuffled_feed(spark, df, path, files=6):
    """A stream of one file for each trigger, in no order of time."""
    df.repartition(files, F.xxhash64(*df.columns)).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_hourly_means_in_any_file_order(spark, tmp_path):
    df = hours(spark, 200).withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(mins=(F.col("load") % 50)))
    root = str(tmp_path / "sums")
    st.upsert_sums(shuffled_feed(spark, df, str(tmp_path / "in")), root)
    want = df.groupBy(F.date_trunc("hour", "timestamp").alias("timestamp"), "zone").agg(F.avg("load").alias("load"))
    got = st.merged_means(spark, root)
    assert sorted(got.collect()) == sorted(want.collect())
    day = st.merged_sliding_means(spark, root).orderBy("window_end").collect()
    assert len(day) == 223 and day[23]["load"] == pytest.approx(df.limit(24).agg(F.avg("load")).first()[0])


def test_streams_meet_by_zone_and_hour(spark, tmp_path, capfd):
    micros = lambda df, step: df.withColumn("timestamp", F.timestamp_micros(F.unix_micros("timestamp") + step))
    loads = hours(spark, 60).unionByName(hours(spark, 60, zone="B"))
    for step in (1, 1_799_999_999, 1_800_000_000, 3_599_999_999):
        loads = loads.unionByName(micros(hours(spark, 60), step))
    runs = micros(hours(spark, 40), 1_800_000_000).unionByName(hours(spark, 50)).unionByName(hours(spark, 50, zone="B"))
    runs = runs.select("zone", "timestamp", F.col("load").alias("temp_c"))
    sides = []
    for name, df in (("loads", loads), ("runs", runs)):
        df.write.parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    joined = st.enrich_streams(*sides)
    r = runs.select(F.col("zone").alias("z"), F.col("timestamp").alias("valid_from"), "temp_c")
    here = (F.col("timestamp") >= F.col("valid_from")) & (F.col("timestamp") < F.col("valid_from") + F.expr("interval 1 hour"))
    want = loads.join(r, (F.col("zone") == F.col("z")) & here).drop("z")
    assert joined.columns == want.columns
    assert sorted(st.run(joined).collect()) == sorted(want.collect())
    joined.explain()
    met = next(line for line in capfd.readouterr().out.splitlines() if "StreamingSymmetricHashJoin" in line)
    assert "at_hour" in met.split("]")[0]  # zone alone would compare a reading with all forecasts of its zone


def test_watermark_counts_what_it_rejects(spark, tmp_path):
    df = hours(spark, 400)
    for i, part in enumerate((df.where("load >= 1300"), df.where("load < 1300 and load >= 1200"), df.where("load < 1200"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept, rejected = st.run_counting(st.dedupe_within(read))
    assert rejected > 0 and kept.count() + rejected == 400


def test_zone_trends_take_hours_in_any_order(spark, tmp_path):
    a, b = hours(spark, 40, zone="QUIET").where("hour(timestamp) <> 5"), hours(spark, 90, zone="LOUD")
    read = shuffled_feed(spark, a.unionByName(b), str(tmp_path / "in"))
    got = {r["zone"]: r for r in st.latest_trends(st.run(st.zone_trends(read))).collect()}
    assert got["QUIET"]["freshness"] == "stale" and got["LOUD"]["freshness"] == "fresh"
    assert (got["QUIET"]["gap_count"], got["QUIET"]["largest_gap_hours"]) == (2, 2.0) and got["LOUD"]["gap_count"] == 0
    assert got["LOUD"]["timestamp"] == b.agg(F.max("timestamp")).first()[0]


def test_lags_by_time_scan_once(spark):
    df = hours(spark, 30)
    scans = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + d._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    one, six = (joins.lag_by_time(df, "load", range(1, k + 1)) for k in (1, 6))
    assert scans(one) == scans(six)
    twice = joins.lag_by_time(df.unionByName(df), "load", (1, 2))
    assert twice.count() == 60 and six.where("load_lag_6h is not null").count() == 24


def test_functions_reach_workers_from_any_folder(tmp_path):
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from gridweave.session import session
import __spark_entry__ as e
spark = session("elsewhere", "2")
print("rows", e.queries()["udf02_recursive_smoothing"](spark, "/root/testdata/sf0.001").count())
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.startswith("rows "), out.stderr[-2000:]


@pytest.fixture(scope="module")
def daily_cycle(spark):
    """Load that follows the hour of day."""
    df = hours(spark, 24 * 20, lambda i: 1000 + 50 * (i % 24))
    df = calendar_parts(df).withColumns({"load_lag_1h": F.col("load") - 40, "hour_cubed": F.pow("hour", F.lit(3))})
    return stored(df)


def test_boosting_learns_and_balance_sums(spark, daily_cycle):
    names = ["hour", "hour_cubed"]
    models = tr.fit_zones(daily_cycle, lambda z: tr.boosted(names, tr.Profile(trees=30, depth=4)), ["A"])
    r = sc.evaluate(daily_cycle, {"m": models}).first()
    assert r["r2"] > 0.95
    table = tr.importances(spark, models, names)
    assert tr.importance_balance(table).first()["temporal_share"] == pytest.approx(100.0)
    variation = tr.temporal_sensitivity(daily_cycle.limit(1), models, names).first()
    assert variation["n_points"] == 12 and variation["variation_pct"] > 10


def test_balance_of_a_model_without_importances(spark):
    rows = [("flat", "hour", 0.0), ("flat", "load_lag_1h", 0.0), ("good", "hour", 0.5), ("good", "load_lag_1h", 0.25), ("good", "temp_c", 0.25)]
    table = spark.createDataFrame(rows, "model string, feature string, importance double")
    got = {r["model"]: tuple(r)[1:] for r in tr.importance_balance(table).collect()}
    assert got == {"flat": (None, None, None, 0), "good": (25.0, 50.0, 25.0, 1)}


def test_lag_weight_touches_lags_only(daily_cycle):
    out = tr.weigh_lags(daily_cycle, ["hour", "load_lag_1h"], 0.5).first()
    want = daily_cycle.where(F.col("timestamp") == F.lit(out["timestamp"])).first()
    assert out["load_lag_1h"] == want["load_lag_1h"] * 0.5 and out["hour"] == want["hour"]


def test_time_folds_are_ordered(daily_cycle):
    folds = tr.time_folds(daily_cycle, 5).groupBy("fold").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("fold").alias("n"))
    rows = folds.orderBy("fold").collect()
    assert len(rows) == 6 and all(x["b"] < y["a"] for x, y in zip(rows, rows[1:])) and {r["n"] for r in rows} == {80}
