"""Checked queries: streaming jobs driven to the end of the given files, equal to their batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridweave.session import shared_dir
from gridweave.streaming import jobs as st
from workload.features import TS
from workload.harness import query
from workload.joins import ARRIVALS, arrivals

KEYS, ORDER = ["timestamp", "zone"], ["source_rank", "seq"]


@query(
    "str01_upsert_last_arrival",
    f"""SELECT {TS}, zone, resource_name, seq, load FROM ({ARRIVALS})
        QUALIFY row_number() OVER (PARTITION BY {TS}, zone ORDER BY source_rank DESC, seq DESC) = 1""",
    dbl="load",
)
def _(v):
    base = f"{shared_dir(v.spark)}/arrivals-{uuid.uuid4().hex}"
    for rank, df in enumerate(arrivals(v)):
        df.withColumn("source_rank", F.lit(rank)).write.mode("append").parquet(f"{base}/landing")
    schema = v.spark.read.parquet(f"{base}/landing").schema
    stream = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/landing")
    st.upsert_stream(stream, f"{base}/table", KEYS, ORDER)
    return st.current(v.spark, f"{base}/table", schema, KEYS, ORDER).drop("source_rank")


def feed(v, df, files: int = 6):
    """The rows as a stream of shuffled files, one for each trigger."""
    path = f"{shared_dir(v.spark)}/feed-{uuid.uuid4().hex}"
    df.repartition(files).write.parquet(path)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def sums(v) -> str:
    """The log of hourly partial sums of all readings."""
    root = f"{shared_dir(v.spark)}/sums-{uuid.uuid4().hex}"
    st.upsert_sums(feed(v, v.load_raw.where("zone is not null")), root)
    return root


@query("str02_dedupe_any_order", f"SELECT DISTINCT date_trunc('hour', {TS}) AS {TS}, zone FROM load_raw")
def _(v):
    hours = v.load_raw.select(F.date_trunc("hour", "timestamp").alias("timestamp"), "zone", "seq")
    root = f"{shared_dir(v.spark)}/hours-{uuid.uuid4().hex}"
    st.upsert_stream(feed(v, hours), root, KEYS, ["seq"])
    st.compact(v.spark, root, hours.schema, KEYS, ["seq"])
    return st.current(v.spark, root, hours.schema, KEYS, ["seq"]).select("timestamp", "zone")


@query("str02_dedupe_within_watermark", f"SELECT DISTINCT date_trunc('hour', {TS}) AS {TS}, zone FROM load_raw")
def _(v):
    hours = v.load_stream().select(F.date_trunc("hour", "timestamp").alias("timestamp"), "zone")
    return st.run(st.dedupe_within(hours))


HOURLY = f"SELECT date_trunc('hour', {TS}) AS h, zone, sum(load) AS s, count(load) AS n, avg(load) AS load FROM load_raw WHERE zone IS NOT NULL GROUP BY 1, 2"


@query("str03_tumbling_hourly_mean", f"SELECT h AS {TS}, zone, load FROM ({HOURLY})", dbl="load")
def _(v):
    return st.merged_means(v.spark, sums(v))


@query(
    "str04_sliding_daily_mean",
    f"""WITH w AS (SELECT h + to_hours(CAST(k + 1 AS INTEGER)) AS window_end, zone, s, n FROM ({HOURLY}), range(24) t(k))
        SELECT window_end, zone, sum(s) / sum(n) AS load FROM w GROUP BY 1, 2""",
    dbl="load",
)
def _(v):
    return st.merged_sliding_means(v.spark, sums(v))


@query(
    "str05_zone_trends",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY h DESC) AS back,
              (epoch_us(h) - lag(epoch_us(h)) OVER (PARTITION BY zone ORDER BY h)) / 3.6e9 AS gap FROM ({HOURLY})),
        t AS (SELECT zone, max(h) AS {TS}, max(CASE WHEN back = 1 THEN load END) AS load, avg(CASE WHEN back <= 4 THEN load END) AS a,
              avg(CASE WHEN back BETWEEN 5 AND 8 THEN load END) AS b, count(*) FILTER (gap > 1) AS gap_count,
              coalesce(max(CASE WHEN gap > 1 THEN gap END), 0) AS largest_gap_hours FROM r GROUP BY zone)
        SELECT zone, {TS}, load, (a - b) / b * 100 AS trend_change_pct, CASE WHEN abs((a - b) / b * 100) < 0.5 THEN 'stable'
               WHEN a > b THEN 'rising' ELSE 'falling' END AS trend_direction, gap_count, largest_gap_hours,
               CASE WHEN max({TS}) OVER () - {TS} > INTERVAL 6 HOUR THEN 'stale' ELSE 'fresh' END AS freshness FROM t""",
    dbl="load trend_change_pct largest_gap_hours",
    lng="gap_count",
)
def _(v):
    hours = st.merged_means(v.spark, sums(v))
    return st.latest_trends(st.run(st.zone_trends(feed(v, hours))))


@query(
    "str06_stream_static_enrichment",
    f"""SELECT l.zone, date_trunc('hour', l.{TS}) AS hour, l.{TS}, l.seq, l.load, w.temp_c, w.humidity FROM load_raw l
        LEFT JOIN weather_hourly w ON l.zone = w.zone AND date_trunc('hour', l.{TS}) = w.{TS}""",
    dbl="load temp_c humidity",
)
def _(v):
    loads = v.load_stream().select("zone", "timestamp", "seq", "load")
    return st.run(st.enrich(loads, v.weather_hourly.select("zone", "timestamp", "temp_c", "humidity")))


@query(
    "str06_stream_stream_enrichment",
    f"""SELECT l.zone, l.{TS}, l.seq, l.load, w.{TS} AS valid_from, w.temp_c FROM load_raw l
        JOIN weather_hourly w ON l.zone = w.zone AND date_trunc('hour', l.{TS}) = w.{TS}""",
    dbl="load temp_c",
)
def _(v):
    path = f"{shared_dir(v.spark)}/weather-feed-{uuid.uuid4().hex}"
    feed = v.weather_hourly.select("zone", "timestamp", "temp_c")
    feed.write.parquet(path)
    loads = v.load_stream().select("zone", "timestamp", "seq", "load")
    return st.run(st.enrich_streams(loads, v.spark.readStream.schema(feed.schema).parquet(path)))
