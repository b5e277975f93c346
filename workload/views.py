"""Load, weather and forecast views over the given tables, for Spark and for the SQL oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE_OF_EVENT = {"click": "NP15", "view": "SCE", "purchase": "SMUD", "signup": "SP15"}

VIEW_SQL = {
    "load_raw": """
        SELECT ts AS "timestamp", value AS load, event_type AS resource_name, event_id AS seq,
               CASE event_type WHEN 'click' THEN 'NP15' WHEN 'view' THEN 'SCE'
                    WHEN 'purchase' THEN 'SMUD' WHEN 'signup' THEN 'SP15' END AS zone
        FROM events""",
    "load_hourly": """
        SELECT zone, date_trunc('hour', "timestamp") AS "timestamp",
               CAST(sum(CAST(load AS DECIMAL(18,4))) AS DOUBLE) + 1000 AS load
        FROM load_raw WHERE zone IS NOT NULL GROUP BY 1, 2""",
    "weather_hourly": """
        SELECT CASE event_type WHEN 'click' THEN 'NP15' WHEN 'view' THEN 'SCE'
                    WHEN 'purchase' THEN 'SMUD' WHEN 'signup' THEN 'SP15' END AS zone,
               date_trunc('hour', ts + to_hours(CAST(event_id % 7 = 0 AS INTEGER))) AS "timestamp",
               CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS DOUBLE) / count(*) * 0.5 - 5 AS temp_c,
               CAST(sum(user_id % 100) AS DOUBLE) / count(*) AS humidity,
               CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) / 10 AS wind_speed
        FROM events WHERE event_type <> 'error' GROUP BY 1, 2""",
    "forecast_hourly": """
        SELECT zone, "timestamp", temp_c + 0.1 * h AS temp_c, humidity, wind_speed AS wind_speed_kmh,
               'model' AS forecast_source, "timestamp" - to_hours(h) AS forecast_issued,
               h AS forecast_horizon_hours
        FROM weather_hourly, (VALUES (1), (6), (12), (24)) AS hs(h)""",
    "load_daily": """
        SELECT r_name AS zone, o_orderdate AS "timestamp",
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS load
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "pred_panel": """
        SELECT l_returnflag AS zone, l_shipdate AS "timestamp", l_orderkey, l_linenumber,
               l_extendedprice AS y_true,
               l_extendedprice * (0.9 + 0.04 * (l_partkey % 6)) AS y_pred
        FROM lineitem""",
}


def load_of(events: DataFrame) -> DataFrame:
    """Events as readings: the event type is the resource, mapped to a zone."""
    zone = F.create_map(*[F.lit(x) for kv in ZONE_OF_EVENT.items() for x in kv])[F.col("event_type")]
    return events.select(
        F.col("ts").alias("timestamp"),
        F.col("value").alias("load"),
        F.col("event_type").alias("resource_name"),
        F.col("event_id").alias("seq"),
        zone.alias("zone"),
    )


class Views:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        # The files may carry timestamps without a zone; the session runs in UTC.
        for f in df.schema.fields:
            if f.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
        return df

    @cached_property
    def load_raw(self) -> DataFrame:
        return load_of(self.table("events"))

    def load_stream(self) -> DataFrame:
        """The events file as a stream of the same rows."""
        rows = (
            self.spark.readStream.schema(self.spark.read.parquet(f"{self.dir}/events.parquet").schema)
            .option("pathGlobFilter", "events.parquet")
            .parquet(self.dir)
        )
        return load_of(rows.withColumn("ts", F.col("ts").cast("timestamp")))

    @cached_property
    def load_hourly(self) -> DataFrame:
        return (
            self.load_raw.where("zone is not null")
            .groupBy("zone", F.date_trunc("hour", "timestamp").alias("timestamp"))
            .agg((F.sum(F.col("load").cast("decimal(18,4)")).cast("double") + 1000).alias("load"))
        )

    @cached_property
    def weather_hourly(self) -> DataFrame:
        events = self.table("events").where("event_type <> 'error'")
        zone = F.create_map(*[F.lit(x) for kv in ZONE_OF_EVENT.items() for x in kv])[F.col("event_type")]
        k = F.get_json_object("props", "$.k").cast("bigint")
        # Every seventh event is noted an hour late, so that weather lacks some hours of the load and has others.
        late = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 7 == 0).cast("int"))
        n = F.count(F.lit(1))
        return events.groupBy(
            zone.alias("zone"), F.date_trunc("hour", late).alias("timestamp")
        ).agg(
            (F.sum(k).cast("double") / n * 0.5 - 5).alias("temp_c"),
            (F.sum(F.col("user_id") % 100).cast("double") / n).alias("humidity"),
            (F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / n / 10).alias("wind_speed"),
        )

    @cached_property
    def forecast_hourly(self) -> DataFrame:
        h = F.col("forecast_horizon_hours")
        return self.weather_hourly.withColumn(
            "forecast_horizon_hours", F.explode(F.array(*[F.lit(x) for x in (1, 6, 12, 24)]))
        ).select(
            "zone",
            "timestamp",
            (F.col("temp_c") + 0.1 * h).alias("temp_c"),
            "humidity",
            F.col("wind_speed").alias("wind_speed_kmh"),
            F.lit("model").alias("forecast_source"),
            (F.col("timestamp") - F.make_dt_interval(hours=h)).alias("forecast_issued"),
            "forecast_horizon_hours",
        )

    @cached_property
    def load_daily(self) -> DataFrame:
        t = self.table
        return (
            t("orders")
            .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(F.col("r_name").alias("zone"), F.col("o_orderdate").alias("timestamp"))
            .agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("load"))
        )

    @cached_property
    def pred_panel(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_returnflag").alias("zone"),
            F.col("l_shipdate").alias("timestamp"),
            "l_orderkey",
            "l_linenumber",
            F.col("l_extendedprice").alias("y_true"),
            (F.col("l_extendedprice") * (0.9 + 0.04 * (F.col("l_partkey") % 6))).alias("y_pred"),
        )
