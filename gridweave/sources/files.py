"""Readers and writers of load, weather and forecast files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.catalog import RESOURCE_ZONE, WEATHER_TEXT, lookup
from gridweave.functions.expr import fahrenheit_to_celsius, leading_number, mph_to_kmh, ms_to_kmh, no_nan
from gridweave.operators.joins import latest_per_key
from gridweave.schemas import CONDITIONS, FORECAST, HOURLY_JSON, LOAD, REGION_CSV, REPORT_XML, WEATHER

LOAD_ITEMS = ["SYS_FCST_5MIN_MW", "SYS_LOAD_5MIN_MW", "LOAD_5MIN_MW"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def mapped_load(df: DataFrame, zones: Sequence[str] | None = None) -> DataFrame:
    """Rows with a zone, of the listed zones if any; both tests reach the scan."""
    df = df.where(F.col("zone").isNotNull())
    if zones:
        df = df.where(F.col("zone").isin(list(zones)))
    return no_nan(df)


def read_load(spark: SparkSession, path: str, zones: Sequence[str] | None = None, schema: str = LOAD) -> DataFrame:
    """Load history."""
    return mapped_load(spark.read.schema(schema).parquet(path), zones)


def read_weather(spark: SparkSession, path: str, zones: Sequence[str] | None = None, schema: str = WEATHER) -> DataFrame:
    """Observed weather; an absent path is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path)
    return no_nan(df.where(F.col("zone").isin(list(zones))) if zones else df)


def latest_forecasts(df: DataFrame, keys: Sequence[str] = ("zone", "timestamp")) -> DataFrame:
    """The last issued forecast of each zone and time."""
    return latest_per_key(df, keys, ["forecast_issued"])


def read_forecasts(spark: SparkSession, root: str, zones: Sequence[str] | None = None) -> DataFrame:
    """Latest issue per zone and time over all snapshots, partitioned by zone."""
    if not _exists(spark, root):
        return spark.createDataFrame([], FORECAST)
    df = spark.read.schema(FORECAST).option("ignoreMissingFiles", "true").parquet(root)
    return latest_forecasts(no_nan(df.where(F.col("zone").isin(list(zones))) if zones else df))


def regional_totals(rows: DataFrame, region: str, source: str) -> DataFrame:
    """Sum of all zones per time with region and source literals; rows without time or load drop out."""
    ts = F.coalesce(
        F.try_to_timestamp("Time Stamp", F.lit("MM/dd/yyyy HH:mm:ss")),
        F.try_to_timestamp("Time Stamp", F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    return (
        rows.select(ts.alias("timestamp"), F.col("Load").alias("load"))
        .dropna()
        .groupBy("timestamp")
        .agg(F.sum("load").alias("load"))
        .select("timestamp", "load", F.lit(region).alias("region"), F.lit(source).alias("data_source"))
    )


def read_region_csv(spark: SparkSession, path: str, region: str = "NYISO", source: str = "nyiso_mis") -> DataFrame:
    """Daily CSV load files of one region."""
    rows = spark.read.schema(REGION_CSV).option("header", True).csv(path)
    return regional_totals(rows, region, source)


def report_rows(rows: DataFrame) -> DataFrame:
    """5-minute load items of a report, with the ingest zone mapping."""
    return (
        rows.where(F.col("DATA_ITEM").isin(LOAD_ITEMS))
        .select(
            F.to_timestamp("INTERVAL_START_GMT").alias("timestamp"),
            F.expr("try_cast(VALUE AS DOUBLE)").alias("load"),
            F.col("RESOURCE_NAME").alias("resource_name"),
        )
        .dropna()
        .withColumns(
            {
                "zone": lookup(RESOURCE_ZONE, F.col("resource_name")),
                "region": F.lit("CAISO"),
                "data_source": F.lit("caiso_oasis_sld"),
            }
        )
    )


def read_report_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML load reports; documents without load items (error answers) give no rows."""
    rows = spark.read.format("xml").option("rowTag", "REPORT_DATA").schema(REPORT_XML).load(path)
    return report_rows(rows)


def hourly_forecasts(docs: DataFrame, max_hours: int | None = None) -> DataFrame:
    """Nested forecast documents to rows; whole hours to the issue time, toward zero. All periods, or the first ``max_hours``."""
    rows = docs.select("zone", "issued", F.posexplode("properties.periods").alias("pos", "p"))
    p = F.col("p")
    seconds = F.unix_seconds(p["startTime"]) - F.unix_seconds("issued")
    wind = F.when(p["windSpeed"].contains("mph"), mph_to_kmh(leading_number(p["windSpeed"])))
    if max_hours is not None:
        rows = rows.where(F.col("pos") < max_hours)
    return rows.where(p["temperature"].isNotNull() & p["startTime"].isNotNull()).select(
        p["startTime"].alias("timestamp"),
        "zone",
        fahrenheit_to_celsius(p["temperature"]).alias("temp_c"),
        p["relativeHumidity"]["value"].alias("humidity"),
        wind.alias("wind_speed_kmh"),
        F.lit("nws").alias("forecast_source"),
        F.col("issued").alias("forecast_issued"),
        (seconds / 3600).cast("int").alias("forecast_horizon_hours"),
    )


def read_hourly_json(spark: SparkSession, path: str, max_hours: int | None = None) -> DataFrame:
    return hourly_forecasts(spark.read.schema(HOURLY_JSON).json(path), max_hours)


def daily_records(rows: DataFrame) -> DataFrame:
    """(date, datatype, value) records to one row per date; mean temperature from tenths of a degree."""
    wide = rows.groupBy("date").pivot("datatype", ["TMAX", "TMIN", "PRCP"]).agg(F.first("value"))
    return wide.withColumn("temp_c", (F.col("TMAX") + F.col("TMIN")) / 2 / 10)


def station_hours(rows: DataFrame, region: str, source: str) -> DataFrame:
    """Hourly station frame to the weather columns, rows without nulls."""
    names = {"time": "timestamp", "temp": "temp_c", "rhum": "humidity", "wspd": "wind_speed"}
    out = rows.withColumnsRenamed(names).select(*names.values()).dropna()
    return out.withColumns({"region": F.lit(region), "data_source": F.lit(source)})


def weather_text(code: Column) -> Column:
    return F.coalesce(lookup(WEATHER_TEXT, code), F.concat(F.lit("weather code "), code.cast("string")))


def current_conditions(rows: DataFrame) -> DataFrame:
    """Latest record per zone, wind in km/h, weather code as text."""
    out = latest_per_key(rows, ["zone"], ["timestamp"])
    return out.withColumns(
        {"wind_speed": ms_to_kmh(F.col("wind_speed")), "description": weather_text(F.col("weather_code"))}
    )


def read_conditions(spark: SparkSession, path: str) -> DataFrame:
    return current_conditions(spark.read.schema(CONDITIONS).json(path))


def write_by_zone(df: DataFrame, path: str, mode: str = "overwrite", partition: Sequence[str] = ("zone",)) -> None:
    """Parquet sink partitioned by zone."""
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def write_snapshot(df: DataFrame, root: str, issued: str) -> None:
    """Dated forecast snapshot; the latest state is a query over the snapshots. A repeated write replaces its own partitions."""
    writer = df.withColumn("issue_day", F.lit(issued)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("zone", "issue_day").parquet(root)


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Result sink: json or csv."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def dataset_metadata(df: DataFrame) -> DataFrame:
    """One row: records, mapped records, range, zones."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count("zone").alias("mapped_records"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.countDistinct("zone").alias("n_zones"),
    )


def write_master(df: DataFrame, root: str) -> DataFrame:
    """Full table, mapped table and metadata; returns the metadata."""
    day = F.to_date("timestamp")
    df.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{root}/master")
    write_by_zone(df.where("zone is not null"), f"{root}/mapped")
    meta = dataset_metadata(df)
    meta.write.mode("overwrite").json(f"{root}/metadata")
    return meta
