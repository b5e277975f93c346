"""Declared schemas of the tables."""

LOAD = "timestamp timestamp, load double, resource_name string, zone string, region string, data_source string"
WEATHER = (
    "timestamp timestamp, temp_c double, humidity double, wind_speed double, zone string, region string, data_source string"
)
FORECAST = (
    "timestamp timestamp, zone string, temp_c double, humidity double, wind_speed_kmh double, "
    "forecast_source string, forecast_issued timestamp, forecast_horizon_hours int"
)
CONDITIONS = (
    "zone string, timestamp timestamp, temp_c double, humidity double, wind_speed double, weather_code int, city string"
)
REGION_CSV = "`Time Stamp` string, Name string, PTID string, Load double"
HOURLY_JSON = (
    "zone string, issued timestamp, properties struct<periods:array<struct<"
    "startTime:timestamp,temperature:double,relativeHumidity:struct<value:double>,windSpeed:string>>>"
)
REPORT_XML = (
    "RESOURCE_NAME string, DATA_ITEM string, INTERVAL_START_GMT string, VALUE string"
)
