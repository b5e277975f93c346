"""The scalar helpers as temporary SQL functions, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "cooling_degrees": ("t DOUBLE, base DOUBLE", "CASE WHEN t IS NOT NULL THEN greatest(t - base, 0D) END"),
    "heating_degrees": ("t DOUBLE, base DOUBLE", "CASE WHEN t IS NOT NULL THEN greatest(base - t, 0D) END"),
    "cycle_sin": ("x DOUBLE, period DOUBLE", "sin(2 * pi() * x / period)"),
    "cycle_cos": ("x DOUBLE, period DOUBLE", "cos(2 * pi() * x / period)"),
    "f_to_c": ("x DOUBLE", "(x - 32) * 5 / 9"),
    "mph_to_kmh": ("x DOUBLE", "x * 1.60934D"),
    "ms_to_kmh": ("x DOUBLE", "x * 3.6D"),
}


def register_functions(spark: SparkSession) -> None:
    for name, (args, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
