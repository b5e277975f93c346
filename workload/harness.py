"""Registration of checked queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.views import VIEW_SQL, Views

# Added before rounding to 6 places, so that sums in another order cannot fall on the other side of a tie.
OFF_TIE = 1.3e-8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Put the definitions of the views a query names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in needed)
    if not ctes:
        return sql
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, dbl: str = "", lng: str = ""):
    """Register ``fn(views)``. ``dbl`` columns are rounded, ``lng`` columns are bigint, in both."""
    doubles, longs = dbl.split(), lng.split()

    def add(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Views(spark, sf_dir))
            cols = {c: F.round(F.col(c).cast("double") + F.lit(OFF_TIE), 6) + F.lit(0.0) for c in doubles}
            cols.update({c: F.col(c).cast("bigint") for c in longs})
            return out.withColumns(cols) if cols else out

        if name in QUERIES:
            raise ValueError(name)
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            parts = [f"round(CAST({c} AS DOUBLE) + CAST({OFF_TIE} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles]
            parts += [f"CAST({c} AS BIGINT) AS {c}" for c in longs]
            star = f"* REPLACE ({', '.join(parts)})" if parts else "*"
            ORACLES[name] = with_views(f"WITH final_rows AS ({sql})\nSELECT {star} FROM final_rows")
        return fn

    return add
