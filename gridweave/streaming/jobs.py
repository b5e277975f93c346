"""Structured Streaming forms of the polled jobs.

Each function takes a streaming DataFrame and gives a streaming DataFrame; ``run`` drives
one to the end of the available files. State is kept per (zone, time), never per zone
over raw rows, so a hot zone spreads over all tasks.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridweave.core.scalars import beside
from gridweave.operators.clean import deduplicate
from gridweave.session import shared_dir


#: Seconds between two looks at a query's reports, of which it keeps the latest hundred.
POLL_SECONDS = 0.2


def run_counting(stream: DataFrame, mode: str = "append", path: str | None = None) -> tuple[DataFrame, int]:
    """Write all available input to Parquet in the shared folder; the result, and how many rows a watermark rejected."""
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    job = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True)
        .start()
    )
    # A query keeps its latest reports only, so they are gathered while it runs.
    dropped: dict = {}
    done = False
    while not done:
        done = job.awaitTermination(POLL_SECONDS)
        dropped |= {(p["batchId"], p["timestamp"]): sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]) for p in job.recentProgress}
    return spark.read.schema(stream.schema).parquet(path), sum(dropped.values())


def run(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """``run_counting`` without the count."""
    return run_counting(stream, mode, path)[0]


class Log:
    """A table of micro-batches that are folded now and then, as immutable generations under a manifest.

    ``batches/batch_id=B`` holds a batch; when it is repeated, the same rows replace it. ``compacted/generation=G/day=D`` holds the
    state of a day that a compaction wrote. The newest file of ``manifest`` says up to which batch all are folded and which generation a day is
    in; it appears by one rename, so a reader sees either the rows before a compaction or those after it, and a folded batch
    that is repeated changes nothing. What the newest two manifests don't name is removed after the next compaction.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType):
        self.spark, self.root = spark, root.rstrip("/")
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.schema = T.StructType([f for f in schema if f.name not in ("day", "batch_id", "generation")])
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def manifests(self) -> list[tuple[int, int, dict[str, int]]]:
        """(generation, last folded batch, {day: generation}) of the kept manifests, oldest first."""
        out = []
        for name in sorted(int(n) for n in self._names("manifest") if n.isdigit()):
            row = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest/{name}").collect()))
            out.append((name, row["upto"], row["days"]))
        return out

    def append(self, rows: DataFrame, batch_id: int, ts: str = "timestamp") -> None:
        rows.select(*self.schema.fieldNames(), F.to_date(ts).alias("day")).write.mode("overwrite").parquet(f"{self.root}/batches/batch_id={batch_id}")

    def _batches(self, after: int) -> DataFrame:
        schema = T.StructType([*self.schema, T.StructField("day", T.DateType()), T.StructField("batch_id", T.LongType())])
        if not self._names("batches"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/batches").where(F.col("batch_id") > after)

    def rows(self, days: Sequence | None = None) -> DataFrame:
        """The rows of the newest manifest and of the batches after it, with ``day``; of some days only if given."""
        _, upto, in_days = (self.manifests() or [(0, -1, {})])[-1]
        out = self._batches(upto).drop("batch_id")
        if days is not None:
            out = out.where(F.col("day").isin(list(days)))
            in_days = {d: g for d, g in in_days.items() if d in {str(x) for x in days}}
        if in_days:
            schema = T.StructType([*self.schema, T.StructField("generation", T.LongType()), T.StructField("day", T.DateType())])
            folded = self.spark.read.schema(schema).option("basePath", f"{self.root}/compacted")
            paths = [f"{self.root}/compacted/generation={g}/day={d}" for d, g in sorted(in_days.items())]
            out = out.unionByName(folded.parquet(*paths).drop("generation"))
        return out

    def compact(self, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the days that batches after the newest manifest touched; other days are not read.

        ``fold`` reduces rows to the state. Run it when no batch is being written, as between two runs of a stream.
        """
        known = self.manifests()
        generation, upto, in_days = known[-1] if known else (0, -1, {})
        found = self._batches(upto).groupBy("day").agg(F.max("batch_id").alias("last")).collect()  # one row for each day
        if not found:
            return
        generation += 1
        touched = [r["day"] for r in found]
        state = fold(self.rows(touched).drop("day")).withColumn("day", F.to_date("timestamp"))
        state.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/compacted/generation={generation}")
        days = in_days | {str(d): generation for d in touched}
        self._commit(generation, {"upto": max(r["last"] for r in found), "days": days})
        for name in self._names("batches"):
            if int(name.split("=")[1]) <= upto:
                self._drop(f"batches/{name}")
        for folder in self._names("compacted"):
            g = int(folder.split("=")[1])
            for name in self._names(f"compacted/{folder}"):
                day = name.removeprefix("day=")
                if name.startswith("day=") and g not in (days.get(day), in_days.get(day)):
                    self._drop(f"compacted/{folder}/{name}")
        for old, *_ in known[:-1]:
            self._drop(f"manifest/{old}")

    def _commit(self, generation: int, content: dict) -> None:
        draft = f"{self.root}/manifest/draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), True)
        out.write(json.dumps(content).encode("utf-8"))
        out.close()
        if not self._fs.rename(self._path(draft), self._path(f"{self.root}/manifest/{generation}")):
            raise RuntimeError(f"another compaction made generation {generation}")


def _each_batch(stream: DataFrame, root: str, write) -> None:
    job = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}-state")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()


def upsert(batch: DataFrame, batch_id: int, root: str, keys: Sequence[str], order: Sequence[str], ts: str = "timestamp") -> None:
    """Append one micro-batch to the log of a table."""
    Log(batch.sparkSession, root, batch.schema).append(deduplicate(batch, keys, order), batch_id, ts)


def upsert_stream(stream: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], ts: str = "timestamp") -> None:
    """Merge arriving increments with last-arrival-wins and no lateness limit."""
    _each_batch(stream, root, lambda df, i: upsert(df, i, root, keys, order, ts))


def current(spark: SparkSession, root: str, schema, keys: Sequence[str], order: Sequence[str], days: Sequence | None = None) -> DataFrame:
    """Present state of the table: the last arrival of each key over the log, or over some of its days."""
    return deduplicate(Log(spark, root, schema).rows(days).select(*schema.fieldNames()), keys, order)


def compact(spark: SparkSession, root: str, schema, keys: Sequence[str], order: Sequence[str]) -> None:
    """Fold the batches of a table (which has ``timestamp``) into a generation of the days they touched."""
    Log(spark, root, schema).compact(lambda rows: deduplicate(rows, keys, order))


SUMS = "zone string, timestamp timestamp, total double, n long"


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("zone", "timestamp").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def upsert_sums(stream: DataFrame, root: str) -> None:
    """Keep partial sums by (zone, hour) of each micro-batch in a log: means without a lateness limit, in any file order."""
    hour = F.date_trunc("hour", "timestamp").alias("timestamp")

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("zone", hour).agg(F.sum("load").cast("double").alias("total"), F.count("load").alias("n"))
        Log(batch.sparkSession, root, SUMS).append(sums, batch_id)

    _each_batch(stream, root, write)


def compact_sums(spark: SparkSession, root: str) -> None:
    """Add up the partial sums of the days that new batches touched."""
    Log(spark, root, SUMS).compact(_merged)


def merged_means(spark: SparkSession, root: str) -> DataFrame:
    """Hourly mean load per zone over the log of partial sums."""
    sums = _merged(Log(spark, root, SUMS).rows())
    return sums.select("timestamp", "zone", (F.col("total") / F.col("n")).alias("load"))


def merged_sliding_means(spark: SparkSession, root: str, hours: int = 24) -> DataFrame:
    """Mean of the ``hours`` hours before each full hour, over the log of partial sums; readings, not hours, weigh the same."""
    ends = _merged(Log(spark, root, SUMS).rows()).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(hours))))
    ends = ends.withColumn("window_end", F.col("timestamp") + F.make_dt_interval(hours=F.col("k")))
    return ends.groupBy("window_end", "zone").agg((F.sum("total") / F.sum("n")).alias("load"))


def dedupe_within(stream: DataFrame, keys: Sequence[str] = ("timestamp", "zone"), delay: str = "2 hours") -> DataFrame:
    """First arrival of each key within the delay; for feeds without corrections."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(keys))


def hourly_sums(stream: DataFrame, delay: str) -> DataFrame:
    return (
        stream.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 hour").alias("hour"), "zone")
        .agg(F.sum("load").alias("total"), F.count("load").alias("n"), F.max("timestamp").alias("last_ts"))
    )


def tumbling_mean(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Hourly mean load per zone."""
    out = hourly_sums(stream, delay)
    return out.select(F.col("hour.start").alias("timestamp"), "zone", (F.col("total") / F.col("n")).alias("load"))


def sliding_mean(stream: DataFrame, width: str = "24 hours", step: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Trailing mean every hour; rows are summed per hour first, so only sums enter the overlapping windows."""
    hours = hourly_sums(stream, delay).withColumn("at", F.window_time("hour"))
    out = hours.groupBy(F.window("at", width, step).alias("w"), "zone").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")
    )
    return out.select(F.col("w.end").alias("window_end"), "zone", (F.col("total") / F.col("n")).alias("load"))


STATE = "hours array<bigint>, loads array<double>, starts array<bigint>, ends array<bigint>, seen bigint"
TREND = (
    "zone string, timestamp timestamp, load double, trend_change_pct double, trend_direction string, "
    "gap_count bigint, largest_gap_hours double, hours_seen bigint"
)
HOUR = 3_600_000_000


def _trend(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Latest eight hourly loads of one zone, and the runs of hours without a gap; hours may come in any order."""
    hours, loads, starts, ends, seen = [list(x) if not isinstance(x, int) else x for x in state.get] if state.exists else ([], [], [], [], 0)
    for frame in frames:
        for ts, load in zip(frame["timestamp"], frame["load"]):
            at = int(ts.value // 1000)
            i = bisect_right(starts, at)
            if i and at <= ends[i - 1]:
                continue  # a known hour
            seen += 1
            joins_before, joins_after = i > 0 and at - ends[i - 1] <= HOUR, i < len(starts) and starts[i] - at <= HOUR
            if joins_before and joins_after:
                ends[i - 1 : i + 1] = [ends[i]]
                del starts[i]
            elif joins_before:
                ends[i - 1] = at
            elif joins_after:
                starts[i] = at
            else:
                starts.insert(i, at)
                ends.insert(i, at)
            j = bisect_right(hours, at)
            hours.insert(j, at)
            loads.insert(j, load)
            del hours[:-8], loads[:-8]
    state.update((hours, loads, starts, ends, seen))
    change = 0.0
    if len(loads) >= 8:
        now, before = sum(loads[-4:]) / 4, sum(loads[-8:-4]) / 4
        change = (now - before) / before * 100 if before else 0.0
    way = "stable" if abs(change) < 0.5 else ("rising" if change > 0 else "falling")
    gaps = [b - a for a, b in zip(ends, starts[1:])]
    row = (key[0], pd.Timestamp(hours[-1], unit="us"), loads[-1], change, way, len(gaps), max(gaps, default=0) / HOUR, seen)
    yield pd.DataFrame([row], columns=[c.split()[0] for c in TREND.split(", ")])


def zone_trends(hours: DataFrame) -> DataFrame:
    """Per-zone trend and gap state over the stream of hourly means, a row for each zone of a micro-batch.

    Feed it the table of ``merged_means``: a zone then brings one row per hour, however many readings it has. The
    state holds eight hours and one pair of times for each gap.
    """
    return hours.groupBy("zone").applyInPandasWithState(_trend, TREND, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_trends(trends: DataFrame, stale_hours: int = 6) -> DataFrame:
    """The last state of each zone; a zone that ends this long before the newest hour of any zone is stale."""
    last = deduplicate(trends, ["zone"], ["hours_seen"]).drop("hours_seen")
    newest = last.agg(F.max("timestamp").alias("newest"))
    behind = F.unix_micros("newest") - F.unix_micros("timestamp")
    out = beside(last, newest).withColumn("freshness", F.when(behind > stale_hours * HOUR, "stale").otherwise("fresh"))
    return out.drop("newest")


def enrich(stream: DataFrame, forecast: DataFrame) -> DataFrame:
    """Stream of readings left-joined per micro-batch with the forecast of their hour."""
    hour = stream.withColumn("hour", F.date_trunc("hour", "timestamp"))
    right = forecast.withColumnRenamed("timestamp", "hour")
    return hour.join(right, ["zone", "hour"], "left")


def enrich_streams(loads: DataFrame, forecasts: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Readings joined with streamed forecasts of the same zone valid in the hour before the reading.

    Both sides meet by zone and full hour: a forecast lies in each hour that its validity touches, two at most, and a reading
    in its own. So a reading is compared with the forecasts of two hours, and the state of a zone spreads over all tasks.
    """
    hour = lambda micros: micros - F.pmod(micros, F.lit(HOUR))
    left = loads.withWatermark("timestamp", delay).withColumn("at_hour", hour(F.unix_micros("timestamp")))
    right = forecasts.withColumnsRenamed({"zone": "f_zone", "timestamp": "valid_from"}).withWatermark("valid_from", delay)
    start = F.unix_micros("valid_from")
    touched = F.sequence(hour(start), hour(start + (HOUR - 1)), F.lit(HOUR))
    right = right.withColumn("f_hour", F.explode(touched))
    cond = (F.col("zone") == F.col("f_zone")) & (F.col("at_hour") == F.col("f_hour")) & (F.col("timestamp") >= F.col("valid_from"))
    cond = cond & (F.col("timestamp") < F.col("valid_from") + F.expr("interval 1 hour"))
    return left.join(right, cond, "inner").drop("f_zone", "at_hour", "f_hour")
