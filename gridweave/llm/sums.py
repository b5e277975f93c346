"""Sums of NumPy arrays over the tasks of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of this many tasks are added before the parts of all tasks meet.
FAN_IN = 32


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], size: int) -> dict[int, np.ndarray]:
    """{key: sum over all tasks} of the arrays of doubles, ``size`` long, that ``part`` makes of a task's batches.

    The keys are few and known to the caller, which bounds what reaches the driver. No task adds more parts than
    ``FAN_IN``, or a ``FAN_IN``-th of all.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v for k, v in part(batches).items() if v.any()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int64()), pa.array([v.astype(np.float64).tobytes() for v in own.values()], pa.binary())], ["key", "part"]
        )

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for x in group["part"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"key": group["key"][:1], "part": [total.tobytes()]})

    parts = rows.mapInArrow(made, "key long, part binary").withColumn("some", F.floor(F.spark_partition_id() / FAN_IN))
    few = parts.groupBy("key", "some").applyInPandas(lambda g: added(g[["key", "part"]]), "key long, part binary")
    whole = few.groupBy("key").applyInPandas(added, "key long, part binary")
    return {r["key"]: np.frombuffer(r["part"]) for r in whole.collect()}
