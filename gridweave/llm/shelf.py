"""Intermediate tables in the shared folder, removed as soon as nothing reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridweave.session import shared_dir


class Shelf:
    """Parquet tables of one run under ``spark.checkpoint.dir``.

    A table cuts lineage: a lost executor costs the tasks that read it, not what made it. A table that
    the caller's result still reads stays; ``drop`` removes the others.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        self._paths: list[str] = []

    def put(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """Write the rows and return the table that reads them."""
        self._count += 1
        path = f"{self.folder}/{self._count}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        self._paths.append(path)
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        kept = {t._shelf_path for t in tables}
        for path in [p for p in self._paths if p not in kept]:
            self._remove(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables made by ``put``."""
        for table in tables:
            self._remove(table._shelf_path)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self._paths = [p for p in self._paths if p != path]
