"""Whitening of embeddings with distributed block matrices.

1. Entries become integers, so sums are exact on any layout; the fit list has each distinct vector once, indexed 0 to n - 1.
2. The centred fit list is a block matrix of ``BLOCK_ROWS`` rows a block. The scatter matrix is its transpose times itself; the
   products of the blocks are summed over ``SPLITS`` tasks first, so no task gets all rows.
3. The scatter matrix (dimensions squared, whatever the number of rows) is decomposed on the driver; dividing each eigenvector by
   the root of its eigenvalue gives the whitening matrix, and the block matrix times it projects the rows.
4. Every row takes the projection of its fit vector by a join, so copies of a vector are projected once.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf

BLOCK_ROWS = 1024
#: The scatter matrix and its decomposition are on the driver: at 4,096 dimensions 134 MB each.
MOST_DIMENSIONS = 4096
#: Tasks among which the products of one result block are summed.
SPLITS = 64

#: Fixed values of the integers: steps a unit, and the offset that keeps them positive.
SCALE = 64
OFFSET = 1_000_000

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _rows(vectors: DataFrame, vector: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole and finite."""
    entry = F.col(vector).cast("array<double>")
    # A null or NaN fails the comparison, as does a number too large for an integer.
    whole = F.forall(entry, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(2.0**53 / SCALE)), F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entry.alias("entries")).where(F.col("entries").isNotNull() & (F.size("entries") > 0) & whole)
    return kept.select("vec_id", F.transform("entries", lambda c: F.floor(c * SCALE) + F.lit(OFFSET)).alias("x"))


def _indexed(fit: DataFrame, shelf: Shelf) -> DataFrame:
    """(x, index): the rows numbered from 0 without gaps, by one count for each task."""
    held = shelf.put(fit.withColumn("at", F.monotonically_increasing_id()))
    counts = held.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()  # one row for each task
    first = np.cumsum([0, *(r["count"] for r in counts)])
    begins = fit.sparkSession.createDataFrame([(r["part"], int(a)) for r, a in zip(counts, first)], "part long, begin long")
    numbered = held.join(F.broadcast(begins), F.shiftright("at", 33) == F.col("part"))
    return numbered.select("x", (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("index"))


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, the inner dimension split among as many tasks."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _blocks(rows: DataFrame, vector: Column, dimensions: int) -> BlockMatrix:
    """The block matrix of (index, vector)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("row")), "row")
    return IndexedRowMatrix(vectors, numCols=dimensions).toBlockMatrix(BLOCK_ROWS, dimensions)


def whiten(vectors: DataFrame, components: int = 16, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each row and component.

    Rows of ``vectors`` (vec_id, ``vector``; others are ignored) with a null or empty vector, or with an entry that is null, not
    finite or beyond 2**47, are dropped. An entry c becomes the integer ``floor(64 * c) + 1000000``. Each distinct vector counts once
    in the fit, whatever the number of rows. Components are numbered from 1 by falling eigenvalue of the covariance (divisor n);
    there are as many as ``components`` and the dimensions allow. A component without variance (fewer different vectors than
    dimensions, say) has ``whitened`` null, and counts for nothing in ``identity_error``. ``deviation`` is null where it exceeds a
    long. Repeated rows and null ids are rows like any other. An empty table, or one without a whole vector, gives an empty one.
    Vectors of different lengths are refused.
    """
    spark = vectors.sparkSession
    shelf = Shelf(spark, "whiten")
    rows = _rows(vectors, vector)
    index = shelf.put(_indexed(rows.select("x").distinct(), shelf))
    n, least, dimensions = index.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], WHITENED)
    if least != dimensions or dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {least} to {dimensions} entries; one length up to {MOST_DIMENSIONS} is expected")
    sums = index.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    total = [int(r["s"]) for r in sums.orderBy("d").collect()]  # one row for each dimension
    # n * x - S is exact, so the centred entries have one rounding.
    exact = F.zip_with("x", F.array(*(F.lit(s).cast("decimal(38,0)") for s in total)), lambda x, s: x.cast("decimal(19,0)") * F.lit(n) - s)
    squares = F.aggregate(exact, F.lit(0).cast("decimal(38,0)"), lambda a, v: F.try_add(a, F.try_multiply(v, v)).cast("decimal(38,0)"))
    centred = shelf.put(index.select("index", "x", exact.cast("array<double>").alias("wide"), squares.try_cast("long").alias("deviation")))

    fit = _blocks(centred, F.transform("wide", lambda v: v / F.lit(float(n))), dimensions)
    scatter = _times(fit.transpose(), fit, SPLITS).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * n)
    values, unit = np.linalg.eigh(covariance)
    values, unit = values[::-1][:components], unit[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    varies = values > max(trace, 1e-300) * 1e-12
    matrix = unit[:, varies] / np.sqrt(values[varies])
    k = int(varies.sum())
    explained = [float(v) / trace if trace > 0 else 0.0 for v in values]
    if not k:
        whitened, error = centred.select("x", "deviation", F.array().cast("array<double>").alias("w")), 0.0
    else:
        block = spark.sparkContext.parallelize([((0, 0), DenseMatrix(dimensions, k, matrix.ravel("F").tolist()))], 1)
        projected = fit.multiply(BlockMatrix(block, dimensions, k))
        spread = _times(projected.transpose(), projected, SPLITS).toLocalMatrix().toArray() / n
        error = float(np.abs(spread - np.eye(k)).max())
        table = projected.toIndexedRowMatrix().rows.map(lambda r: (int(r.index), r.vector.toArray().tolist())).toDF("index long, w array<double>")
        projection = shelf.put(table)
        whitened = centred.join(projection, "index").select("x", "deviation", "w")
    each = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.lit(e).alias("explained")) for i, e in enumerate(explained)))
    met = rows.join(whitened, "x").select("vec_id", "deviation", "w", F.explode(each).alias("e"))
    return met.select(
        "vec_id",
        F.col("e.component").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.try_element_at("w", F.col("e.component")).alias("whitened"),
        F.col("e.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
