"""Document quality from a Gaussian-kernel ridge over document statistics.

1. Each whole text becomes ``FEATURES`` statistics (lengths, shares of character classes, repetition). Language, source and id
   are no inputs.
2. Statistics are standardised by sums over all labelled training rows and mapped to random Fourier features, whose products
   approximate a Gaussian kernel of ``width`` standard deviations.
3. Each task sums the normal equations of its rows by fold; the sums (``dimension`` squared each) are solved on the driver. As
   they add up, leaving a fold out is a subtraction: each training row has a score of a model that hasn't seen it.
4. These scores and labels are counted in ``BINS`` bins over all training rows, and pooling adjacent violators gives the
   isotonic calibration. A hundredth of the raw score keeps its order within a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf
from gridweave.llm.sums import summed
from gridweave.llm.words import SPACE, Block, blocks, per_text, words

FEATURES = 24
BINS = 1024
FOLDS = 4

_LINE = np.zeros(256, dtype=bool)
_LINE[[0x0A, 0x0D]] = True
_CLASS = np.zeros((8, 256), dtype=bool)
_CLASS[0, 0x61:0x7B] = _CLASS[0, 0x80:] = True
_CLASS[1, 0x41:0x5B] = True
_CLASS[2, 0x30:0x3A] = True
_CLASS[3, [ord(x) for x in ".,;:"]] = True
_CLASS[4, [ord(x) for x in "!?"]] = True
_CLASS[5, [ord(x) for x in "#$%&*@^~+=|<>{}[]\\_`/"]] = True
_CLASS[6, [ord(x) for x in "\"'()-"]] = True
_CLASS[7] = SPACE


def statistics(block: Block) -> np.ndarray:
    """(texts, FEATURES): zeros for a text without words."""
    w, lines = words(block), words(block, _LINE)
    n = len(block.offsets) - 1
    size = np.diff(block.offsets).astype(np.float64)
    many, rows = np.diff(w.bounds).astype(np.float64), np.diff(lines.bounds).astype(np.float64)
    some, few = np.maximum(many, 1), np.maximum(rows, 1)
    classes = [per_text(c[block.data].astype(np.int64), block.offsets) / np.maximum(size, 1) for c in _CLASS]
    length = (w.end - w.start).astype(np.float64)
    mean = per_text(length, w.bounds) / some
    spread = np.sqrt(np.maximum(per_text(length * length, w.bounds) / some - mean**2, 0))
    last, first = block.data[w.end - 1], block.data[w.start]
    line_length = (lines.end - lines.start).astype(np.float64)
    line_mean = per_text(line_length, lines.bounds) / few
    different = lambda x: np.array([len(np.unique(x.hash[a:b])) for a, b in zip(x.bounds[:-1], x.bounds[1:])], dtype=float)
    often = np.array([np.unique(w.hash[a:b], return_counts=True)[1].max() if b > a else 0 for a, b in zip(w.bounds[:-1], w.bounds[1:])], dtype=float)
    share = lambda hit: per_text(hit.astype(np.int64), w.bounds) / some
    out = np.stack(
        [
            np.log1p(size), np.log1p(many), np.log1p(rows), *classes, mean, spread,
            share(length == 1), share(length > 12), share(last == 0x2E), share(last == 0x2C), share(_CLASS[5][last]),
            share(_CLASS[1][first]), different(w) / some, often / some, different(lines) / few, np.log1p(line_mean),
            per_text((line_length < 40).astype(np.int64), lines.bounds) / few,
        ],
        axis=1,
    )
    out[many == 0] = 0
    return out.reshape(n, FEATURES)


def _described(docs: DataFrame) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                found = statistics(block)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, FEATURES, dtype=np.int32), found.ravel())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(block.first, len(found)), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, "doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


class Model:
    """Standardisation and random features; ``weights`` by left-out fold, the last for all."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, dimension: int, width: float):
        random = np.random.default_rng(8)
        self.mean, self.spread = mean, spread
        self.direction = random.normal(size=(FEATURES, dimension)) / (width * np.sqrt(FEATURES))
        self.phase = random.uniform(0, 2 * np.pi, dimension)
        self.weights = np.zeros((FOLDS + 1, dimension + 1))
        self.steps = np.zeros(BINS)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.spread, -8, 8) @ self.direction + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def bin_of(raw: np.ndarray) -> np.ndarray:
    """The bin of a raw score; -0.5 to 1.5 in equal bins, the rest at the ends."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The non-decreasing value of each bin that fits the labels best; a bin without labels takes the mean of its neighbours."""
    stack: list[list[float]] = []
    filled = np.flatnonzero(n)
    if not len(filled):
        return np.full(len(n), 0.5)
    for i in filled:
        stack.append([positive[i], n[i], 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            p, m, k = stack.pop()
            stack[-1] = [stack[-1][0] + p, stack[-1][1] + m, stack[-1][2] + k]
    values = np.concatenate([np.full(int(k), (p + 0.5) / (m + 1)) for p, m, k in stack])
    values = np.maximum.accumulate(values)
    return np.interp(np.arange(len(n)), filled, values)


def train(rows: DataFrame, dimension: int = 256, width: float = 1.0, ridge: float = 1e-3) -> Model:
    """``rows``: fold (0 to FOLDS - 1), x, y."""

    def moments(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros(2 * FEATURES + 1)
        for batch in batches:
            x = _matrix(batch)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        return {0: total}

    total = summed(rows.select("x"), moments, 2 * FEATURES + 1).get(0, np.zeros(2 * FEATURES + 1))
    n = max(total[0], 1)
    mean = total[1 : FEATURES + 1] / n
    model = Model(mean, np.sqrt(np.maximum(total[FEATURES + 1 :] / n - mean**2, 1e-9)), dimension, width)
    side = dimension + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = {f: np.zeros((side, side + 1)) for f in range(FOLDS)}
        for batch in batches:
            z, y, fold = model.features(_matrix(batch)), batch["y"].to_numpy(zero_copy_only=False), batch["fold"].to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                own = z[fold == f]
                out[f] += own.T @ np.concatenate([own, y[fold == f, None]], axis=1)
        return {f: x.ravel() for f, x in out.items()}

    parts = {f: x.reshape(side, side + 1) for f, x in summed(rows, equations, side * (side + 1)).items()}
    every = sum(parts.values(), np.zeros((side, side + 1)))
    for f in range(FOLDS + 1):
        own = every - parts[f] if f in parts else every
        penalty = ridge * max(own[-1, -2], 1) * np.eye(side)
        penalty[-1, -1] = 1e-9  # the constant
        model.weights[f] = np.linalg.solve(own[:, :-1] + penalty, own[:, -1])

    def counted(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros(2 * BINS)
        for batch in batches:
            fold = batch["fold"].to_numpy(zero_copy_only=False)
            raw = (model.features(_matrix(batch)) * model.weights[fold]).sum(axis=1)
            at = bin_of(raw)
            total[:BINS] += np.bincount(at, minlength=BINS)
            total[BINS:] += np.bincount(at, batch["y"].to_numpy(zero_copy_only=False), minlength=BINS)
        return {0: total}

    bins = summed(rows, counted, 2 * BINS).get(0, np.zeros(2 * BINS))
    model.steps = isotonic(bins[:BINS], bins[BINS:])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text); ``labels`` has doc_id and quality.

    Learns from labelled rows whose crc32(doc_id as text) mod 5 isn't 0, by quality (the mean, if a doc_id is labelled more
    than once; null labels count not). Null and empty texts have zero statistics and a score like all others. A null
    doc_id counts as empty text, so it is held out. Without any label every score is 0.5. Other columns are ignored;
    an empty table gives an empty one.
    """
    shelf = Shelf(docs.sparkSession, "quality")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    rows = shelf.put(_described(docs))
    marked = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = rows.withColumn("rest", remainder).where("rest <> 0").join(marked, "doc_id")
    known = shelf.put(known.select(F.col("rest").cast("long").alias("rest"), (F.col("rest") - 1).cast("long").alias("fold"), "x", "y"))
    model = train(known.select("fold", "x", "y"), **settings)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.features(_matrix(batch)) @ model.weights[FOLDS]
            score = 0.99 * model.steps[bin_of(raw)] + 0.01 * np.clip((raw + 0.5) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], ["doc_id", "score"])

    out = rows.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
