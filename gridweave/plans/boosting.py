"""Gradient boosting of squared error over binned tables: all models of all zones, settings and folds are trained together.

1. Features are binned once for each zone (bin 0 is missing): numbers by quantiles, categories by value.
2. A model grows as a generator that asks for sums: gradient, hessian and rows of each bin in some nodes, and the error on held-out
   rows. Any number of growing models is answered by one pass over the binned rows.
3. Zones within ``gridweave.rowsPerChunk`` rows are answered inside one task each (and lane of models). Larger ones are answered by
   a Spark job a step that sums over all their rows; scores are written to the shared folder every ``KEEP`` trees, so a pass walks
   few trees. The two differ only in who adds the sums.
4. Leaf weights are ``-T(G) / (H + lam)`` with G shrunk by ``alpha``; trees grow level by level, or the best leaf first. Categories
   are split in the order of their gradients. A node sends missing values to the side that gains more. Boosting stops when the
   held-out mean absolute error has not improved for ``patience`` trees, and the best number of trees is kept.

A table of models has one row for each model with its trees as arrays, so scoring needs no driver loop.
"""

from __future__ import annotations

import heapq
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.core.quantiles import ROWS_PER_CHUNK
from gridweave.session import setting, stored

#: Trees between two writings of the scores of a large zone.
KEEP = 16
#: Models of a small zone are spread over up to so many tasks.
LANES = 16
#: Zones whose bin borders are sent to the tasks; some kilobytes each.
MOST_ZONES = 20_000
#: Nodes of models that are sent to all tasks, about 40 bytes each; larger tables of models are joined instead.
SENT_NODES = 4_000_000
#: Values of a categorical column.
MOST_CATEGORIES = 250

MODELS = (
    "zone string, model string, fold int, columns array<string>, base double, roots array<int>, feature array<int>, threshold array<double>, "
    "missing_left array<boolean>, categories array<array<double>>, left array<int>, right array<int>, value array<double>, gain array<double>, "
    "trees int, grown int, held_n long, held_mae double, held_mape double"
)


@dataclass(frozen=True)
class Boost:
    """Settings of a boosted model. ``leaves`` 0 grows by level; ``depth`` 0 has no limit; ``patience`` 0 never stops early.
    ``categories`` names the features that are split by value instead of order."""

    trees: int = 1000
    rate: float = 0.05
    depth: int = 5
    leaves: int = 0
    row_share: float = 1.0
    row_every: int = 1
    column_share: float = 1.0
    level_share: float = 1.0
    alpha: float = 0.0
    lam: float = 1.0
    gamma: float = 0.0
    least_weight: float = 1.0
    least_rows: int = 1
    patience: int = 0
    seed: int = 42
    categories: tuple[str, ...] = ()


# The profiles and the two learners of the refresh run.
PROFILES = {
    "conservative": Boost(1000, 0.05, 5, row_share=0.8, column_share=0.8, alpha=0.05, lam=0.5, patience=100),
    "balanced": Boost(1500, 0.04, 5, row_share=0.8, column_share=0.8, alpha=0.2, lam=1.0, patience=120),
    "aggressive": Boost(2500, 0.03, 4, row_share=0.7, column_share=0.7, alpha=1.0, lam=5.0, patience=150),
    "ultra_temporal": Boost(5000, 0.01, 3, row_share=0.6, column_share=0.6, alpha=2.0, lam=10.0, patience=200),
    "extreme_temporal": Boost(8000, 0.005, 2, row_share=0.5, column_share=0.5, level_share=0.5, alpha=5.0, lam=20.0, gamma=1.0, least_weight=10.0, patience=300),
    "leaf_wise": Boost(1000, 0.05, 0, leaves=31, row_share=0.8, row_every=5, column_share=0.9, lam=0.0, least_weight=1e-3, least_rows=20, patience=100),
    "refresh_levels": Boost(300, 0.1, 8, row_share=0.9, column_share=0.9, alpha=0.1, lam=1.0),
    "refresh_leaves": Boost(300, 0.1, 12, leaves=128, row_share=0.9, column_share=0.9, alpha=0.1, lam=1.0, least_weight=1e-3, least_rows=20),
}

# The search space, and the smoothing of a category's gradient.
SEARCH_SPACE = {
    "trees": [300, 500, 800, 1000],
    "rate": [0.01, 0.05, 0.1, 0.15],
    "depth": [3, 4, 5, 6, 7],
    "row_share": [0.7, 0.8, 0.9, 1.0],
    "column_share": [0.7, 0.8, 0.9, 1.0],
    "alpha": [0, 0.1, 0.5, 1.0],
    "lam": [0.1, 0.5, 1.0, 2.0],
}
CATEGORY_SMOOTHING = 10.0


class Feature(NamedTuple):
    """A binned column: by its quantiles or, as a category, by its values."""

    name: str
    category: bool


class Fit(NamedTuple):
    """A model to train: its columns by number, and the fold it is tested on (training takes the folds before)."""

    model: str
    settings: Boost
    columns: tuple[int, ...]
    fold: int | None = None


class Split(NamedTuple):
    node: int
    column: int
    goes_left: np.ndarray  # for each bin
    left: int
    right: int
    gain: float


class Tree(NamedTuple):
    splits: list[Split]
    value: np.ndarray  # for each node


@dataclass
class Ask:
    """Sums wanted: of the bins in ``nodes`` of the tree being grown, after all ``trees``."""

    base: float
    trees: list[Tree]
    splits: list[Split]
    nodes: list[int]
    every_row: bool = False


def _strength(g: np.ndarray, h: np.ndarray, s: Boost) -> np.ndarray:
    shrunk = np.maximum(np.abs(g) - s.alpha, 0) if s.alpha else g
    # A side without weight has no gradient either.
    return shrunk * shrunk / (h + s.lam if s.lam > 0 else np.maximum(h, 1e-300))


def _weight(total: np.ndarray, s: Boost) -> float:
    g, h = float(total[0]), float(total[1])
    return -s.rate * np.sign(g) * max(abs(g) - s.alpha, 0) / (h + s.lam) if h + s.lam > 0 else 0.0


def best_splits(hist: np.ndarray, s: Boost, categorical: np.ndarray, allowed: np.ndarray) -> list[tuple | None]:
    """For each node the best (gain, column, bins that go left, sums on the left, sums on the right).

    ``hist`` has nodes, columns, bins and (gradient, hessian, rows). Equal gains go to the first column and border.
    """
    nodes, columns, bins, _ = hist.shape
    order = np.broadcast_to(np.arange(1, bins), (nodes, columns, bins - 1))
    body = hist[:, :, 1:]
    if categorical.any():
        own = body[:, categorical]
        steep = np.where(own[..., 2] > 0, own[..., 0] / (own[..., 1] + CATEGORY_SMOOTHING), np.inf)
        order = order.copy()
        order[:, categorical] = 1 + np.argsort(steep, axis=2, kind="stable")
        body = np.take_along_axis(hist, order[..., None], axis=2)
    # Sums left of each border, with missing values on the right and, where there are any, on the left as well.
    left = np.cumsum(body, axis=2)[:, :, :, None]
    if hist[:, :, 0, 2].any():
        left = np.concatenate([left, left + hist[:, :, None, None, 0]], axis=3)
    total = hist[:, 0].sum(axis=1)[:, None, None, None]
    g, h, n = (left[..., k] for k in range(3))
    all_g, all_h, all_n = (total[..., k] for k in range(3))
    rows, weight = max(s.least_rows, 1), s.least_weight
    ok = (n >= rows) & (all_n - n >= rows) & (h >= weight) & (all_h - h >= weight) & allowed[None, :, None, None]
    gain = np.where(ok, _strength(g, h, s) + _strength(all_g - g, all_h - h, s), -np.inf)
    gain = 0.5 * (gain - _strength(all_g, all_h, s)) - s.gamma
    out: list[tuple | None] = []
    for i, at in enumerate(gain.reshape(nodes, -1).argmax(axis=1)):
        c, b, missing_left = np.unravel_index(at, gain.shape[1:])
        best = float(gain[i, c, b, missing_left])
        if not best > 1e-12:
            out.append(None)
            continue
        goes = np.zeros(bins, bool)
        goes[order[i, c, : b + 1]] = True
        goes[0] = bool(missing_left)
        out.append((best, int(c), goes, left[i, c, b, missing_left], total[i, 0, 0, 0] - left[i, c, b, missing_left]))
    return out


def grow(s: Boost, columns: int, categorical: np.ndarray) -> Generator[Ask, tuple[np.ndarray, np.ndarray], tuple[float, list[Tree], int, np.ndarray]]:
    """Ask for sums until the model is done; returns (base, kept trees, trees grown, held-out sums of the kept ones)."""
    hist, _ = yield Ask(0.0, [], [], [0], every_row=True)
    g, h, n = hist[0, 0].sum(axis=0)
    base = float(-g / h) if h > 0 else 0.0
    trees: list[Tree] = []
    best, kept, held = np.inf, 0, np.zeros(3)
    while True:
        t = len(trees)
        rng = np.random.default_rng([s.seed, t])
        drawn = rng.permutation(columns)[: max(1, round(s.column_share * columns))]
        splits: list[Split] = []
        hist, loss = yield Ask(base, trees, [], [0])
        mae = loss[1] / loss[0] if loss[0] else np.inf
        if mae < best or not s.patience or not loss[0]:
            best, kept, held = mae, t, loss
        if t >= s.trees or n == 0 or (s.patience and loss[0] and t - kept >= s.patience):
            return base, trees[:kept], t, held
        totals, depth, ready = {0: hist[0, 0].sum(axis=0)}, {0: 0}, []

        def judge(nodes, hist, level):
            allowed = np.zeros(columns, bool)
            allowed[rng.permutation(drawn)[: max(1, round(s.level_share * len(drawn)))] if level else drawn] = True
            for node, found in zip(nodes, best_splits(hist, s, categorical, allowed)):
                if found is not None:
                    heapq.heappush(ready, (-found[0] if s.leaves else depth[node], node, found))

        judge([0], hist, s.level_share < 1)
        leaves = 1
        while ready and (not s.leaves or leaves < s.leaves):
            # The best leaf, or all of a level.
            level = ready[0][0]
            now = [heapq.heappop(ready)]
            while not s.leaves and ready and ready[0][0] == level:
                now.append(heapq.heappop(ready))
            fresh = []
            for _, node, (gain, column, goes, left, right) in now:
                one, two = len(totals), len(totals) + 1
                splits.append(Split(node, column, goes, one, two, gain))
                totals[one], totals[two] = left, right
                depth[one] = depth[two] = depth[node] + 1
                leaves += 1
                fresh += [one, two] if not s.depth or depth[one] < s.depth else []
            if fresh and (not s.leaves or leaves < s.leaves):
                hist, _ = yield Ask(base, trees, list(splits), fresh)
                judge(fresh, hist, s.level_share < 1)
        trees = [*trees, Tree(splits, np.array([_weight(totals[i], s) for i in range(len(totals))]))]
        if not splits and s.row_share >= 1 and s.column_share >= 1 and s.level_share >= 1:
            hist, loss = yield Ask(base, trees, [], [0])
            return base, trees, len(trees), loss


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Rows:
    """Binned rows as one model sees them; answers what it asks."""

    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    key: np.ndarray
    train: np.ndarray
    held: np.ndarray
    width: int
    base: float | None = None
    score: np.ndarray = field(default=None)
    node: np.ndarray = field(default=None)
    trees_done: int = 0
    splits_done: int = 0

    def _apply(self, splits: list[Split]) -> None:
        for split in splits[self.splits_done :]:
            own = np.flatnonzero(self.node == split.node)
            self.node[own] = np.where(split.goes_left[self.bins[own, split.column]], split.left, split.right)
        self.splits_done = len(splits)

    def catch_up(self, ask: Ask) -> None:
        if self.base != ask.base:
            self.base, self.score, self.node = ask.base, np.full(len(self.y), ask.base), np.zeros(len(self.y), np.int32)
        while self.trees_done < len(ask.trees):
            tree = ask.trees[self.trees_done]
            self._apply(tree.splits)
            self.score = self.score + tree.value[self.node]
            self.node = np.zeros(len(self.y), np.int32)
            self.trees_done, self.splits_done = self.trees_done + 1, 0
        self._apply(ask.splits)

    def answer(self, ask: Ask, s: Boost, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums of the bins, held-out rows, their absolute error and their absolute error over the load)."""
        self.catch_up(ask)
        place = np.full(max(ask.nodes[-1] + 1, int(self.node.max(initial=0)) + 1), -1)
        place[ask.nodes] = np.arange(len(ask.nodes))
        own = self.train & (place[self.node] >= 0)
        if s.row_share < 1 and not ask.every_row:
            draw = _mixed(self.key + _mixed(np.uint64([s.seed * 1_000_003 + tree // s.row_every]))[0])
            own &= draw < np.uint64(int(s.row_share * 2**64))
        own = np.flatnonzero(own)
        columns = self.bins.shape[1]
        g = self.w[own] * (self.score[own] - self.y[own])
        at = ((place[self.node[own]] * columns)[:, None] + np.arange(columns)) * self.width + self.bins[own]
        size = len(ask.nodes) * columns * self.width
        flat = at.ravel()
        parts = [np.bincount(flat, np.repeat(v, columns) if v is not None else None, size) for v in (g, self.w[own], None)]
        hist = np.stack(parts, axis=-1).reshape(len(ask.nodes), columns, self.width, 3)
        loss = np.zeros(3)
        if ask.nodes == [0]:
            error, real = np.abs(self.y - self.score)[self.held], np.abs(self.y[self.held])
            loss = np.array([len(error), error.sum(), np.divide(error, real, out=np.zeros_like(error), where=real > 0).sum()])
        return hist, loss


def _answered(fit: Fit, categorical: np.ndarray, rows: Rows):
    """Grow one model whose rows are all here."""
    growth = grow(fit.settings, len(fit.columns), categorical)
    ask = next(growth)
    while True:
        try:
            ask = growth.send(rows.answer(ask, fit.settings, len(ask.trees)))
        except StopIteration as done:
            return done.value


def _row_of(zone, fit: Fit, features: Sequence[Feature], edges: dict[Feature, np.ndarray], result) -> tuple:
    """The row of MODELS of a grown model, with thresholds and categories instead of bins."""
    base, trees, grown, held = result
    own = [features[c] for c in fit.columns]
    roots, feature, threshold, missing, sets, left, right, value, gain = [], [], [], [], [], [], [], [], []
    for tree in trees:
        first = len(feature)
        roots.append(first)
        n = len(tree.value)
        feature += [-1] * n
        threshold += [0.0] * n
        missing += [False] * n
        sets += [[] for _ in range(n)]
        left += [-1] * n
        right += [-1] * n
        gain += [0.0] * n
        value += tree.value.tolist()
        for split in tree.splits:
            at, column = first + split.node, own[split.column]
            feature[at], missing[at], gain[at] = split.column, bool(split.goes_left[0]), float(split.gain)
            left[at], right[at] = first + split.left, first + split.right
            borders = edges[column]
            if column.category:
                sets[at] = [float(borders[b - 1]) for b in np.flatnonzero(split.goes_left[1 : len(borders) + 1]) + 1]
            else:
                b = int(np.flatnonzero(split.goes_left[1:])[-1])
                threshold[at] = float(borders[b]) if b < len(borders) else float("inf")
    n = int(held[0])
    mae, mape = (float(held[1] / n), float(held[2] / n * 100)) if n else (None, None)
    return (zone, fit.model, fit.fold, [c.name for c in own], base, roots, feature, threshold, missing, sets, left, right, value, gain, len(trees), grown, n, mae, mape)


def bin_edges(df: DataFrame, features: Sequence[Feature], bins: int) -> dict[str, dict[Feature, np.ndarray]]:
    """{zone: {feature: rising borders, or the categories}} of at most ``MOST_ZONES`` zones.

    A number x falls in the bin of the first border that is not smaller.
    """
    shares = [i / bins for i in range(1, bins)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    wanted = [
        (F.array_sort(F.collect_set(value(c.name))) if c.category else F.percentile_approx(value(c.name), shares, 100 * bins)).alias(f"c{i}")
        for i, c in enumerate(features)
    ]
    categories = [c.name for c in features if c.category]
    if categories:
        counts = df.agg(*[F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(categories)]).first()
        if max(counts) > 2 * MOST_CATEGORIES:
            raise ValueError(f"a categorical column has about {max(counts)} values; {MOST_CATEGORIES} are the most")
    out = {}
    for r in df.groupBy("zone").agg(*wanted).limit(MOST_ZONES + 1).toLocalIterator():
        own = out[r["zone"]] = {c: np.unique(np.array(r[f"c{i}"] or [], float)) for i, c in enumerate(features)}
        if any(len(own[c]) > MOST_CATEGORIES for c in features if c.category):
            raise ValueError(f"a categorical column of {r['zone']} has more than {MOST_CATEGORIES} values")
    if len(out) > MOST_ZONES:
        raise ValueError(f"more than {MOST_ZONES} zones")
    return out


def _bins_of(values: np.ndarray, borders: np.ndarray, category: bool) -> np.ndarray:
    at = np.searchsorted(borders, values)
    if category:
        found = borders[np.minimum(at, len(borders) - 1)] == values if len(borders) else np.zeros(len(values), bool)
        at = np.where(found, at, len(borders))
    return np.where(np.isnan(values), 0, at + 1).astype(np.uint8)


def numbers(column: pa.Array) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return np.asarray(column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False), float)


def _binned(df: DataFrame, features: Sequence[Feature], edges, target, weight, holdout, key) -> DataFrame:
    """(zone, bins, y, w, key, held, fold) of the rows that have a zone and a target."""
    rows = df.select(
        "zone", *[F.col(c.name).cast("double").alias(f"c{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.xxhash64(*key).alias("key"),
        (F.coalesce(F.col(holdout), F.lit(False)) if holdout else F.lit(False)).alias("held"),
        (F.col("fold").cast("int") if "fold" in df.columns else F.lit(0)).alias("fold"),
    ).where("zone is not null and y is not null and not isnan(y) and w > 0")
    sent = df.sparkSession.sparkContext.broadcast(edges)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zones = np.array(batch["zone"].to_pylist(), object)
            out = np.zeros((len(batch), len(features)), np.uint8)
            for zone in dict.fromkeys(zones):
                own = np.flatnonzero(zones == zone)
                for i, c in enumerate(features):
                    out[own, i] = _bins_of(numbers(batch[f"c{i}"])[own], sent.value[zone][c], c.category) if zone in sent.value else 0
            yield pa.RecordBatch.from_arrays(
                [batch["zone"], pa.array([r.tobytes() for r in out], pa.binary()), *(batch[c] for c in ("y", "w", "key", "held", "fold"))],
                ["zone", "bins", "y", "w", "key", "held", "fold"],
            )

    return rows.mapInArrow(made, "zone string, bins binary, y double, w double, key long, held boolean, fold int")


def _view(columns: dict[str, np.ndarray], fit: Fit, width: int) -> Rows:
    before = columns["fold"] < fit.fold if fit.fold is not None else ~columns["held"]
    test = columns["fold"] == fit.fold if fit.fold is not None else columns["held"]
    return Rows(np.ascontiguousarray(columns["bins"][:, fit.columns]), columns["y"], columns["w"], columns["key"].view(np.uint64), before, test, width)


def _arrays(part: pd.DataFrame | pa.RecordBatch, features: int) -> dict[str, np.ndarray]:
    take = (lambda c: part[c].to_numpy()) if isinstance(part, pd.DataFrame) else (lambda c: part[c].to_numpy(zero_copy_only=False))
    out = {c: take(c) for c in ("y", "w", "key", "held", "fold")}
    return out | {"held": out["held"].astype(bool), "bins": np.frombuffer(b"".join(take("bins")), np.uint8).reshape(-1, features)}


def _small(rows: DataFrame, fits: Sequence[Fit], features: Sequence[Feature], edges, width: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(edges)
    lanes = min(LANES, len(fits))

    def train(key, part: pd.DataFrame) -> pd.DataFrame:
        zone, lane = key
        columns, out = _arrays(part, len(features)), []
        for fit in fits[lane::lanes]:
            marks = np.array([features[c].category for c in fit.columns])
            out.append(_row_of(zone, fit, features, sent.value[zone], _answered(fit, marks, _view(columns, fit, width))))
        return pd.DataFrame(out, columns=[x.split()[0] for x in MODELS.split(", ")])

    spread = rows.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # Little data and much work: more partitions than groups, so that they share few.
    spread = spread.repartition(min(4 * len(edges) * lanes, 8192), "zone", "lane")
    return spread.groupBy("zone", "lane").applyInPandas(train, MODELS)


def _large(rows: DataFrame, zone: str, fits: Sequence[Fit], features: Sequence[Feature], edges, width: int) -> list[tuple]:
    """Models of one zone, each step summed by a job over all its rows."""
    marks = [np.array([features[c].category for c in fit.columns]) for fit in fits]
    growths = [grow(fit.settings, len(fit.columns), m) for fit, m in zip(fits, marks)]
    asks, done = {i: next(g) for i, g in enumerate(growths)}, {}
    table, written = stored(rows.withColumn("scores", F.lit(None).cast("binary"))), [0] * len(fits)

    def views(part, state):
        columns = _arrays(part, len(features))
        scores = part["scores"].to_pylist()
        known = np.frombuffer(b"".join(scores)).reshape(len(scores), -1) if scores and scores[0] is not None else None
        for i, (ask, skipped) in state.items():
            view = _view(columns, fits[i], width)
            if skipped:
                view.base, view.score, view.node = ask.base, known[:, i].copy(), np.zeros(len(view.y), np.int32)
            yield i, view

    def pass_over(table, state):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for batch in batches:
                for i, view in views(batch, state):
                    ask, skipped = state[i]
                    hist, loss = view.answer(ask, fits[i].settings, len(ask.trees) + skipped)
                    old = sums.get(i)
                    sums[i] = (hist, loss) if old is None else (old[0] + hist, old[1] + loss)
            for i, (hist, loss) in sums.items():
                flat = np.concatenate([loss, hist.ravel()])
                own = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own), pa.array(flat[own])], ["fit", "place", "sum"])

        found = table.mapInArrow(made, "fit long, place long, sum double").groupBy("fit", "place").agg(F.sum("sum").alias("sum")).toArrow()
        fit_of, place, total = (found[c].to_numpy() for c in ("fit", "place", "sum"))
        for i, (ask, _) in state.items():
            shape = (len(ask.nodes), len(fits[i].columns), width, 3)
            flat = np.zeros(3 + int(np.prod(shape)))
            own = fit_of == i
            flat[place[own]] = total[own]
            yield i, flat[3:].reshape(shape), flat[:3]

    def written_scores(table, state):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros((len(batch), len(fits)))
                for i, view in views(batch, state):
                    view.catch_up(state[i][0])
                    out[:, i] = view.score
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in out], pa.binary())], batch.schema.names)

        return stored(table.mapInArrow(made, table.schema))

    while asks:
        if any(len(a.trees) - written[i] >= KEEP for i, a in asks.items()):
            state = {i: (Ask(a.base, a.trees[written[i] :], [], [0]), written[i]) for i, a in asks.items()}
            table, written = written_scores(table, state), [len(asks[i].trees) if i in asks else 0 for i in range(len(fits))]
        state = {i: (Ask(a.base, a.trees[written[i] :], a.splits, a.nodes, a.every_row), written[i]) for i, a in asks.items()}
        for i, hist, loss in list(pass_over(table, state)):
            try:
                asks[i] = growths[i].send((hist, loss))
            except StopIteration as end:
                done[i] = end.value
                del asks[i]
    return [_row_of(zone, fit, features, edges[zone], done[i]) for i, fit in enumerate(fits)]


def fit_boosted(
    df: DataFrame,
    models: dict[str, tuple[Sequence[str], Boost]],
    target: str = "load",
    weight: str | None = None,
    holdout: str | None = None,
    key: Sequence[str] = ("zone", "timestamp"),
    folds: Sequence[int] | None = None,
    bins: int = 64,
) -> DataFrame:
    """A table of models (see MODELS): each of ``models`` (name: features, settings) for each zone of ``df``, and each of ``folds``.

    Rows marked by ``holdout`` test and stop the boosting; with ``folds`` a model trains on the rows with a smaller ``fold`` and is
    tested on that fold. ``key`` names a row, so row samples are the same on any layout. Rows without a zone, a target or a positive
    weight are left out; missing features have a bin of their own. An empty table gives an empty one.
    """
    spark = df.sparkSession
    wanted = {m: [Feature(c, c in s.categories) for c in names] for m, (names, s) in models.items()}
    features = list(dict.fromkeys(c for own in wanted.values() for c in own))
    fits = [Fit(m, s, tuple(map(features.index, wanted[m])), k) for m, (_, s) in models.items() for k in (folds or (None,))]
    used = df.where(F.col("zone").isNotNull())
    edges = bin_edges(used, features, bins)
    if not edges:
        return spark.createDataFrame([], MODELS)
    width = 3 + max(len(e) for own in edges.values() for e in own.values())
    rows = stored(_binned(used, features, edges, target, weight, holdout, key))
    limit = setting(spark, "gridweave.rowsPerChunk", ROWS_PER_CHUNK)
    large = [r["zone"] for r in rows.groupBy("zone").count().where(F.col("count") > limit).collect()]  # of at most MOST_ZONES
    out = _small(rows.where(~F.col("zone").isin(large)), fits, features, edges, width)
    found = [r for zone in large for r in _large(rows.where(F.col("zone") == zone), zone, fits, features, edges, width)]
    return stored(out.unionByName(spark.createDataFrame(found, MODELS)) if found else out)


class Forest:
    """One row of a table of models as arrays that score many rows at a time."""

    def __init__(self, row: dict):
        self.columns, self.base = list(row["columns"]), float(row["base"])
        self.roots = np.asarray(row["roots"], np.int64)
        self.feature, self.left, self.right = (np.asarray(row[c], np.int64) for c in ("feature", "left", "right"))
        self.threshold, self.value = (np.asarray(row[c], float) for c in ("threshold", "value"))
        self.missing_left = np.asarray(row["missing_left"], bool)
        self.sets = {i: np.asarray(x, float) for i, x in enumerate(row["categories"]) if len(x)}
        self.has_set = np.zeros(len(self.feature), bool)
        self.has_set[list(self.sets)] = True

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features in the order of ``columns``."""
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            inner = every
            while True:
                inner = inner[self.feature[node[inner]] >= 0]
                if not len(inner):
                    break
                at = node[inner]
                seen = x[inner, self.feature[at]]
                goes = seen <= self.threshold[at]
                grouped = np.flatnonzero(self.has_set[at])
                for n in np.unique(at[grouped]) if len(grouped) else ():
                    own = grouped[at[grouped] == n]
                    goes[own] = np.isin(seen[own], self.sets[n])
                goes = np.where(np.isnan(seen), self.missing_left[at], goes)
                node[inner] = np.where(goes, self.left[at], self.right[at])
            out += self.value[node]
        return out


def _predict(forests: dict[tuple, Forest], zones: np.ndarray, columns: dict[str, np.ndarray], names: Sequence[str]) -> dict[str, np.ndarray]:
    out = {name: np.full(len(zones), np.nan) for name in names}
    for zone in dict.fromkeys(zones):
        own = np.flatnonzero(zones == zone)
        for name in names:
            forest = forests.get((zone, name))
            if forest is not None:
                out[name][own] = forest.predict(np.stack([columns[c][own] for c in forest.columns], axis=1))
    return out


def _nulls(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def model_names(models: DataFrame) -> list[str]:
    """The names of the models in the table, which its caller gave."""
    return sorted(r[0] for r in models.select("model").distinct().collect())


def score_boosted(df: DataFrame, models: DataFrame) -> DataFrame:
    """``df`` with a column for each model of the table; null where the row's zone (or none) has no such model.

    One pass over the rows for any number of zones and models. Tables of up to ``SENT_NODES`` nodes are sent to the tasks; beyond that rows meet
    the models of their zone by a join on the zone and a part of it.
    """
    size = models.agg(F.coalesce(F.sum(F.size("feature").cast("long") + 10), F.lit(0))).first()[0]
    names = model_names(models)
    used = sorted({c for r in models.select("model", "columns").distinct().toLocalIterator() for c in r["columns"]})
    clash = set(names) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist")
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    if not names:
        return df
    if size <= SENT_NODES:
        sent = df.sparkSession.sparkContext.broadcast({(r["zone"], r["model"]): Forest(r) for r in models.toArrow().to_pylist()})

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                zones = np.array(batch["zone"].to_pylist(), object)
                got = _predict(sent.value, zones, {c: numbers(batch[c]) for c in used}, names)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(_nulls(got[n]) for n in names)], [*batch.schema.names, *names])

        return df.mapInArrow(made, schema)
    limit = setting(df.sparkSession, "gridweave.rowsPerChunk", ROWS_PER_CHUNK)
    lanes = max(1, -(-df.count() // limit))
    rows = df.withColumn("lane__", F.pmod(F.xxhash64(*df.columns), F.lit(lanes)))
    each = models.withColumn("lane__", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))

    def met(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["lane__"])
        forests = {(r["zone"], r["model"]): Forest(r) for r in own.to_pylist()}
        got = _predict(forests, np.array(rows["zone"].to_pylist(), object), {c: numbers(rows[c].combine_chunks()) for c in used}, names)
        for n in names:
            rows = rows.append_column(n, _nulls(got[n]))
        return rows

    return rows.groupBy("zone", "lane__").cogroup(each.groupBy("zone", "lane__")).applyInArrow(met, schema)


def tree_importances(models: DataFrame) -> DataFrame:
    """(zone, model, feature, importance): the share of a model's gain that splits on a feature bring; 0 for features without one."""
    inner = models.select("zone", "model", "columns", F.explode(F.arrays_zip("feature", "gain")).alias("s")).where("s.feature >= 0")
    gains = inner.groupBy("zone", "model", F.element_at("columns", F.col("s.feature") + 1).alias("feature")).agg(F.sum("s.gain").alias("gain"))
    every = models.select("zone", "model", F.explode("columns").alias("feature"))
    out = every.join(gains, ["zone", "model", "feature"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    total = models.select("zone", "model", F.aggregate("gain", F.lit(0.0), lambda a, g: a + g).alias("total"))
    share = F.when(F.col("total") > 0, F.col("gain") / F.col("total")).otherwise(0.0)
    return out.join(total, ["zone", "model"]).select("zone", "model", "feature", share.alias("importance"))
