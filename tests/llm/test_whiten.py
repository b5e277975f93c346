"""Whitening against NumPy over the distinct vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridweave.llm.whiten import whiten

SCHEMA = "vec_id long, embedding array<float>, x string, index int, w double, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2.0, "c") for i, v in rows], SCHEMA).repartition(3)


def expected(rows):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    z = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for x in fit])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    return kept, n, s, e, u


def check(rows, got, components=16):
    kept, n, s, e, u = expected(rows)
    k = min(components, len(e))
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, x in kept:
        z = np.array([(n * x[j] - s[j]) / n for j in range(len(x))])
        for c in range(1, k + 1):
            r = by[i, c][0]
            assert r["n"] == n and r["deviation"] == sum((n * x[j] - s[j]) ** 2 for j in range(len(x)))
            assert r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-6, abs=1e-12)
            assert r["identity_error"] < 1e-6
            if e[c - 1] <= e.sum() * 1e-12:
                assert r["whitened"] is None
                continue
            want = float(z @ u[:, c - 1]) / math.sqrt(e[c - 1])
            if abs(want) > 1e-6:
                sign = signs.setdefault(c, 1 if want * r["whitened"] > 0 else -1)
                assert r["whitened"] == pytest.approx(sign * want, rel=1e-5, abs=1e-7)


def test_against_numpy_with_copies_and_broken_rows(spark):
    rng = np.random.default_rng(5)
    base = [list(map(float, v)) for v in rng.normal(size=(300, 20)) * rng.uniform(0.2, 2, 20)]
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[0]) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] + [0.0] * 19), (2004, [float("inf")] + [0.0] * 19), (None, base[3])]
    check(rows, whiten(table(spark, rows)).collect())


def test_fewer_vectors_than_dimensions(spark):
    rows = [(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 2.0]), (3, [1.0, 1.0, 2.0])]
    check(rows, whiten(table(spark, rows)).collect())
    alone = whiten(table(spark, [(1, [0.5, 0.5])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in alone] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]


def test_empty_and_ragged(spark):
    assert whiten(table(spark, [])).collect() == [] and whiten(table(spark, [(1, None)])).collect() == []
    with pytest.raises(ValueError):
        whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_given_table(spark):
    from gridweave.llm.registry import QUERIES
    import gridweave.llm.queries  # noqa: F401

    source = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in source.collect()]
    check(rows, QUERIES["op11_whitened_embeddings"](spark, "/root/testdata/sf0.01").collect())
