"""Exact top-k search against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from scriptloom.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, id int, place string"


def whole(vector, scale):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def brute(rows, divisor, k, scale):
    made = [(i, v) for i, v in ((i, whole(v, scale)) for i, v, *_ in rows) if v is not None]
    out = []
    for a, (i, x) in enumerate(made):
        if i is not None and i % divisor == 0:
            scores = [
                (-sum(p * q for p, q in zip(x, y, strict=False)), j is None, j or 0)
                for b, (j, y) in enumerate(made)
                if a != b
            ]
            out += [(i, n, None if null else j, -s) for n, (s, null, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def made_rows(kind, r):
    if kind == "plain":
        return [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    if kind == "ties":
        return [(i, [float(r.randint(-1, 1)) for _ in range(3)]) for i in range(300)]
    if kind == "lengths":
        return [(i, [r.gauss(0, 1) * 10 ** r.uniform(-2, 2) for _ in range(6)]) for i in range(400)]
    if kind == "flat":  # all in one direction
        return [(i, [x, 2 * x, -x, 0.0]) for i, x in enumerate(r.gauss(0, 1) for _ in range(300))]
    if kind == "large":  # products beyond 53 bits
        return [(i, [r.choice([-1, 1]) * r.uniform(1e5, 4e5) for _ in range(6)]) for i in range(120)]
    same = [[1.0, 2.0, 3.0]] * 60
    odd = [None, [None, 1.0, 2.0], [float("nan"), 1.0], [float("inf")], [], [1.0], [1.0, 2.0, 3.0, 4.0], [1e300, 0.0]]
    return [(i % 20, v) for i, v in enumerate([*same, *odd, *odd])] + [(None, [1.0, 2.0]), (None, [5.0, 5.0, 5.0])]


@pytest.mark.parametrize("kind", ["plain", "ties", "lengths", "flat", "large", "odd"])
@pytest.mark.parametrize("blocks", [(1 << 15, 1 << 15, 2048), (37, 7, 10)])
def test_equals_all_products(spark, kind, blocks):
    rows = made_rows(kind, random.Random(kind))
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    found = topk.top_inner_products(df, F.col("id") % 5 == 0, 5, 256.0, block_rows=blocks[0], query_rows=blocks[1], seeds=blocks[2])
    rows = [(i, None if v and max(map(abs, (x for x in v if x is not None)), default=0) > 1e200 else v) for i, v in rows]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 5, 5, 256.0)


def test_fewer_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "x"), (1, [2.0], 1, "x"), (2, [-3.0], 1, "x")], SCHEMA)
    assert [tuple(r) for r in topk.top_inner_products(df, F.col("id") == 0, 5, 1.0).orderBy("rank").collect()] == [(0, 1, 1, 2), (0, 2, 2, -3)]
    assert topk.top_inner_products(df.limit(0), F.col("id") == 0).count() == 0
    assert topk.top_inner_products(df, F.col("id") == 9).count() == 0
    assert topk.top_inner_products(df.filter("vec_id = 0"), F.col("id") == 0).count() == 0


def test_bounds_prune():
    """Few pairs are multiplied out where lengths or directions tell vectors apart."""
    import numpy as np

    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(8192, 32)) * 256 * np.exp(r.normal(size=(8192, 1))))
    squares = (x * x).sum(1)
    numbers = [row.astype("<i4").tobytes() for row in x]
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    held = topk.Searched(np.ma.arange(8192), np.arange(8192), squares, numbers, 32, rotation)
    seen = []
    original = held.head

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key.start)
            return np.asarray(original).__getitem__(key)

    held.head = original.view(Watched)
    asked = x[-64:] * 1.0
    query, vector, score = held.nearest(asked, np.sqrt(squares[-64:]), np.arange(8192)[-64:], np.full(64, -np.inf), 5)
    assert len(seen) < 4  # the shorter half is never visited
    full = (asked @ held.x.T).astype(np.int64)
    for q in range(64):
        assert sorted(score[query == q].tolist(), reverse=True) == sorted(
            (s for s, p in zip(full[q].tolist(), held.places.tolist(), strict=True) if p != 8128 + q), reverse=True
        )[:5]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    equal, rows, _, _, difference = compare(spark, connect(sf), sf, "op11_exact_topk")
    assert equal and rows, difference
