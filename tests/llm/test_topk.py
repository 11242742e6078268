"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave.llm import topk


def brute(rows, k):
    seen = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in seen if i % 20 == 0}:
        others = list(seen)
        others.remove((i, list(v)))
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in others if len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("pivots,block", [(None, 8192), (3, 40), (1, 7)])
def test_top_k(spark, pivots, block):
    rng = np.random.default_rng(pivots or 8)
    centres = rng.normal(size=(5, 6)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=6) * 0.2]) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(60)]  # ties and a hot vector
    rows += [(500, None), (520, []), (540, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (560, [float("nan")] * 6), (580, [float("inf")] * 6), (None, [1.0] * 6), (600, [1.0, 2.0]), (601, [2.0, 2.0]), (20, rows[20][1]), (40, rows[41][1])]
    rows += [(41, rows[41][1])] * 30  # one row many times, more often than k
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("clash"), "cell": F.lit(1)}).repartition(3)
    got = topk.top_k(df, F.col("id") % 20 == 0, k=7, pivots=pivots, block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7)


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("id") % 20 == 0).count() == 0
