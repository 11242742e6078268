"""Exact top-k search as a Voronoi kNN join.

Scores are integer inner products. Vectors are assigned to the cells of a few pivots; each cell is
summarised by its radius and size. A query's own cell is searched first, which gives a proven lower
bound for its k-th score. For a query q and a cell with pivot p and radius r, no score can exceed
q.p + |q| r; only queries whose bound does not exclude a cell are sent there, in blocks, and only
blocks of that cell are read. What each block finds is merged per query.

Pivots: farthest-first over a bounded sample (`pivot_sample` vectors with the smallest hashes), so the
broadcast of pivots and summaries is bounded by `pivots` rows per dimension. Every vector is assigned.
Their number grows with the square root of the rows, up to 512. A cell that holds many vectors is dealt out
in blocks of `block` by hash, so a hot cell is many tasks. Rows alike in id and vector are one row with a count; more
than k + 1 of them cannot matter to any result, so a row repeated a billion times is one candidate that stands k + 1 times.

Edge cases: a vector that is null, empty, or holds a null or non-finite component, or whose id is null,
takes no part; a query meets every row but its own, others with its id too; rows alike are one query but a candidate each time; ties go to
the smaller id; vectors of different lengths do not meet; other columns are ignored; empty tables give no rows. Scores must fit
64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import ship, stored

#: Below this sum of magnitudes, float64 products of integers are exact.
EXACT = 2.0**52


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and v: floor(scale * component) as long; rows that take no part are gone."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _stack(column) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else column, dtype=np.int64)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b."""
    if len(a) and len(b) and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate row and score of each query's best k by (score, smaller id); a candidate stands
    `copies` times, a query's own row once less."""
    order = np.argsort(xid, kind="stable")  # so that a stable sort by score breaks ties by id
    order = np.repeat(order, copies[order])
    x, xid = x[order], xid[order]
    rows, cols, scores = [], [], []
    for low in range(0, len(q), 256):
        s = dot(q[low : low + 256], x)
        own = qid[low : low + 256, None] == xid[None, :]
        for i in range(len(s)):
            keep = np.ones(len(xid), bool)
            same = np.flatnonzero(own[i])
            same = same[(x[same] == q[low + i]).all(1)]
            keep[same[:1]] = False
            ok = np.flatnonzero(keep)
            si = s[i][ok]
            if len(si) > k:
                edge = np.partition(si, len(si) - k)[len(si) - k]
                keep = np.flatnonzero(si >= edge)
                ok, si = ok[keep], si[keep]
            top = np.argsort(-si, kind="stable")[:k]
            rows.append(np.full(len(top), low + i)), cols.append(ok[top]), scores.append(si[top])
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), order[np.concatenate(cols)], np.concatenate(scores)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal from the sample's first vector."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        nxt = int(far.argmax())
        if far[nxt] <= 0:
            break
        chosen.append(nxt)
        far = np.minimum(far, ((sample - sample[nxt]) ** 2).sum(1))
    return sample[chosen]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, pivot_sample: int = 2048, block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), id, score. is_query is a condition on the column `id`."""
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, id_col, vector_col, scale)
    rows = stored(rows.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("copies")).withColumn("dim", F.size("v")), "vectors")
    if pivots is None:
        pivots = max(32, min(512, math.isqrt(rows.count()) // 8))
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(pivot_sample).select("dim", "v").collect()
    cells: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in sample}:
        cells[dim] = choose_pivots(_stack([r.v for r in sample if r.dim == dim]).astype(np.float64), pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, flat = b.column(0).to_numpy(), b.column(3).to_numpy(), b.column(1)
            cell, radius, norm = np.zeros(len(ids), np.int32), np.zeros(len(ids)), np.zeros(len(ids))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _stack([flat[int(i)].as_py() for i in at]).astype(np.float64)
                p = cells.get(int(dim), np.zeros((1, int(dim))))  # a length that the sample missed: one cell around 0
                d = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)[None, :]
                cell[at] = d.argmin(1)
                radius[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(1))
                norm[at] = np.sqrt((x**2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dims, pa.int32()), pa.array(cell, pa.int32()), pa.array(radius, pa.float64()), pa.array(norm, pa.float64())], ["id", "v", "copies", "dim", "cell", "radius", "norm"])

    placed = stored(rows.select("id", "v", "copies", "dim").mapInArrow(assign, "id long, v array<bigint>, copies long, dim int, cell int, radius double, norm double"), "cells")
    summary = placed.groupBy("dim", "cell").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # at most `pivots` rows per dimension
    radii: dict[int, list] = {}
    for s in summary:
        radii.setdefault(s.dim, []).append((s.cell, s.radius, max(1, math.ceil(s.n / block))))
    parts = spark.createDataFrame([(d, c, n) for d, x in radii.items() for c, _, n in x], "dim int, cell int, parts int")
    data = placed.join(F.broadcast(parts), ["dim", "cell"]).select("id", "v", "copies", "dim", "cell", F.pmod(F.xxhash64("id", "v"), "parts").cast("int").alias("part"))
    queries = placed.filter(is_query)

    def solve(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        r, c, s = (np.zeros(0, np.int64),) * 3
        if len(q) and len(x):
            r, c, s = _best(_stack(q["v"]), q["query_id"].to_numpy(), _stack(x["v"]), x["id"].to_numpy(), x["copies"].to_numpy(), k)
        return pd.DataFrame({"qrow": q["qrow"].to_numpy()[r], "query_id": q["query_id"].to_numpy()[r], "id": x["id"].to_numpy()[c] if len(x) else c, "score": s})

    found = "qrow long, query_id long, id long, score long"
    keys = ["dim", "cell", "part", "qpart"]

    def search(visits: DataFrame) -> DataFrame:
        """visits: qrow, query_id, v, dim, cell. Each visit goes to every block of its cell."""
        v = visits.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        v = v.withColumn("qpart", F.pmod(F.xxhash64("qrow"), F.greatest(F.lit(1), F.ceil(F.lit(n_queries / block)))).cast("int"))
        wide = data.withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(max(1, math.ceil(n_queries / block)) - 1)))) if n_queries > block else data.withColumn("qpart", F.lit(0))
        return v.select("qrow", "query_id", "v", *keys).groupBy(*keys).cogroup(wide.select("id", "v", "copies", *keys).groupBy(*keys)).applyInPandas(solve, found)

    queries = stored(queries.withColumn("qrow", F.xxhash64("id", "v")).select("qrow", F.col("id").alias("query_id"), "v", "dim", "cell", "norm"), "queries")
    n_queries = queries.count()
    by_score = Window.partitionBy("qrow").orderBy(F.desc("score"), "id")
    near = stored(search(queries).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k), "near")
    floor = near.groupBy("qrow").agg(F.max("rank").alias("have"), F.min("score").alias("least"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other cells that a query has to visit."""
        for b in batches:
            out: list[tuple[int, int]] = []
            dims, own, norm, have, least = (b.column(i).to_pylist() for i in (2, 3, 4, 5, 6))
            for i in range(b.num_rows):
                p = cells.get(dims[i], np.zeros((1, dims[i])))
                q = np.array(b.column(1)[i].as_py(), np.float64)
                for cell, radius, _ in radii[dims[i]]:
                    bound = float(q @ p[cell]) + norm[i] * radius
                    if cell != own[i] and ((have[i] or 0) < k or bound * (1 + 1e-9) + 1e-6 * (1 + abs(bound)) >= least[i]):
                        out.append((i, cell))
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(7).take(at), b.column(1).take(at), b.column(2).take(at), pa.array([c for _, c in out], pa.int32())], ["qrow", "query_id", "v", "dim", "cell"])

    known = queries.join(floor, "qrow", "left").select("qrow", "v", "dim", "cell", "norm", "have", "least", "query_id")
    visits = known.mapInArrow(reach, "qrow long, query_id long, v array<bigint>, dim int, cell int")
    rest = search(visits)
    both = near.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return both.select("query_id", "rank", F.col("id").alias(id_col), "score")
