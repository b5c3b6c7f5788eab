"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks and queries into batches; each pair of batch and block is one task of bounded size.  A
block sorts its vectors once per dimension.  A query reads those lists from the end that its sign prefers, deeper in each
round; vectors that turn up are scored in full (random access); the scores at the reading depth add up to a bound on all
vectors not yet seen.  It stops as soon as that bound is below its k-th result (strictly, so that ties go to the smaller
id), or when every vector has turned up.  Each task returns at most k rows a query; a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, stored

K, SCALE = 20, 64.0
BLOCK, BATCH = 8192, 1024
#: First depth in the lists; it grows by DEEPER each round.
DEPTH, DEEPER = 32, 4


def search(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query its index, ids and scores of its k best of the block, best first, and how many vectors turned up before
    the bound ended it.  `own`: the query's own row.

    Integer vectors; products are exact: in floats while they stay below 2**24, doubles below 2**53, 64-bit integers below
    2**63, else Python's.  A score among the k best beyond 64 bits is an error.
    """
    n, d = vectors.shape
    most = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, d)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    v, q = vectors.astype(kind), queries.astype(kind)
    order = np.argsort(v, axis=0, kind="stable").T.astype(np.int32)  # by dimension, ascending
    lists = np.take_along_axis(v, order.T, 0)  # depth, dimension
    seen = np.zeros(n, bool)
    for i in range(len(q)):
        x = q[i]
        used = np.flatnonzero(x)
        seen[:] = False
        found, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        if not used.size:
            found, scores = np.arange(n), np.zeros(n, kind)
        up, down = used[x[used] > 0], used[x[used] < 0]
        done, depth = 0, min(DEPTH, n)
        while len(found) < n:
            before = seen.copy()
            for ids_read in (order[up, n - depth : n - done], order[down, done:depth]):
                seen[ids_read.ravel()] = True
            new = np.flatnonzero(seen & ~before)
            # when most of the block turns up, a pass over all of it is the cheapest way to look them up
            found, scores = np.concatenate([found, new]), np.concatenate([scores, (v @ x)[new] if 4 * len(new) > n else v[new] @ x])
            if depth == n:
                break
            other = rows[found] != own[i]
            if np.count_nonzero(other) >= k:
                kth = np.partition(scores[other], -k)[-k]
                high, low = lists[n - depth, up], lists[depth - 1, down]
                if (sum(x[up] * high) + sum(x[down] * low) if kind is object else float(x[up] @ high) + float(x[down] @ low)) < kth:
                    break
            done, depth = depth, min(DEEPER * depth, n)
        read, keep = len(found), rows[found] != own[i]
        found, scores = found[keep], scores[keep]
        if len(found) > k:
            kth = np.partition(scores, -k)[-k]
            near = scores >= kth
            found, scores = found[near], scores[near]
        best = sorted(range(len(found)), key=lambda j: (-scores[j], ids[found[j]]))[:k] if kind is object else np.lexsort((ids[found], -scores))[:k]
        yield i, ids[found[best]], scores[best].astype(np.int64), read


def _task(key: tuple, table: pa.Table, k: int) -> pa.Table:
    size = len(table["v"][0].as_py()) // 8
    v = np.frombuffer(b"".join(table["v"].to_pylist())).reshape(-1, size)
    v = v.astype(np.int64) if np.abs(v).max() < 2**62 else np.vectorize(int, otypes=[object])(v)
    ids, rows, ask = table["vec_id"].to_numpy(), table["row"].to_numpy(), table["ask"].to_numpy(zero_copy_only=False).astype(bool)
    out = [(rows[ask][i], ids[ask][i], a, b) for i, a, b, _ in search(v[ask], rows[ask], ids[~ask], rows[~ask], v[~ask], k)] if ask.any() and not ask.all() else []
    n = [len(a) for _, _, a, _ in out]
    return pa.table({
        "row": np.repeat(np.array([x[0] for x in out], np.int64), n), "query_id": np.repeat(np.array([x[1] for x in out], np.int64), n),
        "vec_id": np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.int64), "score": np.concatenate([x[3] for x in out]) if out else np.zeros(0, np.int64),
    })


def top_k(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k best of all other rows.

    Rows without an id, and vectors that are null, empty or hold null or non-finite components, take no part; a vector
    that is shorter than others counts 0 in what it lacks.  Components are floor(SCALE * x).  Rows that
    repeat an id are vectors of their own: each asks for itself, and each is a candidate for the other.
    """
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good & F.coalesce(finite, F.lit(False)))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    wide = rows.agg(F.max(F.size("embedding")).alias("d"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    d, blocks, batches = wide["d"] or 1, -(-wide["n"] // BLOCK) or 1, -(-wide["q"] // BATCH) or 1

    def quantise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            column = batch.column(1)
            n, at, flat = len(column), column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            v = np.zeros((n, d))
            lens = np.diff(at)
            v[np.repeat(np.arange(n), lens), np.arange(at[0], at[-1]) - np.repeat(at[:-1], lens)] = flat[at[0] : at[-1]]
            whole = np.floor(SCALE * v)  # whole numbers that doubles hold exactly
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in whole], pa.binary())], names=["vec_id", "row", "v"])

    whole = arrow_map(rows, quantise, "vec_id long, row long, v binary")
    each = F.sequence(F.lit(0), F.lit(batches - 1))
    candidates = whole.select(F.lit(False).alias("ask"), "vec_id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.explode(each).alias("batch"))
    asked = whole.where(F.col("vec_id") % every == 0)
    asked = asked.select(F.lit(True).alias("ask"), "vec_id", "row", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch"))
    found = candidates.unionByName(asked).groupBy("block", "batch").applyInArrow(lambda key, table: _task(key, table, k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
