"""Operator 2: exact top-k inner products with multi-resolution segment statistics.

For a segment of w components with means m and deviations s, |q - x|^2 >= w * ((mq - mx)^2 + (sq - sx)^2), so
q . x <= sum of w * (mq * mx + sq * sx) over the segments: the lower bound on the distance, turned into an upper bound
on the score. Bounds are taken with 4, 8, 16 and 32 segments, coarse to fine; only pairs whose bound reaches the k-th
best score known get a finer bound, and only the last survivors an exact integer product.

Rows are packed into blocks of ``BLOCK`` vectors and the stated query set into blocks of ``QUERY_BLOCK``; blocks are
dealt by hash to a grid of tiles of bounded size (some ``TILE`` blocks of either kind), and each cell of the grid is one
group. Within a cell a query's k-th best score so far prunes the blocks that follow, so a cell gives at most k rows a
query, which a ranked window brings together (Spark keeps k of each group before the shuffle).

Defined results: vectors that are null, empty, or that hold null or non-finite components take no part, nor do usable
ones of another length than most usable ones have (ties: the longer). Every usable row for which ``queries`` holds is a
query, and every usable row but itself is a candidate, also one that repeats its vec_id. Ties go to the smaller vec_id.
With fewer candidates than k all are returned. Products are 64-bit integers. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, tidy, written

K, BLOCK, QUERY_BLOCK, TILE, LEVELS = 20, 2048, 512, 4, (4, 8, 16, 32)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row sqrt(w) * mean and sqrt(w) * deviation of each segment, so that the bound is one product."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    w = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    mean = sums / w
    return np.concatenate([mean * np.sqrt(w), np.sqrt(np.maximum(squares - w * mean * mean, 0))], axis=1)


def best_of(vec: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best scores; ties to the smaller vec_id, then row."""
    return np.lexsort((row, vec, -score))[:k]


def top_of_blocks(queries: list[tuple], candidates: list[tuple], k: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, vec_id, best vec_ids, their scores) of each query. Blocks are (vec_ids, rows, matrix of int64)."""
    out = []
    ready = [(vec, row, x, x.astype(np.float64)) for vec, row, x in candidates]
    ready = [(vec, row, x, np.linalg.norm(xf, axis=1).max(initial=0), [statistics(xf, s) for s in LEVELS]) for vec, row, x, xf in ready]
    for q_vec, q_row, q in queries:
        qf = q.astype(np.float64)
        levels = [statistics(qf, s) for s in LEVELS]
        found = [(np.zeros(0, dtype=np.int64),) * 3 for _ in q_vec]  # vec_ids, rows, scores so far
        for vec, row, x, norm, parts in ready:
            slack = 1e-9 * (np.linalg.norm(qf, axis=1).max(initial=0) * norm + 1)
            coarse = levels[0] @ parts[0].T + slack
            coarse[q_row[:, None] == row[None, :]] = -np.inf
            m = min(k, len(vec))
            for i in range(len(q_vec)):
                bound, have = coarse[i], found[i]
                if len(have[2]) >= k:
                    least = have[2][-1]
                else:  # exact scores of the rows with the best coarse bounds give the first k-th best score
                    seed = np.argpartition(-bound, m - 1)[:m]
                    scores = x[seed[np.isfinite(bound[seed])]] @ q[i]
                    least = scores.min() if len(scores) >= k else -np.inf
                live = np.flatnonzero((bound >= least) & np.isfinite(bound))
                for a, b in zip(levels[1:], parts[1:], strict=True):
                    live = live[b[live] @ a[i] + slack >= least]
                if len(live):
                    every = [np.concatenate(z) for z in zip(have, (vec[live], row[live], x[live] @ q[i]), strict=True)]
                    best = best_of(*every, k)
                    found[i] = tuple(z[best] for z in every)
        out.extend((int(r), int(v), f[0], f[2]) for r, v, f in zip(q_row, q_vec, found, strict=True))
    return out


def finite(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (vec_id, row, x array<long>) packed, in the order of each partition: ids, rows and matrix as binary, n.

    The matrix has 32 bits a number where that is enough.
    """

    def packed(batches):
        import pandas as pd

        ids, numbers, vectors = [], [], []

        def flush(n):
            x = np.stack(vectors[:n]).astype("<i8")
            small = np.abs(x).max(initial=0) < 2**31
            out = pd.DataFrame({"ids": [np.array(ids[:n], dtype="<i8").tobytes()], "rows": [np.array(numbers[:n], dtype="<i8").tobytes()], "x": [x.astype("<i4" if small else "<i8").tobytes()], "n": [n]})
            del ids[:n], numbers[:n], vectors[:n]
            return out

        for batch in batches:
            ids.extend(batch["vec_id"])
            numbers.extend(batch["row"])
            vectors.extend(batch["x"])
            while len(ids) >= block:
                yield flush(block)
        if ids:
            yield flush(len(ids))

    return rows.mapInPandas(tidy(packed), "ids binary, rows binary, x binary, n int")


def search(rows: DataFrame, queries: Column, k: int = K, scale: float = 64.0, block: int = BLOCK, query_block: int = QUERY_BLOCK, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score of every row of ``rows`` (vec_id, embedding) for which ``queries`` holds."""
    spark = rows.sparkSession
    bounded_batches(spark)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    good = rows.where(finite(F.col("embedding")) & F.col("vec_id").isNotNull())
    most = good.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 1
    good = good.where(F.size("embedding") == size).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"), queries.alias("asked"), F.monotonically_increasing_id().alias("row"))
    good = written(spark, good)  # so that a row's number stays
    left = written(spark, blocks(good.select("vec_id", "row", "x"), block))
    right = written(spark, blocks(good.where("asked").select("vec_id", "row", "x"), query_block))
    tall, wide = max(1, -(-left.count() // tile)), max(1, -(-right.count() // tile))
    # Cell (t, w) of the grid holds tile t of the candidates and tile w of the queries.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("t", F.pmod(F.xxhash64("rows"), F.lit(tall)).cast("int")).withColumn("w", every(wide))
    right = right.withColumn("w", F.pmod(F.xxhash64("rows"), F.lit(wide)).cast("int")).withColumn("t", every(tall))

    def run(own, asked):
        import pandas as pd

        def read(frame):
            return [(np.frombuffer(i, dtype="<i8"), np.frombuffer(r, dtype="<i8"), np.frombuffer(x, dtype="<i4" if len(x) == 4 * n * size else "<i8").reshape(n, size).astype(np.int64)) for i, r, x, n in zip(frame["ids"], frame["rows"], frame["x"], frame["n"], strict=True)]

        found = top_of_blocks(read(asked), read(own), k)
        count = [len(f[2]) for f in found]
        column = lambda c: np.repeat(np.array([f[c] for f in found], dtype=np.int64), count)
        join = lambda c: np.concatenate([np.zeros(0, dtype=np.int64), *(f[c] for f in found)])
        return pd.DataFrame({"row": column(0), "query_id": column(1), "vec_id": join(2), "score": join(3)})

    part = left.groupBy("t", "w").cogroup(right.groupBy("t", "w")).applyInPandas(run, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.r <> q.r),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY p.r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
