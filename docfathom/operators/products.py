"""The best dot products of many queries against many vectors: pairs of blocks, each a matrix product within a task.

Single precision finds what may be among the best, with a bound on its error; what it finds is computed again in double
precision in the order of ``vectors.dot``.  A task holds two blocks of at most ROWS vectors and tiles of a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import SLACK, Best, _ints

#: Vectors of a block at most, and at least where there are several; queries and vectors of a tile; pairs computed again at once.
ROWS, LEAST, ASKED, TILE, PAIRS = 32_768, 1024, 512, 8192, 16_384


def regular(values: Column, dimensions: int) -> Column:
    """Whether the error's bound holds: no nulls, finite, of moderate size, of the common number of dimensions."""
    return F.coalesce((F.size(values) == dimensions) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e15)), F.lit(False))


def _distinct(x: np.ndarray, position: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that k equal ones of smaller position precede."""
    same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((position, same))
    new = np.flatnonzero(np.concatenate(([True], same[order][1:] != same[order][:-1])))
    place = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
    return np.sort(order[place < k])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def best_products(vectors: DataFrame, queries: DataFrame, n: int, asked: int, dimensions: int, k: int, floor: float) -> DataFrame:
    """Of ``asked`` queries and ``n`` vectors, all regular, what may be among the ``k`` best of a query: query_id, id, position, score."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    wide = max(-(-asked // ROWS), min(-(-asked // LEAST), 6))
    high = max(-(-n // ROWS), min(-(-n // LEAST), -(-3 * cores // wide)))
    both = {vectors.schema["values"].dataType.simpleString(), queries.schema["values"].dataType.simpleString()}
    kind = "array<float>" if both == {"array<float>"} else "array<double>"
    id_type, place_type, query_type = vectors.schema["id"].dataType.simpleString(), vectors.schema["position"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    left = vectors.withColumn("own", F.pmod(F.xxhash64("id", "position"), F.lit(high))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    left = left.select((F.col("own") * wide + F.col("other")).alias("cell"), "id", "position", none(query_type).alias("query_id"), F.col("values").cast(kind).alias("values"), F.lit(False).alias("asks"))
    right = queries.withColumn("own", F.pmod(F.xxhash64("query_id"), F.lit(wide))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    right = right.select((F.col("other") * wide + F.col("own")).alias("cell"), none(id_type).alias("id"), none(place_type).alias("position"), "query_id", F.col("values").cast(kind).alias("values"), F.lit(True).alias("asks"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        row_v, row_q = np.flatnonzero(~asks), np.flatnonzero(asks)
        values = table.column("values").combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
        ids, position, query_id = (pa.concat_arrays(table.column(c).chunks) for c in ("id", "position", "query_id"))
        parts = []
        if len(row_v) and len(row_q):
            row_v = row_v[_distinct(np.ascontiguousarray(x[row_v]), _ints(position)[row_v], k)]
            v, q = x[row_v].astype(float), x[row_q].astype(float)
            v32, q32 = v.astype(np.float32), q.astype(np.float32)
            error = (dimensions + 8) * 2.0**-23 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1).max()) + 1e-30
            for a in range(0, len(q), ASKED):
                best, off = Best(len(q[a : a + ASKED]), k), error[a : a + ASKED, None]
                for b in range(0, len(v), TILE):
                    near = q32[a : a + ASKED] @ v32[b : b + TILE].T
                    least = np.maximum(best.least[:, None], floor) - off - SLACK
                    if b == 0 and near.shape[1] > k:
                        least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k, None] - 2 * off - SLACK)
                    i, j = np.nonzero(near >= least)
                    for c in range(0, len(i), PAIRS):
                        r, s = i[c : c + PAIRS], j[c : c + PAIRS] + b
                        score = _exact(v[s], q[a + r])
                        ok = (score >= floor) & (score >= best.least[r])
                        rows = pa.array(row_v[s[ok]])
                        best.add(r[ok], score[ok], ids.take(rows), position.take(rows))
                    best.cut()
                if (out := best.rows()) is not None:
                    parts.append(pa.table([query_id.take(pa.array(row_q[a + out[0]])), out[2], out[3], pa.array(out[1])], names=["query_id", "id", "position", "score"]))
        if parts:
            return pa.concat_tables(parts)
        return pa.table([query_id.slice(0, 0), ids.slice(0, 0), position.slice(0, 0), pa.array([], pa.float64())], names=["query_id", "id", "position", "score"])

    dealt = left.unionByName(right).repartition(min(2000, wide * high), "cell")
    return dealt.groupBy("cell").applyInArrow(run, f"query_id {query_type}, id {id_type}, position {place_type}, score double")
