"""Approximate nearest neighbours: probed lists scanned by column blocks of rotated vectors.

Centroids from a bounded sample cut the space into lists; every vector is in one.  A query looks into the lists
nearest to it.  There the vectors are rotated at random and stored by blocks of columns; after each block a
hypothesis test on the partial distance abandons candidates that are unlikely to be among the best.
Scores are distances of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored
from .textblocks import ragged

#: Rows that centroids are fitted on at most; lists at most; share of the lists that a query probes, and lists at least.
SAMPLE, MAX_LISTS, PROBED_SHARE, LEAST_PROBED = 20_000, 1024, 0.75, 16
#: Columns of a block; candidates scanned at once; strictness of the test (larger: fewer are abandoned).
COLUMNS, STEP, STRICTNESS = 16, 512, 2.1
#: Vectors and queries of a list that meet in one task.
VECTORS, QUERIES = 8192, 1024
SEED = 20240229


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from random rows; lists that become empty keep their centroid."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(sample, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[: min(lists, len(distinct))]].copy()
    for _ in range(rounds):
        near = nearest(sample, centroids, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        own, first = np.unique(near[order], return_index=True)
        centroids[own] = np.add.reduceat(sample[order], first, axis=0) / np.bincount(near)[own][:, None]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    out = []
    for part in np.array_split(rows, max(1, len(rows) // 4096)):
        d = (centroids**2).sum(axis=1) - 2.0 * part @ centroids.T
        if n < d.shape[1]:
            at = np.argpartition(d, n - 1, axis=1)[:, :n]
            out.append(np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1, kind="stable"), axis=1))
        else:
            out.append(np.argsort(d, axis=1, kind="stable"))
    return np.concatenate(out)


def scan(query: np.ndarray, own: int, rotated_query: np.ndarray, columns: list[np.ndarray], vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a list's vectors for the query that is row ``own``: ids and distances, best first.

    ``columns``: the rotated vectors by blocks of columns; ``vectors``: as they were.  A candidate is abandoned if
    its partial distance over m of d columns exceeds ``best * sqrt(m / d) * (1 + STRICTNESS / sqrt(m))``.
    """
    dim = vectors.shape[1]
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(ids), STEP):
        left = np.arange(lo, min(lo + STEP, len(ids)))
        left = left[rows[left] != own]
        limit = best[k - 1] if len(best) >= k else np.inf
        partial, seen = np.zeros(len(left)), 0
        for block in columns:
            width = block.shape[0]
            partial += ((block[:, left] - rotated_query[seen : seen + width, None]) ** 2).sum(axis=0)
            seen += width
            if seen < dim and np.isfinite(limit):
                keep = partial <= limit * limit * (seen / dim) * (1.0 + STRICTNESS / np.sqrt(seen)) ** 2 + 1e-12
                left, partial = left[keep], partial[keep]
                if not len(left):
                    break
        if not len(left):
            continue
        if len(left) > 4 * k:
            left = left[partial <= np.partition(partial, k - 1)[k - 1] * (1 + 1e-9) + 1e-12]
        score = np.sqrt(((vectors[left] - query) ** 2).sum(axis=1))
        best, best_ids = np.concatenate([best, score]), np.concatenate([best_ids, ids[left]])
        order = np.lexsort((best_ids, best))[:k]
        best, best_ids = best[order], best_ids[order]
    return best_ids, best


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest of all other rows for each row whose key is divisible by ``every``.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean distance), ties to the smaller key.
    Vectors that are null, zero or of another length than most, and such with null or non-finite components, take no
    part; nor do rows with a null key.  Rows under one key count each: each one that asks has its own k nearest, another row of
    its key among them if it is near.  Repeated vectors are found like others.  Fewer than k candidates give as many rows; an empty table none.  Other columns are ignored.
    """
    spark = df.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    wide = isinstance(df.schema[vector].dataType.elementType, T.DoubleType)
    kind = np.dtype("<f8" if wide else "<f4")
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    by_size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not by_size:
        return spark.createDataFrame([], out_schema)
    dim, total = by_size[0]["dim"], by_size[0]["count"]
    rows = rows.filter(F.size("v") == dim)
    sampled = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    sample = sampled.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    centroids = fit_centroids(sample, int(min(MAX_LISTS, max(1, np.sqrt(total)))))
    lists = len(centroids)
    probes = min(lists, max(LEAST_PROBED, int(np.ceil(PROBED_SHARE * lists))))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch)
                raw = m.astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(nearest(m, centroids, 1)[:, 0].astype(np.int32)), pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "row", "list", "raw"])

    listed = stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(assign, "id long, row long, list int, raw binary"))
    counts = np.zeros(lists, np.int64)
    for r in listed.groupBy("list").count().collect():  # at most MAX_LISTS rows
        counts[r["list"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column("raw").to_pylist()
                m = np.stack([np.frombuffer(r, kind) for r in raw]).astype(float)
                near = nearest(m, centroids, lists)
                # As many lists as set, and on until they hold enough for k others.
                held = np.cumsum(counts[near], axis=1)
                need = np.maximum(probes, (held < 2 * k + 1).sum(axis=1) + 1).clip(max=lists)
                row = np.repeat(np.arange(len(raw)), need)
                at = near[row, ragged(need)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("row").take(pa.array(row)), pa.array(at.astype(np.int32)), batch.column("raw").take(pa.array(row))], names=["id", "row", "list", "raw"])

    asked = stored(listed.filter(F.col("id") % every == 0).mapInArrow(probe, "id long, row long, list int, raw binary"))
    queries = np.zeros(lists, np.int64)
    for r in asked.groupBy("list").count().collect():
        queries[r["list"]] = r["count"]
    vector_cells = np.maximum(1, -(-counts // VECTORS))
    query_cells = np.maximum(1, -(-queries // QUERIES))

    def cells(which: int, own: np.ndarray, other: np.ndarray, stride: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("list").to_numpy()
                ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
                mine = (rows * np.int64(-7046029254386353131) >> np.int64(33)) % own[at]
                n = other[at]
                row, theirs = np.repeat(np.arange(len(at)), n), ragged(n)
                cell = mine[row] * stride[at][row] + theirs if which == 0 else theirs * stride[at][row] + mine[row]
                yield pa.RecordBatch.from_arrays([pa.array(at[row]), pa.array(cell), pa.array(np.full(len(row), which, np.int32)), pa.array(ids[row]), pa.array(rows[row]), batch.column("raw").take(pa.array(row))], names=["list", "cell", "kind", "id", "row", "raw"])

        return run

    met = "list int, cell long, kind int, id long, row long, raw binary"
    both = listed.join(F.broadcast(spark.createDataFrame([(int(i),) for i in np.flatnonzero(queries)] or [(-1,)], "list int")), "list", "left_semi").select("id", "row", "list", "raw").mapInArrow(cells(0, vector_cells, query_cells, query_cells), met)
    both = both.unionByName(asked.mapInArrow(cells(1, query_cells, vector_cells, query_cells), met)).repartition("list", "cell")
    turn = rotation(dim)

    def scan_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        where, cell, which, ids, row = (table.column(c).to_numpy() for c in ("list", "cell", "kind", "id", "row"))
        raw = table.column("raw").to_pylist()
        order = np.lexsort((row, ids, which, cell, where))
        cut = np.flatnonzero((where[order][1:] != where[order][:-1]) | (cell[order][1:] != cell[order][:-1])) + 1
        for rows in np.split(order, cut):
            n = int((which[rows] == 0).sum())
            if n in (0, len(rows)):
                continue
            m = np.stack([np.frombuffer(raw[r], kind) for r in rows.tolist()]).astype(float)
            vectors, own_ids, own_rows = m[:n], ids[rows[:n]], row[rows[:n]]
            rotated = m @ turn
            columns = [np.ascontiguousarray(rotated[:n, a : a + COLUMNS].T) for a in range(0, dim, COLUMNS)]
            out: list[list[np.ndarray]] = [[], [], [], []]
            for q in range(n, len(rows)):
                found, score = scan(m[q], int(row[rows[q]]), rotated[q], columns, vectors, own_ids, own_rows, k)
                for x, y in zip(out, (np.full(len(found), ids[rows[q]]), np.full(len(found), row[rows[q]]), found, score), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "query_row", "vec_id", "score"])

    found = both.mapInArrow(scan_cells, "query_id long, query_row long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
