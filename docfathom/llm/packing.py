"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

Patterns are multisets of one to three lengths that fill a sequence exactly.
Their repeat counts are fitted to the histogram of piece lengths, rounded to the nearest number that
the pieces left allow, and given out; what is left is packed best-fit, longest first, on the histogram.
The driver only ever sees the histogram (at most ``max_tokens`` rows) and the
plan made from it; pieces find their places by their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import RankEncoder, default_vocabulary, encoder
from .store import stored
from .textblocks import blocks, ragged

#: Tokens of a sequence, and the id that ends a document.
MAX_TOKENS, END_ID = 1024, 2
#: Rounds of the fit, and patterns that may join it in one round.
FIT_ROUNDS, FIT_STEP = 120, 128


def exact_patterns(lengths: np.ndarray, total: int) -> np.ndarray:
    """All multisets of one to three of ``lengths`` that sum to ``total``, as rows padded with 0."""
    has = np.zeros(total + 1, dtype=bool)
    has[lengths[(lengths > 0) & (lengths <= total)]] = True
    out = [np.array([[total, 0, 0]])] if has[total] else []
    a = np.flatnonzero(has)
    b = total - a
    two = a[(a <= b) & (b > 0)]
    two = two[has[total - two]]
    out.append(np.stack([two, total - two, np.zeros_like(two)], axis=1))
    for x in a[a <= total // 3]:
        y = a[(a >= x) & (a <= (total - x) // 2)]
        y = y[has[total - x - y]]
        out.append(np.stack([np.full_like(y, x), y, total - x - y], axis=1))
    return np.concatenate(out).astype(np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ``|W (A x - histogram)|`` (active-set method, several patterns a round).

    W weighs a length by its square: what is left over should be short pieces, which fit anywhere.
    Any x is valid for what follows; the rounds are limited and so is the closeness, never the result's rightness.
    """
    n = len(patterns)
    x = np.zeros(n)
    if not n:
        return x
    weight = (np.arange(len(histogram)) / (len(histogram) - 1.0)) ** 2
    target = histogram * weight
    tolerance = max(0.25, 1e-6 * target.sum())
    active: list[int] = []
    column = np.zeros((0, len(target)))

    def columns(which: list[int]) -> np.ndarray:
        m = np.zeros((len(which), len(target)))
        for j in range(3):
            np.add.at(m, (np.arange(len(which)), patterns[which, j]), 1.0)
        return m * weight

    for _ in range(FIT_ROUNDS):
        left = target - x[active] @ column if active else target
        gain = (left * weight)[patterns].sum(axis=1)
        gain[active] = -np.inf
        best = np.argsort(-gain, kind="stable")[: 16 * FIT_STEP]
        best = best[gain[best] > tolerance]
        taken, new = set(), []
        for p in best.tolist():
            own = set(patterns[p].tolist()) - {0}
            if not own & taken:
                taken |= own
                new.append(p)
                if len(new) == FIT_STEP:
                    break
        if not new:
            break
        active += new
        column = np.concatenate([column, columns(new)])
        while active:
            gram = column @ column.T
            gram[np.diag_indices_from(gram)] += 1e-6
            z = np.linalg.solve(gram, column @ target)
            now = x[active]
            if (z > 1e-9).all():
                x[active] = z
                break
            low = z <= 1e-9
            step = min(1.0, float((now[low] / np.maximum(now[low] - z[low], 1e-12)).min()))
            now = now + step * (z - now)
            keep = (now > 1e-9) & ~(low & (now <= 1e-9))
            if keep.all():
                keep = now > now.min()
            x[active] = np.where(keep, now, 0.0)
            active = [p for p, k in zip(active, keep.tolist(), strict=True) if k]
            column = column[keep]
    return x


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Places of all pieces: rows (length, first rank, end rank, sequence of the first rank, offset).

    The piece of rank k within its length, ``first <= k < end``, goes to sequence ``sequence + k - first``.
    """
    left = np.zeros(max_tokens + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    given = np.zeros_like(left)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        slots.append((length, int(given[length]), int(given[length]) + count, sequence, offset))
        given[length] += count
        left[length] -= count

    patterns = exact_patterns(np.flatnonzero(left), max_tokens)
    x = fit_counts(patterns, left)
    for p in np.argsort(-x, kind="stable"):
        if x[p] < 0.5:
            break
        own = [int(v) for v in patterns[p] if v]
        repeat = min(round(x[p]), *(int(left[v]) // own.count(v) for v in own))
        if repeat > 0:
            offset = 0
            for v in reversed(own):
                place(v, repeat, sequences, offset)
                offset += v
            sequences += repeat
    # What is left, longest first, into the fullest open sequences that have room; sequences alike are one group.
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, count)
    for length in range(max_tokens, 0, -1):
        while left[length]:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = max_tokens // length
                for size, count in ((each, int(left[length]) // each), (int(left[length]) % each, 1)):
                    if size and count:
                        for k in range(size):
                            place(length, count, sequences, k * length)
                        open_.setdefault(max_tokens - size * length, []).append((sequences, count))
                        sequences += count
                continue
            first, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
            use = min(count, int(left[length]))
            place(length, use, first, max_tokens - room)
            if use < count:
                open_.setdefault(room, []).append((first + use, count - use))
            open_.setdefault(room - length, []).append((first, use))
        open_.pop(0, None)
    return slots


def cut_pieces(df: DataFrame, key: str, text: str, vocabulary: str, max_tokens: int, end_id: int, with_ids: bool) -> DataFrame:
    narrow = df.select(F.col(key), F.col(text).alias("__text"))
    schema = f"`{key}` {narrow.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(vocabulary, RankEncoder)
        for block in blocks(batches, "__text"):
            ids, ends = work.encode(block)
            ids = np.insert(ids, ends[1:], end_id).astype("<u4")
            ends = ends + np.arange(len(ends))
            total = np.diff(ends)
            pieces = (total + max_tokens - 1) // max_tokens
            short = total - (pieces - 1) * max_tokens
            nth, row = ragged(pieces), np.repeat(np.arange(len(total)), pieces)
            start = np.where(nth > 0, short[row] + (nth - 1) * max_tokens, 0)
            length = np.where(nth > 0, max_tokens, short[row])
            raw, at = memoryview(ids.tobytes()), (ends[:-1][row] + start)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            arrays = [block.column(key).take(pa.array(row)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, type=pa.int64())]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return narrow.mapInArrow(run, schema)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pack every whole text into as few sequences of ``max_tokens`` tokens as the fit finds.

    One row per piece: key, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``ids`` (if ``with_ids``), ``sequence_id`` and ``offset``.  A text becomes its
    ids and ``end_id``; only texts longer than a sequence are cut, the short piece first.
    A null or empty text is one piece, the end id alone.  Repeated rows are packed each;
    a null key is kept; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    pieces = stored(cut_pieces(df, key, text, vocabulary or default_vocabulary(), max_tokens, end_id, with_ids))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = plan(histogram, max_tokens)
    # Ranks within a length: each length is dealt over as many groups as they then have rows.
    groups = F.array(*(F.lit(int(np.ceil(np.sqrt(histogram.get(n, 1))))) for n in range(1, max_tokens + 1)))
    order = [key, "piece", "start", "ids_crc32"]
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*order), F.element_at(groups, F.col("length").cast("int"))))
    sizes = dealt.groupBy("length", "__group").agg(F.count("*").alias("__size"))
    before = sizes.select(F.col("length"), F.col("__group"), (F.sum("__size").over(Window.partitionBy("length").orderBy("__group")) - F.col("__size")).alias("__before"))
    ranked = (
        dealt.withColumn("__nth", F.row_number().over(Window.partitionBy("length", "__group").orderBy(*order)) - 1)
        .join(before, ["length", "__group"])
        .withColumn("__rank", F.col("__before") + F.col("__nth"))
    )
    places = spark.createDataFrame(slots, "length long, __first long, __end long, __sequence long, offset long")
    # The plan has at most a few slots for each length, whatever the table's size.
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end"))).drop(places["length"])
    return placed.select(key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("__sequence") + F.col("__rank") - F.col("__first")).alias("sequence_id"), "offset")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, with_ids=False)
